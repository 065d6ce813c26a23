"""The distance decides: texts of which most stands in sentences by their marks are still told from prose."""

from pyspark.sql import functions as F

from quillspark.llm.textstats import ProseModel, chi2_quantile, text_quality


def test_outliers_are_rare_in_prose_and_contributions_add_up(spark, data):
    t = f"{data}/sf0.1"
    got = text_quality(spark.read.parquet(f"{t}/combined_all_columns.parquet"), spark.read.parquet(f"{t}/common_words.parquet"))
    r = got.filter("lang is not null").agg(
        F.avg(F.when(F.col("is_prose"), F.col("is_outlier").cast("int"))).alias("rare"), F.min(F.when(~F.col("is_prose"), F.col("is_outlier").cast("int"))).alias("all"),
        F.max(F.abs(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) - F.col("d2"))).alias("gap"),
    ).first()
    assert 0.002 < r["rare"] < 0.03 and r["all"] == 1 and r["gap"] < 1e-6


def test_junk_that_ends_with_a_sentence(spark):
    rows = [
        (1, "vnparwjmxt;ud; bliwbdyyqwadnv;nmocrqk wkfwy nqb;rstv yi ;nmywpxpzr;tdyjbtn ir;usbvoljaszvm;wwqmkusjvp nqrltcfpc oxrojyxb;ab;jilbd xwzyryc lalxzvz wpddxdl zq xx yy We have it in all of the colours."),
        (2, "Log in\nShare\nZoom\nHome\nPlay\nNext\nFAQ\nTerms\nBack\nSign up\nShare\nReport\nComments\nWe have it in blue."),
        (3, "We have it in all of the colours, and you can see them on the next page of this book."),
        (4, "We have it in all of the colours, and you can\nsee them on the next page of this book, which\nwe made for the friends of the lamp."),
    ]
    common = spark.createDataFrame([("en", w) for w in "the of and to a in is it for we you that with on our as are be this will by have from at or can all".split()], "lang string, word string")
    # a sentence by its mark and its common word, but far from prose: the distance decides against the share
    rows.append((5, "krpyzelmmuxvwpzdzyybfzlmpl ynkmocavrpyacmvjvsleowkdcvuzzdvidmrkb ojjqrerqtenmscqaxr smtkebvx cbeouxlffvwqcoyqfcwxmbsztjsstpylvikndmzeficdlp rfzfppsfor it is."))
    out = {r["row_id"]: r for r in text_quality(spark.createDataFrame(rows, "row_id long, story_content string"), common).collect()}
    assert {k: r["is_prose"] for k, r in out.items()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert out[5]["sentence_share"] > 0.9


def test_a_language_without_documents_has_a_model(spark):
    stats = spark.createDataFrame([], "lang string, log_words double, mean_word_length double, symbol_ratio double, digit_ratio double, punct_end_share double, common_word_share double, distinct_word_share double, words_per_sentence double, sentence_share double")
    m = ProseModel().fit(stats)
    assert all(m.limit(g) > chi2_quantile(0.99, 9) for g in ("en", "ja"))
