"""Sources, sinks, logs, pages, models and streams on small tables made by hand."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X
from quillspark.operators import econometrics as E
from quillspark.operators import evaluation as V
from quillspark.operators import eventlog as L
from quillspark.operators import scoring as S
from quillspark.operators import tables as B
from quillspark.queries_data import QUERIES as QUERIES_DATA
from quillspark.queries_tables import QUERIES as QUERIES_TABLES
from quillspark.queries_tables import SQL as SQL_TABLES
from quillspark.queries_tables import wall_clock_iso
from quillspark.queries_text import QUERIES as QUERIES_TEXT
from quillspark.sources import io
from quillspark.streaming import incremental as I


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("  a\tb c　d ", 4), ("nan", 1), ("w " * 50000, 50000)])
def test_word_count(spark, text, n):
    assert one(spark, text, X.word_count(F.col("x"))) == n


def test_quality_of_nothing(spark):
    for t in (None, "", " \n"):
        assert one(spark, t, X.simple_quality(F.col("x"))) == 0.0
        assert one(spark, t, X.grammar_quality(F.col("x"))) is None


def test_features_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "One two three. One two three. Other words here."), (3, "One two three. One two three. Other words here.")], "k int, text string").withColumn("word_count", F.lit("clash"))
    x = X.text_arrays(df.select("k", "text"), F.col("text"))
    f = X.linguistic_features(F.col("text"), ["the"])
    got = x.select("k", *[v.alias(n) for n, v in f.items()]).orderBy("k").collect()
    assert len(got) == 4 and all(v == 0 for v in got[0][1:]) and all(v == 0 for v in got[1][1:])
    assert got[2]["sentence_count"] == 3 and got[2]["repetition_score"] == pytest.approx(1 / 3)
    blank = x.filter("k < 3").select(*[v.alias(n) for n, v in f.items()])
    assert {r["s"] for r in blank.select(X.ai_score({c: F.col(c) for c in blank.columns}).alias("s")).collect()} == {0.1}


def test_small_text_functions(spark):
    c = F.col("x")
    assert one(spark, "https://a/projects/b-c/?r=1#z", X.slug(c)) == "b-c" and one(spark, None, X.slug(c)) == "" and one(spark, "https://a/x", X.slug(c)) == ""
    assert one(spark, "2020-01-02T03:04:05-05:00", X.strip_zone(c)) == "2020-01-02T03:04:05"
    assert one(spark, " a b ", X.clean_nbsp(c)) == "a b"
    assert one(spark, " a \n\n b", X.normalise_lines(c)) == "a\n\nb"
    assert one(spark, "Patented", X.has_patent_terms(c)) and not one(spark, "patentable", X.has_patent_terms(c)) and one(spark, None, X.has_patent_terms(c)) is False
    assert one(spark, "Just a moment... cf-browser-verification", X.challenge_present(c)) and not one(spark, None, X.challenge_present(c))
    assert one(spark, '<p>a</p><img src="x"><iframe src="y"></iframe><script>"</p>"</script>b&amp;c', X.clean_body(c)) == "a\n[IMAGE]  [EMBED] b&c"
    html = '<html><div class="x story-content y"><p>One</p><script>var a = "</div>";</script><div> Two </div></div></html>'
    assert one(spark, html, X.story_text(c)) == "One\n\nTwo" and one(spark, "<p>none</p>", X.story_text(c)) is None
    assert one(spark, 0.05, X.stars(c), "double") == "." and one(spark, 0.0009, X.stars(c), "double") == "***"
    assert one(spark, 0.4, X.score_bucket(c), "double") == "medium"
    assert one(spark, "10.05.0", B.clean_id(c)) == "10.05" and one(spark, "x", B.number(c)) is None and one(spark, "12.5%", B.percent(c)) == 12.5


def test_first_by_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "p"), (None, 2, "q"), ("a", 1, "y")], "k string, o int, v string")
    assert sorted((r["k"] or "", r["v"]) for r in B.first_by(df, ["k"], [F.col("o"), F.col("v")]).collect()) == [("", "p"), ("a", "y")]
    assert sorted((r["k"] or "", r["v"]) for r in B.first_by(df, ["k"], [F.col("o"), F.col("v")], keep_null_keys=True).collect()) == [("", "p"), ("", "q"), ("a", "y")]
    assert B.first_by(df.limit(0), ["k"], [F.col("o")]).count() == 0


def test_rounds(spark):
    rows = [(1, "k", "old", 1), (2, "k", "new", 1), (3, "j", "", 1), (4, "j", "late", 3), (5, "j", "two", 2), (6, "i", None, 1)]
    df = spark.createDataFrame(rows, "story_row_id long, platform string, story_content string, scrape_round int")
    got = {r["platform"]: r["story_content"] for r in B.fill_rounds(df, ["platform"]).collect()}
    assert got == {"k": "new", "j": "two", "i": None}


def test_log(spark):
    s = "2024-01-01 00:00:%02d,000 - INFO - "
    lines = [
        s % 0 + "[PROJECT_START] Processing project 1", s % 1 + "Sleeping for 5s", s % 2 + "[METRIC] p Fetched 7 comments", s % 3 + "[PROJECT_END] Finished p Status=Success", s % 4 + "Pausing for 60 seconds",
        s % 5 + "[PROJECT_START] Processing project 2", s % 6 + "Resetting scraper session", s % 7 + "[PROJECT_START] Processing project 3", s % 8 + "[PROJECT_END] Finished p Status=Success", "noise", s % 9 + "[ERROR] bad",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string")
    e = L.typed_events(df).withColumns({"log": F.lit("l"), "amount": F.col("detail").try_cast("int"), "status": F.col("detail")})
    assert e.count() == 10
    got = L.sessions(e, "log", ["ts", "n"]).withColumn("state", L.state()).orderBy("session").collect()
    assert [(r["state"], r["total_sleep"], r["metric"], r["was_reset"]) for r in got] == [("SOFT_BLOCK", 5, 7, 0), ("FAILED", 0, 0, 1), ("CLEAN", 0, 0, 0)]
    st = L.sessions(e, "log", ["ts", "n"]).withColumn("state", L.state())
    assert L.reset_efficacy(st, "log").first()[1:] == (1, 1)
    assert sum(r["n"] for r in L.run_chart(st, "log").collect()) == 3
    assert L.tipping_point(st, "log").first()["clean_streak"] == 0
    assert L.sessions(e.limit(0), "log", ["ts", "n"]).count() == 0


def test_report_without_cases(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (None, 0.5)], "y int, s double")
    c = V.confusion(df, F.col("y"), F.col("s"))
    assert c.first()[:] == (0, 0, 0, 2)
    r = {x["class"]: x for x in V.report(c).collect()}
    assert r["1"]["f1"] == 0.0 and r["0"]["f1"] == 1.0 and r["accuracy"]["f1"] == 1.0


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 400
    x, g, y0 = rng.normal(size=n) + 1e4, rng.integers(0, 3, n), rng.normal(size=n)
    y = 2 + 3 * (x - 1e4) + g * 0.5 + y0
    df = spark.createDataFrame([(float(a), str(int(b)), float(c)) for a, b, c in zip(x, g, y)] + [(None, "1", 1.0)], "x double, g string, y double")
    fit = E.ols(df, "y ~ x + C(g)")
    m = np.column_stack([np.ones(n), x, g == 1, g == 2])
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    s2 = ((y - m @ b) ** 2).sum() / (n - 4)
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * s2)
    assert fit.n == n and np.allclose(fit.coef[1:], b[1:], atol=1e-6) and np.allclose(fit.se[1:], se[1:], rtol=1e-4)
    two = E.ols(df.withColumn("x2", F.col("x") * 2), "y ~ x + x2")
    assert two.rank == 2  # rank-deficient: solved by the pseudo-inverse
    assert E.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and E.normal_p(1.96) == pytest.approx(0.04999579, abs=1e-7)
    assert E.terms("y ~ a*b + c:d + C(f)")[1] == [("a",), ("b",), ("C(f)",), ("a", "b"), ("c", "d")]
    d, z, p = E.slope_difference(fit, fit, "x")
    assert d == 0 and p == 1.0
    with pytest.raises(ValueError):
        E.ols(df.limit(0), "y ~ x")


def test_many_models_of_one_table_equal_each_alone(spark):
    """Missing values differ by variable, the flagged rows lack the factor's first level, products with far offsets."""
    rng = np.random.default_rng(4)
    n = 300
    a, b, g, h = rng.normal(size=n) + 50, rng.integers(0, 2, n), rng.integers(0, 3, n), rng.integers(1, 13, n)
    y, w = 1 + a * 0.3 + b * (a - 50) + g + rng.normal(size=n), rng.normal(size=n)
    flag = ((g > 0) & (rng.random(n) < 0.8)).astype(int)
    rows = [(float(a[i]) if i % 17 else None, int(b[i]), "uvw"[g[i]] if i % 29 else None, int(h[i]), float(y[i]), float(w[i]) if i % 5 else float("nan"), int(flag[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b int, g string, h int, y double, w double, flag int")
    models = [("one", "y ~ a*b", None), ("two", "y ~ a*b + w + C(g)", None), ("three", "y ~ a + C(g)", "flag"), ("four", "w ~ a + C(g):C(h)", None)]
    got = E.fit_all(df, models)

    def by_hand(y, cols, keep):
        m = np.column_stack([np.ones(keep.sum()), *[c[keep] for c in cols]]).astype(float)
        coef = np.linalg.pinv(m) @ y[keep]
        rank = np.linalg.matrix_rank(m)
        s2 = ((y[keep] - m @ coef) ** 2).sum() / (keep.sum() - rank)
        return coef, np.sqrt(np.diag(np.linalg.pinv(m.T @ m)) * s2), 1 - ((y[keep] - m @ coef) ** 2).sum() / ((y[keep] - y[keep].mean()) ** 2).sum()

    i = np.arange(n)
    has_a, has_g, has_w = i % 17 != 0, i % 29 != 0, i % 5 != 0
    for name, (cols, out, keep) in {
        "one": ([a, b, a * b], y, has_a), "two": ([a, b, w, g == 1, g == 2, a * b], y, has_a & has_g & has_w), "three": ([a, g == 2], y, has_a & has_g & (flag == 1)),
    }.items():
        coef, se, r2 = by_hand(out, cols, keep)
        f = got[name]
        assert f.n == keep.sum() and np.allclose(f.coef, coef, rtol=1e-5, atol=1e-7) and np.allclose(f.se, se, rtol=1e-4) and f.r2 == pytest.approx(r2, abs=1e-8), name
    coef, _, r2 = by_hand(w, [a, *[(g == x) & (h == z) for x in range(3) for z in range(1, 13)]], has_a & has_g & has_w)
    assert got["four"].coef[1] == pytest.approx(coef[1], rel=1e-5) and got["four"].r2 == pytest.approx(r2, abs=1e-8)
    table = {r["term"]: r for r in E.coefficient_table(E.ladder(df, models), [m[0] for m in models], ["a", "b", "a:b", "z"]).collect()}
    assert set(table) == {"a", "b", "a:b"} and table["a:b"]["one"].startswith("1.") and "***" in table["a:b"]["one"] and table["b"]["three"] == ""
    with pytest.raises(ValueError):
        E.fit_all(df.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("k", F.monotonically_increasing_id()), [("x", "y ~ C(k)", None)])


def test_mediation_is_the_same_in_other_partitions(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 2, 300)
    m = t + rng.normal(size=300)
    y = 2 * m + rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, m, y))], "i long, t double, m double, y double")
    a = E.mediation(df.repartition(2), "t", "m", "y", [], "i", draws=50).first()
    b = E.mediation(df.repartition(7), "t", "m", "y", [], "i", draws=50).first()
    assert np.allclose(a[:], b[:]) and a["low"] < a["acme"] < a["high"] and abs(a["acme"] - 2) < 0.7


def test_mediation_with_factors_and_paths(spark):
    rng = np.random.default_rng(5)
    n = 400
    t, g, post = rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    m = 0.5 * t + g + rng.normal(size=n)
    y = np.where(post == 1, -1.0, 2.0) * m + 0.3 * t - g + rng.normal(size=n) * 0.5
    rows = [(i, float(t[i]), float(m[i]), float(y[i]), "abc"[g[i]], int(post[i]), 1 - int(post[i])) for i in range(n)] + [(n, None, 1.0, 1.0, "a", 1, 0), (n + 1, 1.0, 1.0, 1.0, None, 1, 0)]
    df = spark.createDataFrame(rows, "i long, t double, m double, y double, g string, after int, before int")
    got = E.mediation(df.filter("after = 0"), "t", "m", "y", [], "i", draws=100, factors=("g",)).first()
    k = post == 0
    x = np.column_stack([np.ones(k.sum()), t[k], g[k] == 1, g[k] == 2]).astype(float)
    a = np.linalg.lstsq(x, m[k], rcond=None)[0][1]
    b = np.linalg.lstsq(np.column_stack([x, m[k]]), y[k], rcond=None)[0]
    assert got["acme"] == pytest.approx(a * b[4], rel=1e-6) and got["ade"] == pytest.approx(b[1], rel=1e-6) and got["low"] < got["acme"] < got["high"]
    p = {r["path"]: r for r in E.paths_compared(df, "t", "m", "y", "C(g)", ("before", "after")).collect()}
    assert p["a"]["before"] == pytest.approx(a, rel=1e-6) and p["b"]["before"] == pytest.approx(b[4], rel=1e-6)
    assert p["b"]["finding"] == "negative after" and p["a"]["finding"] == "no change found" and p["b"]["p_difference"] < 1e-6


def test_scores(spark):
    df = spark.createDataFrame([(1, "Good day. Bad, bad night! x"), (2, None), (3, " ")], "k int, text string")
    make = lambda: (lambda texts: [float(len(t)) for t in texts])
    got = {r["k"]: r["s"] for r in df.select("k", S.score_texts(F.col("text"), make).alias("s")).collect()}
    assert got == {1: 27.0, 2: 0.0, 3: 0.0}
    sent = {r["k"]: r for r in S.sentence_scores(df, "k", "text", lambda c: F.length(c).cast("double")).collect()}
    assert sent[1]["scores"] == [8.0, 14.0] and sent[2]["scores"] == [] and sent[2]["mean"] == 0.0
    lex = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("bad", -3.0)], "w string, s double")
    m = {r["k"]: r["mean_score"] for r in S.lexicon_mean(df, "k", "text", lex, "w", "s").collect()}
    assert m[1] == pytest.approx((2 - 1 - 3 - 1 - 3) / 5) and m[2] is None  # twice in the lexicon counts twice
    v = {r["k"]: r for r in S.sentiment(df, "k", "text", lex.limit(2), "w", "s").collect()}
    assert v[2]["compound"] == 0.0 and v[2]["neg"] == v[2]["pos"] == 0.0
    noisy = {r["k"]: r["text"] for r in S.noise(df, "k", "text", 0.5).collect()}
    assert len(noisy[1].split()) == 9 and noisy[2] is None and noisy == {r["k"]: r["text"] for r in S.noise(df.repartition(3), "k", "text", 0.5).collect()}


def test_temperature(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000) * 2
    y = rng.random(4000) < 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(0.0, float(a * 3), int(b)) for a, b in zip(z, y)], "z0 double, z1 double, y int").cache()
    assert S.fit_temperature(df, "z0", "z1", "y") == pytest.approx(3.0, rel=0.12)
    with pytest.raises(ValueError):
        S.fit_temperature(df.limit(0), "z0", "z1", "y")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\ntext', None), ("2", "", 3.5)], "id string, story_content string, v double")
    io.write_table(df, str(tmp_path / "t.csv"), "csv")
    back = io.read_csv(spark, str(tmp_path / "t.csv"), "id string, story_content string, v double").orderBy("id").collect()
    assert back[0]["story_content"] == 'a "quoted"\ntext' and back[1]["v"] == 3.5
    io.write_table(df, str(tmp_path / "t.parquet"), sample=1, order="id")
    assert io.read_any(spark, str(tmp_path / "t.parquet"), ["id"]).count() == 1
    with pytest.raises(ValueError):
        io.read_any(spark, str(tmp_path / "t.parquet"), ["nope"])
    (tmp_path / "done.txt").write_text("1\n\n 2 \n1\n")
    assert sorted(r["id"] for r in io.ids_of_checkpoint(spark, str(tmp_path / "done.txt")).collect()) == ["1", "2"]
    assert io.ids_of_checkpoint(spark, str(tmp_path / "missing.txt")).count() == 0
    assert [r["value"] for r in io.read_log(spark, str(tmp_path / "done.txt")).orderBy("file", "offset").collect()] == ["1", "", " 2 ", "1"]
    assert io.without_heavy(df).columns == ["id", "v"]
    s = spark.createDataFrame([("1", "Success", 0), ("2", "Success", 2), ("3", "Failed", 1), (None, "Success", 1)], "id string, status string, comments_count int")
    assert sorted(r["id"] for r in io.ids_with_data(s).collect()) == ["1", "2"] and [r["id"] for r in io.ids_with_data(s, "comments_count").collect()] == ["2"]
    f = io.failure_rows(df, "id", "story_content", F.lit("x"), F.repeat(F.lit("e"), 900))
    assert f.select(F.max(F.length("error_message"))).first()[0] == 500
    for _ in range(2):  # a batch written again replaces itself
        io.write_batch(df, f, s, str(tmp_path / "b"), "7")
    assert spark.read.parquet(str(tmp_path / "b" / "rows")).count() == 2


def test_nested_comments(spark):
    a = lambda n: {"name": n, "id": "u" + n}
    node = {"id": "c1", "body": "hi", "createdAt": 10, "author": a("x"), "replies": {"totalCount": 1, "edges": [{"node": {"id": "r1", "body": "yo", "createdAt": 20, "author": a("y")}}]}}
    schema = "project struct<id:string,name:string,comments:struct<totalCount:int,edges:array<struct<node:struct<id:string,body:string,createdAt:bigint,author:struct<name:string,id:string>,replies:struct<totalCount:int,edges:array<struct<node:struct<id:string,body:string,createdAt:bigint,author:struct<name:string,id:string>>>>>>>>>>"
    df = spark.createDataFrame([({"id": "p", "name": "n", "comments": {"totalCount": 1, "edges": [{"node": node}]}},)], schema)
    got = io.flatten_comments(df).collect()
    assert [(r["id"], r["parent_id"], r["author"]) for r in got] == [("c1", None, "x"), ("r1", "c1", "y")]


def test_charts(spark):
    df = spark.createDataFrame([("p", "<script>var a = [1, 2.5, null]; var b = [oops];</script>")], "k string, html string")
    r = io.chart_arrays(df, "html", ["a", "b"]).first()
    assert r["a"] == [1.0, 2.5, None] and r["b"] is None
    rows = '[["2024-01-0%d", "5", "9", "1", "2", "3", "%s"]]'
    chart = "[" + ",".join((rows % (i, t))[1:-1] for i, t in enumerate(["", "Trend: x", "", "", ""], 1)) + "]"
    df = spark.createDataFrame([("p", chart, True), ("q", '[["2024-01-01", null, "9"]]', False)], "k string, chart string, on boolean")
    got = io.funding_progress(df, "k", "chart", F.col("on")).orderBy("k", "pos").collect()
    assert [(r["k"], r["pos"], r["funds_raised"]) for r in got] == [("p", 0, 5.0), ("p", 2, 5.0), ("q", 0, 0.0)]
    assert spark.range(1).select(io.throttle_delay(F.lit(3), F.lit(True)).alias("d")).first()["d"] == 40.0


def test_incremental(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("body", T.StringType())])
    spark.createDataFrame([("1", "a b"), ("2", "c")], schema).write.parquet(src)
    step = lambda df: df.withColumn("n", X.word_count(F.col("body")))
    I.run_available(spark, src, schema, "id", step, out, cp)
    spark.createDataFrame([("2", "c"), ("3", "d e f")], schema).write.mode("append").parquet(src)
    I.run_available(spark, src, schema, "id", step, out, cp)
    got = spark.read.parquet(out).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [("1", 2), ("2", 1), ("3", 3)]


def test_windows_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "e")
    rows = [(dt.datetime(2024, 1, 1, 0, m), 1, 1.0) for m in (0, 10, 50)] + [(dt.datetime(2024, 1, 2), 1, 1.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(src)
    q = I.tumbling(stream, "ts", "1 hour", late="1 hour").writeStream.format("memory").queryName("qs_w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("qs_w").collect()) == [1, 3]


def test_months_and_batches(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), 1.0), (dt.date(2020, 3, 1), 3.0), (None, 9.0), (dt.date(2020, 3, 31), None)], "d date, v double")
    assert [(r["n"], r["mean"]) for r in B.monthly_mean(df, F.col("d"), F.col("v"), True).orderBy("month").collect()] == [(1, 1.0), (0, None), (1, 3.0)]
    assert B.monthly_mean(df, F.col("d"), F.col("v"), False).count() == 2
    b = B.batches(spark.range(25), "id", 10).groupBy("batch").count().orderBy("batch").collect()
    assert [(r["batch"], r["count"]) for r in b] == [(1, 10), (2, 10), (3, 5)]
    assert math.isclose(one(spark, None, B.log_floor(F.col("x"), True), "double"), 0.0) and one(spark, None, B.log_floor(F.col("x")), "double") is None


def test_mediation_before_and_after_apart(spark, data):
    got = QUERIES_TEXT["mediation_bootstrap"](spark, f"{data}/sf0.01").collect()
    assert sorted(r["post"] for r in got) == [0, 1]
    for r in got:
        assert r["low"] <= r["high"] and abs(r["p"] * 500 - round(r["p"] * 500)) < 1e-6  # steps of 2 in 1,000


def test_ladder_of_the_successful(spark, data):
    terms = {}
    for r in QUERIES_TEXT["ols_ladder"](spark, f"{data}/sf0.01").collect():
        terms.setdefault(r["model"], set()).add(r["term"])
    assert set(terms) == {f"{s}M{i}" for s in ("", "successful ") for i in range(1, 6)}
    four, five = terms["successful M4"], terms["successful M5"]
    assert {"indiegogo", "text_quality:PostGPT", "indiegogo:PostGPT"} <= four and "text_quality:indiegogo" not in four
    assert {"ai_score", "ai_score:PostGPT" if "ai_score:PostGPT" in five else "PostGPT:ai_score", "text_quality"} <= five and not any("indiegogo" in t for t in five)


@pytest.mark.parametrize("text,want", [
    ("2021-03-04T05:06:07Z", "2021-03-04 05:06:07"), ("2021-03-04 05:06:07", "2021-03-04 05:06:07"), ("2021-03-04T05:06:07.123456789+02:00", "2021-03-04 05:06:07.123456"), ("2021-03-04T05:06:07.250", "2021-03-04 05:06:07.25"), ("2021-03-04", "2021-03-04 00:00:00"),
    ("20210304T050607Z", "2021-03-04 05:06:07"), ("2021-03-04 05:06:07 -0500", "2021-03-04 05:06:07"), ("2021-03-04T05:06", "2021-03-04 05:06:00"), ("2021-13-04", None), ("1614834367", None), ("2021/03/04 05:06:07", None), ("N/A", None), (None, None),
])
def test_wall_clock_of_all_iso_forms(spark, text, want):
    df = spark.createDataFrame([(text,)], "created_at string")
    assert df.select(wall_clock_iso().cast("string").alias("t")).first()["t"] == want


def test_preparation_time_of_every_row(spark, tmp_path):
    rows = [
        (1, "s", "2021-03-04T05:06:07Z", 1614920767), (2, "s", "2021-03-04T05:06:07+02:00", 1614920767), (3, "s", "2021-03-04 05:06:07", 1614920767), (4, "s", "2021-03-04T05:06:07.250Z", 1614920767123),
        (5, "s", "N/A", 1614920767), (6, "s", None, 1614920767), (7, "s", "2021-03-04T05:06:07Z", None), (8, None, "2021-03-04 05:06:07", 1614920767), (9, None, "2021-03-06T05:06:08Z", 1614920767), (10, "s", "1614834367", 1614920766),
    ]
    spark.createDataFrame(rows, "row_id long, source_url string, created_at string, launched_at long").write.parquet(f"{tmp_path}/combined_all_columns.parquet")
    spark.createDataFrame([("s", "Asia/Tokyo", True)], "source_url string, time_zone string, day_first boolean").write.parquet(f"{tmp_path}/crawl_sources.parquet")
    got = {r["row_id"]: r["preparation_days"] for r in QUERIES_DATA["preparation_time"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: -2, 10: 0}


def test_amounts_are_rounded_as_in_sql(spark, data, tmp_path):
    nan, inf = float("nan"), float("inf")
    amounts = [1.27205, 0.26685, 0.36415, 16.00295, 49.12105, -2.70645, 0.00005, 0.12345, 2.5, 1e305, -1e305, inf, -inf, nan, None, 0.0, 450359962737.04955]
    rows = [(i, p, str(i), x, y) for i, (x, y) in enumerate(zip(amounts, reversed(amounts))) for p in ("Kickstarter", "Indiegogo")]
    given = spark.createDataFrame(rows, "row_id long, platform string, id string, pledged double, goal double")
    like = spark.read.parquet(f"{data}/sf0.001/combined_all_columns.parquet").limit(0)
    like.unionByName(given, allowMissingColumns=True).write.parquet(f"{tmp_path}/combined_all_columns.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW combined_all_columns AS SELECT * FROM '{tmp_path}/combined_all_columns.parquet/*.parquet'")
    text = lambda v: v if v is None else repr(v + 0.0)  # noqa: E731, NaN equals NaN, but not null
    want = con.execute(f"SELECT platform, id, pledged_amount, goal_amount FROM ({SQL_TABLES['standardize_union']})").fetchall()
    got = QUERIES_TABLES["standardize_union"](spark, str(tmp_path)).select("platform", "id", "pledged_amount", "goal_amount").collect()
    told = lambda rows: {(p, i): (text(x), text(y)) for p, i, x, y in rows}
    assert len(got) == len(want) == len(rows) and told(got) == told(want)
    assert told(got)["Kickstarter", "0"][0] == "1.272" and told(got)["Indiegogo", "13"][0] == "nan" and told(got)["Kickstarter", "14"][0] is None


def hot(spark, n=3000):
    """Rows of which a third has one key, with ties, nulls and repeats."""
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{rng.integers(0, 40)}", float(rng.integers(0, 50)) if i % 7 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i long, k string, v double").withColumn("_h", F.lit("clash")).drop("_h")


def test_ranks_quantiles_and_splits_with_a_hot_key(spark):
    rows, df = hot(spark)
    v = np.array([r[2] for r in rows if r[2] is not None])
    q = B.quantiles(df, F.col("v"), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).first()
    assert q["n"] == len(v) and np.allclose([q[f"q{i}"] for i in range(6)], np.quantile(v, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
    one = B.quantiles(df.withColumn("v", F.lit(4.0)), F.col("v"), [0.5]).first()
    assert one["q0"] == 4.0 and B.quantiles(df.limit(0), F.col("v"), [0.5]).first()[:] == (0, None)
    assert B.describe(df.limit(0), "v").first()["n"] == 0
    split = B.split_sample(df, "i", "k").collect()
    by = {}
    for r in split:
        by.setdefault(r["k"], []).append(r["part"])
    assert len(split) == len(rows) and all(p.count("train") == int(len(p) * 0.8) for p in by.values()) and None in by
    assert {r["i"]: r["part"] for r in split} == {r["i"]: r["part"] for r in B.split_sample(df.repartition(5), "i", "k").collect()}
    place = {r["i"]: r["place"] for r in B.shuffled(df, "i").collect()}
    assert sorted(place.values()) == list(range(1, len(rows) + 1)) and place != {r["i"]: r["place"] for r in B.shuffled(df, "i", 7).collect()}
    kept = {r["i"] for r in B.without_last(df, ["k"], [F.col("i")], "i", 2).collect()}
    for k in {r[1] for r in rows}:
        own = sorted(r[0] for r in rows if r[1] == k)
        assert kept & set(own) == set(own[:-2])
    first = {r["k"]: r["i"] for r in B.first_by(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for k in {r[1] for r in rows}:
        assert first[k] == min((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))[0]


def test_groups_are_limited_before_they_are_moved(spark):
    _, df = hot(spark, 30)
    plan = B.first_by(df, ["k"], [F.col("i")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_log_is_cut_into_spans(spark, monkeypatch):
    monkeypatch.setattr(L, "SPAN", 7)
    rng = np.random.default_rng(8)
    rows = [("log", i, str(rng.choice(["CLEAN", "SOFT_BLOCK", "FAILED"], p=[0.6, 0.3, 0.1])), int(rng.random() < 0.2)) for i in range(1, 200)]
    s = spark.createDataFrame(rows, "log string, session long, state string, was_reset int")
    got = sorted((r["run"], r["state"], r["n"]) for r in L.run_chart(s, "log").collect())
    want, last = [], None
    for _, _, state, _ in rows:
        if state != last:
            want.append([len(want) + 1, state, 0])
        want[-1][2] += 1
        last = state
    assert got == [tuple(w) for w in want]
    e = L.reset_efficacy(s, "log").first()
    resets = [i for i, r in enumerate(rows) if r[3]]
    worked = sum(bool(rows[i + 1 : i + 6]) and all(r[2] != "FAILED" for r in rows[i + 1 : i + 6]) for i in resets)
    assert (e["resets"], e["worked"]) == (len(resets), worked)
    assert L.run_chart(s.limit(0), "log").count() == 0


def test_lexicon_looked_up_or_joined_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Good day, bad night, good end"), (1, "bad"), (None, "good"), (2, None), (3, ""), (4, "word " * 30000)], "k int, text string")
    lex = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("Bad", -3.0), ("word", 0.0), (None, 1.0), ("x", None)], "w string, s double")
    run = lambda: (sorted(map(repr, S.lexicon_mean(df, "k", "text", lex, "w", "s").collect())), sorted(map(repr, S.sentiment(df, "k", "text", lex, "w", "s").collect())))
    small = run()
    monkeypatch.setattr(S, "SMALL_LEXICON", 1)
    assert small == run() and len(small[0]) == 6  # a row a row: keys that repeat or are null keep apart
    with pytest.raises(ValueError):
        S.sentiment_rules(df, "k", "text", lex, "w", "s")


def test_sentiment_rules(spark):
    words = {"good": 1.9, "great": 3.1, "bad": -2.5, "love": 3.2}
    c = lambda t: S.rule_sentiment(t, words)[3]
    assert c("It is good") == pytest.approx(1.9 / (1.9**2 + 15) ** 0.5) and c("") == c(None) == c("a lamp") == 0.0
    assert c("It is very good") > c("It is good") > c("It is slightly good") > 0 > c("It is not good")
    assert c("It is GOOD today") > c("It is good today") and c("It is good!!!") > c("It is good!") > c("It is good")
    assert c("It is great, but the box is bad") < 0 and c("I don't love it") < 0
    for t in ("It is good", "bad lamp?? really", "not bad but good!"):
        neg, neu, pos, comp = S.rule_sentiment(t, words)
        assert neg + neu + pos == pytest.approx(1) and -1 <= comp <= 1
    lex = spark.createDataFrame(list(words.items()), "w string, s double")
    got = S.sentiment_rules(spark.createDataFrame([(1, "It is good"), (1, None)], "k int, text string"), "k", "text", lex, "w", "s").collect()
    assert sorted(r["compound"] for r in got) == [0.0, round(1.9 / (1.9**2 + 15) ** 0.5, 6)]


def test_sentences_by_expression_and_by_model(spark):
    df = spark.createDataFrame([(1, "One two three. Four five! x"), (1, "Six seven eight."), (None, None), (2, " ")], "k int, text string")
    a = S.sentence_scores(df, "k", "text", lambda c: F.length(c) * 1.0)
    b = S.sentence_model_scores(df, "k", "text", lambda: lambda texts: [float(len(t)) for t in texts], batch=2)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() == 4


def test_repeated_sentences_by_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [". ".join(" ".join(rng.choice(list("abcdefghijkl"), rng.integers(1, 9))) for _ in range(n)) + ". " for n in (1, 2, 30, 120)] + [None, "", "a b. a b. c d. "]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.repetition(F.col("t")).alias("r")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        sets = [set(s.replace(".", " ").split()) for s in t.split(". ") if s.strip()]
        like = sum(bool(a | b) and len(a & b) > 0.5 * len(a | b) for j, a in enumerate(sets) for b in sets[j + 1 :])
        assert got[i] == pytest.approx(like / len(sets) if len(sets) > 1 else 0.0)


def test_files_that_give_no_row_and_raw_files_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("id,v\n")
    df = io.read_csv(spark, f"{tmp_path}/*.csv", "id string, v string")
    assert [r["file"].rsplit("/", 1)[1] for r in io.files_without_rows(spark, f"{tmp_path}/*.csv", df).collect()] == ["b.csv"]
    assert dict(io.read_csv(spark, f"{tmp_path}/*.csv").dtypes) == {"id": "string", "v": "string"} and dict(io.read_csv(spark, f"{tmp_path}/*.csv", infer=True).dtypes)["v"] == "int"
    rows = spark.createDataFrame([(1, "x_sentiment_.csv"), (2, "x.csv"), (3, None)], "i int, f string")
    assert sorted(r["i"] for r in io.prefer_raw(rows, F.col("f")).collect()) == [2, 3]
    assert [r["i"] for r in io.prefer_raw(rows.filter("i = 1"), F.col("f")).collect()] == [1] and io.prefer_raw(rows.limit(0), F.col("f")).count() == 0


def test_quality_falls_back(spark):
    t = "We we made it,and it is is good ."
    df = spark.createDataFrame([(t,)], "t string")
    c = F.col("t")
    r = df.select(X.text_quality(c, X.issue_count(c)).alias("a"), X.grammar_quality(c).alias("b"), X.text_quality(c).alias("c"), X.simple_quality(c).alias("d"), X.text_quality(c, X.issue_count(c), use_simple=True).alias("e")).first()
    assert r["a"] == r["b"] and r["c"] == r["d"] == r["e"]


def test_no_machine_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from quillspark.session import ensure_checkpoint_dir, parts_of

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, v=None: v), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)
    cluster.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)
    assert parts_of(spark.range(10), 4) == 3 and parts_of(spark.range(0), 4) == 1
