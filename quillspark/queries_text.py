"""Queries over texts: measures, lexicons, scores, logs, evaluation, models, windows; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import econometrics as E
from .operators import evaluation as V
from .operators import eventlog as L
from .operators import scoring as S
from .operators import tables as T
from .operators import windows as W
from .plans import pipelines as P
from .queries_data import QUERIES as QUERIES_DATA
from .queries_tables import _GOAL, _WALL, nn, pid, wall_clock_iso
from .session import saved, ship_package, spread
from .session import table as read_table
from .sources import io
from .streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
q = lambda s: s.replace("'", "''")
WS, TOKEN, BREAK = X.WS, q(X.TOKEN), q(X.SENTENCE_BREAK)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one of texts is spread over all cores, as its queries work more than they read."""
    df = read_table(spark, d, name)
    return spread(df) if name in ("documents", "updates", "comments", "combined_all_columns") else df


def query(sql: str | None = None, queries: dict = QUERIES, sqls: dict = SQL) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        queries[f.__name__] = f
        if sql:
            sqls[f.__name__] = sql
        return f

    return add


def _words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}'), lambda x: x <> '')"


def _stops(t: str) -> str:
    return f"greatest(len(list_filter(string_split({t}, '.'), lambda x: regexp_replace(x, '{WS}', '', 'g') <> '')), 1)"


def _sents(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{BREAK}'), lambda x: regexp_replace(x, '{WS}', '', 'g') <> '')"


@query(f"SELECT doc_id, CAST(coalesce(len({_words('text')}), 0) AS INTEGER) AS n_words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    """Words between white space."""
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


def _quality(t: str) -> str:
    return f"""CASE WHEN coalesce(len({_words(t)}), 0) > 0 THEN least(1.0::DOUBLE, list_sum(list_transform({_words(t)}, lambda x: length(trim(x, '.,!?'))))::DOUBLE / len({_words(t)}) / 10.0::DOUBLE
 * (least(len({_words(t)})::DOUBLE / {_stops(t)}, 20.0::DOUBLE) / 20.0::DOUBLE)) ELSE 0.0::DOUBLE END"""


@query(f"SELECT doc_id, round({_quality('text')}, 9) AS quality FROM documents")
def simple_quality(spark: SparkSession, d: str) -> DataFrame:
    """D2, D4."""
    return table(spark, d, "documents").select("doc_id", F.round(X.simple_quality(F.col("text")), 9).alias("quality"))


_ISSUES = " + ".join(f"len(regexp_extract_all(text, '{q(r)}'))" for r in X.GRAMMAR_RULES)


@query(f"SELECT doc_id, CASE WHEN len({_words('text')}) > 0 THEN round(1.0::DOUBLE - ({_ISSUES})::DOUBLE / len({_words('text')}), 9) END AS quality FROM documents")
def grammar_quality(spark: SparkSession, d: str) -> DataFrame:
    """D3: a plain set of rules counts the issues."""
    return table(spark, d, "documents").select("doc_id", F.round(X.grammar_quality(F.col("text")), 9).alias("quality"))


_STOP = ["the", "of", "and", "to", "a", "in", "is", "it", "for", "we", "you", "that", "with", "on", "our", "as", "are", "be", "this", "will"]
_STOPS = "(" + ", ".join(f"'{w}'" for w in _STOP) + ")"
_FORMAL = "(" + ", ".join(f"'{w}'" for w in X.FORMAL) + ")"
_SYL = "greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1)"


def _features(src: str, key: str, t: str) -> str:
    return f"""b AS (SELECT {key}, {t} AS text, coalesce(regexp_replace({t}, '{WS}', '', 'g') = '', true) AS blank, regexp_extract_all({t}, '{TOKEN}') AS tok, regexp_extract_all(lower({t}), '{TOKEN}') AS low,
 {_sents(t)} AS sents, regexp_extract_all({t}, '{q(X.WORD)}') AS w FROM {src}), f0 AS (SELECT *, len(tok) AS nt, len(low) AS nl, len(sents) AS ns, len(w)::DOUBLE AS nw, greatest(len(sents), 1)::DOUBLE AS ns1,
 coalesce(list_sum(list_transform(w, lambda x: {_SYL})), 0)::DOUBLE AS syl, len(list_filter(w, lambda x: {_SYL} >= 3))::DOUBLE AS hard, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS wc FROM b),
 f1 AS (SELECT {key}, text, blank, CASE WHEN blank THEN 0 ELSE nt END AS word_count, CASE WHEN blank THEN 0 ELSE ns END AS sentence_count, CASE WHEN blank THEN 0 ELSE length(text) END AS char_count,
 CASE WHEN blank OR ns = 0 THEN 0.0::DOUBLE ELSE nt::DOUBLE / ns END AS avg_sentence_length, CASE WHEN blank OR nt = 0 THEN 0.0::DOUBLE ELSE length(text)::DOUBLE / nt END AS avg_word_length,
 CASE WHEN blank OR nw = 0 THEN 0.0::DOUBLE ELSE 206.835::DOUBLE - 1.015::DOUBLE * (nw / ns1) - 84.6::DOUBLE * (syl / nw) END AS flesch_reading_ease,
 CASE WHEN blank OR nw = 0 THEN 0.0::DOUBLE ELSE 0.39::DOUBLE * (nw / ns1) + 11.8::DOUBLE * (syl / nw) - 15.59::DOUBLE END AS flesch_kincaid_grade,
 CASE WHEN blank OR nw = 0 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE * (nw / ns1 + 100.0::DOUBLE * (hard / nw)) END AS gunning_fog,
 CASE WHEN blank OR nw = 0 THEN 0.0::DOUBLE ELSE 4.71::DOUBLE * (wc / nw) + 0.5::DOUBLE * (nw / ns1) - 21.43::DOUBLE END AS automated_readability_index,
 CASE WHEN blank OR nl = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(low))::DOUBLE / nl END AS lexical_diversity,
 CASE WHEN blank OR nl = 0 THEN 0.0::DOUBLE ELSE len(list_filter(low, lambda x: x IN {_STOPS}))::DOUBLE / nl END AS stop_word_ratio,
 CASE WHEN blank OR nl = 0 THEN 0.0::DOUBLE ELSE len(list_filter(low, lambda x: x IN {_FORMAL}))::DOUBLE / nl END AS formality_score,
 """ + ", ".join(f"CASE WHEN blank THEN 0.0::DOUBLE ELSE (length(text) - length(replace(text, '{c}', '')))::DOUBLE / length(text) END AS {n}_ratio" for c, n in (("!", "exclamation"), ("?", "question"), (",", "comma"))) + f""",
 CASE WHEN blank THEN 0 ELSE {' + '.join(f"CAST(contains(lower(text), '{q(p)}') AS INTEGER)" for p in X.PHRASES)} END AS ai_phrases_count,
 list_transform(sents, lambda s: list_sort(list_distinct(regexp_extract_all(lower(s), '{TOKEN}')))) AS sets FROM f0)"""


def _repetition(key: str) -> str:
    return f"""p AS (SELECT {key}, unnest(sets) AS s, generate_subscripts(sets, 1) AS i FROM f1 WHERE NOT blank AND len(sets) >= 2),
 r AS (SELECT a.{key}, count(*) AS c FROM p a JOIN p b ON a.{key} = b.{key} AND a.i < b.i WHERE len(list_intersect(a.s, b.s)) * 2 > len(list_distinct(list_concat(a.s, b.s))) GROUP BY 1),
 f AS (SELECT f1.*, CASE WHEN blank OR len(sets) < 2 THEN 0.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE / len(sets) END AS repetition_score FROM f1 LEFT JOIN r ON f1.{key} = r.{key})"""


_COUNTS = ["word_count", "sentence_count", "char_count", "ai_phrases_count"]
_RATIOS = ["avg_sentence_length", "avg_word_length", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "automated_readability_index", "lexical_diversity", "stop_word_ratio", "exclamation_ratio", "question_ratio", "comma_ratio", "repetition_score", "formality_score"]


def _featured(df: DataFrame, key: str, text: str) -> DataFrame:
    x = X.text_arrays(df.select(key, text), F.col(text))
    return x.select(key, *[v.alias(k) for k, v in X.linguistic_features(F.col(text), _STOP).items()])


@query()
def linguistic_features(spark: SparkSession, d: str) -> DataFrame:
    """The seventeen features of each document."""
    ship_package(spark)
    f = _featured(table(spark, d, "documents"), "doc_id", "text")
    return f.select("doc_id", *_COUNTS, *[F.round(c, 6).alias(c) for c in _RATIOS])


SQL["linguistic_features"] = f"WITH {_features('documents', 'doc_id', 'text')}, {_repetition('doc_id')} SELECT doc_id, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _COUNTS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS) + " FROM f"
_SCORE = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN flesch_reading_ease BETWEEN 30 AND 70 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN lexical_diversity BETWEEN 0.3 AND 0.7 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN avg_sentence_length BETWEEN 15 AND 25 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN formality_score > 0.02 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN ai_phrases_count > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN repetition_score < 0.1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN exclamation_ratio + question_ratio BETWEEN 0.01 AND 0.05 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = _featured(table(spark, d, "documents"), "doc_id", "text")
    return f.select("doc_id", X.ai_score({c: F.col(c) for c in f.columns}).alias("ai_score"))


@query(f"WITH {_features('documents', 'doc_id', 'text')}, {_repetition('doc_id')} SELECT doc_id, round({_SCORE}, 6) AS ai_score FROM f")
def ai_score(spark: SparkSession, d: str) -> DataFrame:
    """D14."""
    ship_package(spark)
    return _scored(spark, d).select("doc_id", F.round("ai_score", 6).alias("ai_score"))


@query(f"""WITH {_features('documents', 'doc_id', 'text')}, {_repetition('doc_id')}, s AS (SELECT round({_SCORE}, 6) AS a FROM f)
SELECT CASE WHEN a > 0.7 THEN 'high' WHEN a >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(a), 6) AS mean FROM s GROUP BY 1""")
def ai_score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by bucket of their score."""
    ship_package(spark)
    s = _scored(spark, d).select(F.round("ai_score", 6).alias("a"))
    return s.groupBy(X.score_bucket(F.col("a")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"))


@query(f"WITH {_features('documents', 'doc_id', 'text')}, {_repetition('doc_id')} SELECT doc_id, round(repetition_score, 9) AS repetition FROM f")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of like sentences."""
    ship_package(spark)
    x = table(spark, d, "documents")
    blank = F.coalesce(~X.holds_text(F.col("text")), F.lit(True))
    return x.select("doc_id", F.round(F.when(blank, 0.0).otherwise(X.repetition(F.col("text"))), 9).alias("repetition"))


_LEX = "SELECT lower(word) AS w, CAST(length(word) AS DOUBLE) / 2 AS s FROM common_words WHERE lang = 'en'"


def _alpha(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '{X.ALPHA}'), lambda x: regexp_matches(x, '^[a-z]+$'))"



@query(f"""WITH t AS (SELECT doc_id, unnest({_alpha('text')}) AS w FROM documents), l AS ({_LEX}), g AS (SELECT doc_id, avg(s) AS m, count(*) AS h FROM t JOIN l USING (w) GROUP BY 1)
SELECT d.doc_id, round(m, 6) AS mean_score, CAST(h AS BIGINT) AS hits FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON d.doc_id = g.doc_id""")
def concreteness(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of a text's words in a lexicon."""
    lex = table(spark, d, "common_words").filter("lang = 'en'").withColumn("s", F.length("word") / 2.0)
    return S.lexicon_mean(table(spark, d, "documents"), "doc_id", "text", lex, "word", "s").withColumn("mean_score", F.round("mean_score", 6))


_MOOD = {"love": 3.0, "good": 2.0, "great": 3.0, "thank": 1.5, "thanks": 1.5, "nice": 2.0, "happy": 2.5, "bad": -2.5, "broken": -2.0, "late": -1.0, "sorry": -1.0, "never": -1.5, "problem": -2.0, "wrong": -2.0, "refund": -1.5}
_MOODS = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _MOOD.items()) + ") m(w, s)"


@query(f"""WITH c AS (SELECT DISTINCT id, body FROM comments), t AS (SELECT id, unnest({_alpha('body')}) AS w FROM c), g AS (SELECT id, sum(coalesce(s, 0)) AS s, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS p, sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS n,
 count_if(coalesce(s, 0) = 0)::DOUBLE AS u FROM t LEFT JOIN {_MOODS} USING (w) GROUP BY 1)
SELECT c.id, round(coalesce(n / nullif(p + n + u, 0), 0), 6) AS neg, round(coalesce(u / nullif(p + n + u, 0), 0), 6) AS neu, round(coalesce(p / nullif(p + n + u, 0), 0), 6) AS pos, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound FROM c LEFT JOIN g ON c.id = g.id""")
def sentiment_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Shares and compound of a lexicon's moods."""
    lex = spark.createDataFrame(list(_MOOD.items()), "w string, s double")
    return S.sentiment(table(spark, d, "comments").select("id", "body").distinct(), "id", "body", lex, "w", "s")


@query()
def sentiment_rules(spark: SparkSession, d: str) -> DataFrame:
    """The published rules (negation, boosters, capitals, marks) over a lexicon; without SQL, tested on examples."""
    lex = spark.createDataFrame(list(_MOOD.items()), "w string, s double")
    return S.sentiment_rules(table(spark, d, "comments").select("id", "body"), "id", "body", lex, "w", "s")


_KEPT = f"list_filter(list_transform({_sents('body')}, lambda x: trim(x)), lambda x: length(x) >= 6)"


@query(f"""WITH u AS (SELECT DISTINCT id, body FROM updates), s AS (SELECT id, unnest({_KEPT}) AS s FROM u), g AS (SELECT id, avg(least(length(s) / 200.0::DOUBLE, 1.0::DOUBLE)) AS a, median(least(length(s) / 200.0::DOUBLE, 1.0::DOUBLE)) AS b, max(least(length(s) / 200.0::DOUBLE, 1.0::DOUBLE)) AS c, count(*) AS n FROM s GROUP BY 1)
SELECT u.id, coalesce(round(a, 6), 0) AS mean, coalesce(round(b, 6), 0) AS median, coalesce(round(c, 6), 0) AS largest, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences FROM u LEFT JOIN g ON u.id = g.id""")
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    """A plain scorer's scores of each text's sentences."""
    u = table(spark, d, "updates").select("id", "body").distinct()
    s = S.sentence_scores(u, "id", "body", lambda c: F.least(F.length(c) / 200.0, F.lit(1.0)))
    return s.select("id", *[F.round(c, 6).alias(c) for c in ("mean", "median", "largest")], F.size("scores").alias("n_sentences"))


@query(rf"""SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS lines, substr(body, 1, 100) AS preview,
 trim(replace(title, chr(160), ' ')) AS title FROM updates""")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines, previews, no-break spaces."""
    u = table(spark, d, "updates")
    return u.select("id", X.normalise_lines(F.col("body")).alias("lines"), F.substring("body", 1, 100).alias("preview"), X.clean_nbsp(F.col("title")).alias("title")).distinct()


# A page is put around each body, as the tables hold none: nested tags, a script, a frame, an image, entities.
_PAGE = ("<div class=\"story-content rte\"><p>", "</p><script type=\"x\">var a = '<b>';</script><div><b>Rock &amp; roll</b> &lt;3&nbsp;</div><iframe src=\"v\"></iframe><img src=\"x.png\"></div>")
_HTML = f"'{q(_PAGE[0])}' || body || '{q(_PAGE[1])}'"
_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_CUT = r"regexp_replace({}, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g')"
_MARKED = r"regexp_replace(regexp_replace({}, '(?i)<img\b[^>]*>', ' [IMAGE] ', 'g'), '(?is)<iframe\b[^>]*>(.*?</iframe>)?', ' [EMBED] ', 'g')"
_BARE = "regexp_replace({}, '<[^>]+>', chr(10), 'g')"


def _page(body: str) -> Column:
    return F.concat(F.lit(_PAGE[0]), F.col(body), F.lit(_PAGE[1]))


@query(f"SELECT id, array_to_string(list_filter(list_transform(string_split({_ENTITIES.format(_BARE.format(_MARKED.format(_CUT.format(_HTML))))}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM updates")
def html_body_clean(spark: SparkSession, d: str) -> DataFrame:
    """O3: scripts, tags, images, frames and entities of every body; null stays null."""
    return table(spark, d, "updates").select("id", X.clean_body(_page("body")).alias("body"))


@query(rf"""SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract({_HTML}, '(?is)<div[^>]*class="[^"]*\bstory-content\b[^"]*"[^>]*>(.*)</div>', 1), '(?is)<(script|style|iframe)\b.*?</(script|style|iframe)>', '', 'g'), '<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS story FROM updates""")
def story_extract(spark: SparkSession, d: str) -> DataFrame:
    """The text of the story's div out of a page."""
    return table(spark, d, "updates").select("id", X.story_text(_page("body")).alias("story"))


@query(f"""WITH p AS (SELECT id, number, unnest(generate_series(1, number)) AS i FROM (SELECT DISTINCT id, number FROM updates WHERE number BETWEEN 1 AND 12)), k AS (SELECT *, row_number() OVER (PARTITION BY id, number ORDER BY i DESC) AS left_ FROM p WHERE NOT (number % 2 = 0 AND i % 3 = 0))
SELECT id, CAST(i - 1 AS INTEGER) AS pos, i * 10.5::DOUBLE AS funds_raised, 100.0::DOUBLE AS goal, CASE WHEN number % 2 = 0 THEN CAST(i AS DOUBLE) ELSE 0.0::DOUBLE END AS trend FROM k WHERE number % 2 = 1 OR left_ > 2""")
def funding_chart(spark: SparkSession, d: str) -> DataFrame:
    """Charts of JSON rows (made of the updates' numbers), seven columns while they run."""
    u = table(spark, d, "updates").filter(F.col("number").between(1, 12)).select("id", "number").distinct()
    on = F.col("number") % 2 == 0
    short = lambda i: F.array(F.lit("2024-01-01"), (i * F.lit(10.5)).cast("string"), F.lit("100"))
    long = lambda i: F.concat(short(i), F.array(i.cast("string"), F.lit("1"), F.lit("x"), F.when(i % 3 == 0, "Trending: up").otherwise("Raised")))
    c = u.select(F.struct("id", "number").alias("id"), on.alias("on"), F.to_json(F.transform(F.sequence(F.lit(1), F.col("number")), lambda i: F.when(on, long(i)).otherwise(short(i)))).alias("chart"))
    return io.funding_progress(c, "id", "chart", F.col("on")).select("id.id", "pos", "funds_raised", "goal", "trend")


@query(f"SELECT doc_id, CASE WHEN len({_words('text')}) > 0 THEN round(1.0::DOUBLE - ({_ISSUES})::DOUBLE / len({_words('text')}), 9) END AS with_checker, round({_quality('text')}, 9) AS without_checker, round({_quality('text')}, 9) AS asked_simple FROM documents")
def quality_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The grammar's quality, or the simple one where no checker is at hand or if asked."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.round(X.text_quality(t, X.issue_count(t)), 9).alias("with_checker"), F.round(X.text_quality(t), 9).alias("without_checker"), F.round(X.text_quality(t, X.issue_count(t), use_simple=True), 9).alias("asked_simple"),
    )


@query(f"""SELECT last_day(o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n, round(avg({_quality('text')}), 6) AS mean FROM documents JOIN orders ON doc_id = o_orderkey GROUP BY 1""")
def simple_quality_by_month(spark: SparkSession, d: str) -> DataFrame:
    """The monthly mean quality of texts (the flagship)."""
    j = table(spark, d, "documents").join(table(spark, d, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    return T.monthly_mean(j, F.col("o_orderdate"), X.simple_quality(F.col("text")), False)


@query(f"""WITH p AS (SELECT DISTINCT {pid('id')} AS project FROM combined_all_columns WHERE regexp_matches(project_url, '(?i)ks.example')), f AS (SELECT DISTINCT {pid('project_id')} AS k FROM scrape_failures WHERE error_stage = 'updates'),
 u AS (SELECT DISTINCT id, body, {pid('project_id')} AS project FROM updates), s AS (SELECT id, avg(least(length(x) / 200.0::DOUBLE, 1.0::DOUBLE)) AS m FROM (SELECT id, unnest({_KEPT}) AS x FROM u) GROUP BY 1)
SELECT u.id, project, CAST(coalesce(len({_words('body')}), 0) AS INTEGER) AS n_words, round({_quality('body')}, 9) AS quality, coalesce(round(m, 6), 0) AS sentence_mean FROM u LEFT JOIN s ON u.id = s.id
WHERE project IN (SELECT project FROM p WHERE project IS NOT NULL) AND project NOT IN (SELECT k FROM f WHERE k IS NOT NULL)""")
def updates_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """E-1, F6-F9, G5, E8: the updates of projects that aren't done, each once, with its features."""
    done = table(spark, d, "scrape_failures").filter("error_stage = 'updates'")
    return P.updates_pipeline(table(spark, d, "combined_all_columns"), table(spark, d, "updates"), done, lambda c: F.least(F.length(c) / 200.0, F.lit(1.0)))


# ---- an event log (L): START, END, SLEEP, METRIC, ERROR and RESET told by the type of an event
_KIND = "CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'END' WHEN 'click' THEN 'SLEEP' WHEN 'error' THEN 'ERROR' ELSE CASE WHEN k % 10 = 0 THEN 'RESET' ELSE 'METRIC' END END"
_LOG = f"""e AS (SELECT user_id, ts, event_id, {_KIND} AS kind, value AS amount, CASE WHEN k % 4 = 0 THEN 'Failed' ELSE 'Success' END AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
 n AS (SELECT *, sum(CAST(kind = 'START' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e),
 a AS (SELECT *, coalesce(max(CAST(kind = 'END' AS INTEGER)) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_ FROM n WHERE session > 0),
 s AS (SELECT user_id, CAST(session AS BIGINT) AS session, count_if(kind = 'SLEEP') AS sleeps, count_if(kind = 'ERROR') AS errors, coalesce(sum(CASE WHEN kind = 'METRIC' THEN amount END), 0) AS metric, coalesce(max(CASE WHEN kind = 'RESET' THEN 1 END), 0) AS was_reset,
 coalesce(max(CASE WHEN kind = 'END' THEN status END), 'Unknown') AS status, coalesce(sum(CASE WHEN kind = 'SLEEP' THEN amount END), 0) AS total_sleep, coalesce(max(CASE WHEN kind = 'SLEEP' THEN amount END), 0) AS longest_sleep,
 min(CASE WHEN kind = 'START' THEN ts END) AS start_ts, max(CASE WHEN kind = 'END' THEN ts END) AS end_ts FROM a WHERE after_ = 0 GROUP BY 1, 2),
 st AS (SELECT *, CASE WHEN status <> 'Success' THEN 'FAILED' WHEN total_sleep = 0 THEN 'CLEAN' WHEN longest_sleep >= 60 OR total_sleep >= 60 THEN 'HARD_BLOCK' ELSE 'SOFT_BLOCK' END AS state FROM s)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind = F.when(F.col("event_type") == "signup", "START").when(F.col("event_type") == "purchase", "END").when(F.col("event_type") == "click", "SLEEP").when(F.col("event_type") == "error", "ERROR")
    kind = kind.otherwise(F.when(F.col("k") % 10 == 0, "RESET").otherwise("METRIC"))
    e = e.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("value").alias("amount"), F.when(F.col("k") % 4 == 0, "Failed").otherwise("Success").alias("status"))
    return L.sessions(e, "user_id", ["ts", "event_id"]).withColumn("state", L.state())


_SAID = "CASE event_type WHEN 'signup' THEN concat('[PROJECT_START] Processing project ', user_id) WHEN 'purchase' THEN concat('[PROJECT_END] Finished it. Status=', CASE WHEN event_id % 2 = 0 THEN 'Success' ELSE 'Failed' END) WHEN 'click' THEN concat('Sleeping for ', CAST(floor(value) AS BIGINT), ' seconds') WHEN 'error' THEN concat('[ERROR] no answer ', event_id) ELSE CASE WHEN event_id % 3 = 0 THEN concat('[METRIC] it: Fetched ', event_id, ' comments') WHEN event_id % 3 = 1 THEN 'Resetting scraper session' ELSE 'nothing to tell' END END"


@query("""SELECT event_id, date_trunc('second', ts) AS ts, CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'END' WHEN 'click' THEN 'SLEEP' WHEN 'error' THEN 'ERROR' ELSE CASE WHEN event_id % 3 = 0 THEN 'METRIC' ELSE 'RESET' END END AS kind,
 CASE event_type WHEN 'signup' THEN CAST(user_id AS VARCHAR) WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Success' ELSE 'Failed' END WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 'error' THEN 'no answer ' || event_id ELSE CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END END AS detail
FROM events WHERE NOT (event_type = 'view' AND event_id % 3 = 2)""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a log (made of the events) as typed events; lines of no kind are dropped."""
    e = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - INFO - "), F.expr(_SAID)).alias("value"))
    return L.typed_events(e).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "detail")


@query(f"WITH {_LOG} SELECT user_id, session, CAST(sleeps AS BIGINT) AS sleeps, CAST(errors AS BIGINT) AS errors, round(metric, 4) AS metric, was_reset, status, round(total_sleep, 4) AS total_sleep, longest_sleep, start_ts, end_ts, state FROM st")
def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    """L1-L4: sessions of a log and their states."""
    return _sessions(spark, d).withColumns({"metric": F.round("metric", 4), "total_sleep": F.round("total_sleep", 4)})


@query(f"""WITH {_LOG}, l AS (SELECT user_id, session, state, CAST(state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY session) AS INTEGER) AS new FROM st), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY session) AS run FROM l)
SELECT user_id, CAST(run AS BIGINT) AS run, min(state) AS state, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def log_run_chart(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal states."""
    return L.run_chart(_sessions(spark, d), "user_id")


@query(f"""WITH {_LOG}, g AS (SELECT user_id, was_reset, coalesce(min(CAST(state IN ('CLEAN', 'SOFT_BLOCK') AS INTEGER)) OVER (PARTITION BY user_id ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS good FROM st)
SELECT user_id, CAST(count(*) AS BIGINT) AS resets, CAST(sum(good) AS BIGINT) AS worked FROM g WHERE was_reset = 1 GROUP BY 1""")
def log_reset_efficacy(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sessions after a reset went well."""
    return L.reset_efficacy(_sessions(spark, d), "user_id")


@query(f"""WITH {_LOG}, t AS (SELECT user_id, min(CASE WHEN state <> 'CLEAN' THEN session END) AS first_bad FROM st GROUP BY 1), c AS (SELECT st.user_id, count_if(session < first_bad OR first_bad IS NULL) AS k, max(first_bad) AS first_bad,
 arg_max(epoch_us(end_ts), session) FILTER (session < first_bad OR first_bad IS NULL) AS e, arg_min(epoch_us(start_ts), session) FILTER (session < first_bad OR first_bad IS NULL) AS b FROM st JOIN t USING (user_id) GROUP BY 1),
 r AS (SELECT user_id, k, (e / 1e6 - b / 1e6) AS dur, CASE WHEN k > 1 AND first_bad IS NOT NULL AND e > b THEN k / ((e / 1e6 - b / 1e6) / 60) END AS rpm FROM c)
SELECT user_id, CAST(k AS BIGINT) AS clean_streak, round(rpm, 6) AS clean_rpm, round(60 / (rpm * 0.8::DOUBLE), 6) AS target_s, round(CASE WHEN rpm IS NOT NULL THEN greatest(0.5::DOUBLE, 60 / (rpm * 0.8::DOUBLE) - dur / k + 1.0) END, 6) AS added_sleep_s FROM r""")
def log_tipping_point(spark: SparkSession, d: str) -> DataFrame:
    """The clean streak and the speed advised."""
    return L.tipping_point(_sessions(spark, d), "user_id")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, round(epoch(max(ts) - min(ts)) / 3600, 6) AS hours, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS total_sleep FROM events GROUP BY 1")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events, hours and sleep of each log."""
    e = table(spark, d, "events")
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return e.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.round((secs(F.max("ts")) - secs(F.min("ts"))) / 3600, 6).alias("hours"),
        F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)), 4).alias("total_sleep"),
    )


@query("SELECT CAST(floor(value) AS BIGINT) AS seconds, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def log_sleep_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Sleeps by their length."""
    return table(spark, d, "events").filter("event_type = 'click'").groupBy(F.floor("value").cast("bigint").alias("seconds")).agg(F.count("*").alias("n"))


# ---- evaluation (M): the label is the embedding's sign in one dimension, the score another's
_EV = "(SELECT CAST(label % 2 = 0 AS INTEGER) AS y, 1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))) AS s FROM embeddings)"
_CONF = f"SELECT CAST(count_if(y = 1 AND s >= 0.5) AS BIGINT) AS tp, CAST(count_if(y = 0 AND s >= 0.5) AS BIGINT) AS fp, CAST(count_if(y = 1 AND s < 0.5) AS BIGINT) AS fn, CAST(count_if(y = 0 AND s < 0.5) AS BIGINT) AS tn FROM {_EV}"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.confusion(e, F.col("label") % 2 == 0, 1 / (1 + F.exp(-10 * F.col("embedding")[0].cast("double"))))


@query(_CONF)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """M, B19: the confusion matrix."""
    return _confusion(spark, d)


@query(f"""WITH c AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM ({_CONF})), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, tp + fn AS s1, tn + fp AS s0 FROM c),
 f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, (tp + tn) / (s0 + s1) AS acc FROM m)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6), CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(s0 + s1 AS BIGINT) FROM f""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """M: precision, recall, F1 by class and their averages."""
    return V.report(_confusion(spark, d))


@query("SELECT vec_id, round(1 / (1 + exp(-(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) / 1.5::DOUBLE)), 9) AS p FROM embeddings")
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities at a temperature."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(S.calibrated(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), 1.5), 9).alias("p"))


_LOGITS = "(SELECT 8 * CAST(embedding[1] AS DOUBLE) AS z0, 8 * CAST(embedding[2] AS DOUBLE) AS z1, embedding[2] + embedding[3] / 4 > embedding[1] AS y FROM embeddings)"


@query(f"""WITH g AS (SELECT i / 1000.0::DOUBLE AS t FROM (SELECT unnest(generate_series(50, 20000)) AS i)), e AS (SELECT CASE WHEN y THEN z0 - z1 ELSE z1 - z0 END AS m FROM {_LOGITS}),
 l AS (SELECT t, avg(greatest(m / t, 0) + ln(1 + exp(-abs(m / t)))) AS loss FROM e, g GROUP BY t) SELECT round(arg_min(t, loss), 2) AS temperature FROM l""")
def fitted_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The temperature of least cross entropy."""
    e = table(spark, d, "embeddings").select((F.col("embedding")[0] * 8).alias("z0"), (F.col("embedding")[1] * 8).alias("z1"), (F.col("embedding")[1] + F.col("embedding")[2] / 4 > F.col("embedding")[0]).cast("int").alias("y"))
    e = saved(e.withColumns({c: F.col(c).cast("double") for c in ("z0", "z1")}))
    return spark.createDataFrame([(round(S.fit_temperature(e, "z0", "z1", "y"), 2),)], "temperature double")


_LETTERS = r"[^\p{L}'']+"
_SPLIT = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '{_LETTERS}'), lambda x: x <> '')"
_NB = f"""train AS (SELECT row_number() OVER () AS r, {_SPLIT('t')} AS w, y FROM (SELECT title AS t, 0 AS y FROM updates WHERE title IS NOT NULL UNION ALL SELECT body, 1 FROM updates WHERE body IS NOT NULL)),
 v AS (SELECT w FROM (SELECT unnest(w) AS w FROM train) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1000), k AS (SELECT y, count(*)::DOUBLE AS n FROM train GROUP BY y), c AS (SELECT y, w, count(DISTINCT r)::DOUBLE AS n FROM (SELECT r, y, unnest(w) AS w FROM train) GROUP BY 1, 2),
 p AS (SELECT v.w, k.y, (coalesce(c.n, 0) + 0.5::DOUBLE) / (k.n + 1) AS p FROM v CROSS JOIN k LEFT JOIN c ON c.w = v.w AND c.y = k.y), base AS (SELECT p.y, sum(ln(1 - p)) + max(ln(k.n + 0.5::DOUBLE) - ln((SELECT sum(n) FROM k) + 1)) AS b FROM p JOIN k ON p.y = k.y GROUP BY p.y),
 one AS (SELECT w, max(ln(p) - ln(1 - p)) FILTER (y = 0) AS a0, max(ln(p) - ln(1 - p)) FILTER (y = 1) AS a1 FROM p GROUP BY w), d AS (SELECT row_number() OVER () AS r, id, {_alpha("coalesce(body, '')")} AS t, list_distinct({_SPLIT("coalesce(body, '')")}) AS w FROM comments),
 h AS (SELECT r, sum(a0) AS s0, sum(a1) AS s1 FROM (SELECT r, unnest(w) AS w FROM d) JOIN one USING (w) GROUP BY r), z AS (SELECT id, r, coalesce(s1, 0) + (SELECT b FROM base WHERE y = 1) - coalesce(s0, 0) - (SELECT b FROM base WHERE y = 0) AS z FROM d LEFT JOIN h USING (r))"""
_LABEL = "CASE WHEN z > 0 THEN 'subjective' ELSE 'objective' END AS subjectivity_label, round(1 / (1 + exp(-abs(z))), 6) AS subjectivity_prob"


@query(f"WITH {_NB} SELECT id, {_LABEL} FROM z")
def subjectivity(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes trained on titles against bodies of updates, applied to comments: label and its probability."""
    return _subjectivity(spark, d).select("id", "subjectivity_label", F.round("subjectivity_prob", 6).alias("subjectivity_prob"))


def _subjectivity(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "updates")
    train = u.select(F.col("title").alias("body"), F.lit(0.0).alias("y")).unionByName(u.select("body", F.lit(1.0).alias("y")))
    c = table(spark, d, "comments").select("id", F.coalesce("body", F.lit("")).alias("body"))
    return S.subjectivity(S.subjectivity_model(train, "body", "y"), c)


@query(f"""WITH {_NB}, m AS (SELECT r, sum(coalesce(s, 0)) AS s, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS p, sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS n, count_if(coalesce(s, 0) = 0)::DOUBLE AS u FROM (SELECT r, unnest(t) AS w FROM d) LEFT JOIN {_MOODS} USING (w) GROUP BY r)
SELECT id, {_LABEL}, round(coalesce(n / nullif(p + n + u, 0), 0), 6) AS neg, round(coalesce(u / nullif(p + n + u, 0), 0), 6) AS neu, round(coalesce(p / nullif(p + n + u, 0), 0), 6) AS pos, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound FROM z LEFT JOIN m USING (r)""")
def analyzed_comments(spark: SparkSession, d: str) -> DataFrame:
    """The six fields of each comment: label and probability, neg, neu, pos, compound."""
    lex = spark.createDataFrame(list(_MOOD.items()), "w string, s double")
    row = F.struct("id", "subjectivity_label", F.round("subjectivity_prob", 6).alias("subjectivity_prob")).alias("row")
    return S.sentiment(_subjectivity(spark, d).select(row, "body"), "row", "body", lex, "w", "s").select("row.*", "neg", "neu", "pos", "compound")


_NOISE = "md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42', CAST(i AS VARCHAR)))"


@query(f"""WITH t AS (SELECT doc_id, text, {_words('text')} AS w FROM documents), o AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1)::DOUBLE AS pos FROM t), x AS (SELECT doc_id, n, {_NOISE} AS h FROM (SELECT doc_id, len(w) AS n, unnest(generate_series(1, CAST(floor(len(w) * 0.1::DOUBLE) AS BIGINT))) AS i FROM t WHERE len(w) >= 10)),
 a AS (SELECT doc_id, pos, w FROM o UNION ALL SELECT doc_id, CAST(('0x' || substr(h, 1, 12)) AS BIGINT) % (n + 1) + 0.5::DOUBLE, translate(substr(h, 17, CAST(CAST(('0x' || substr(h, 13, 4)) AS BIGINT) % 6 + 3 AS INTEGER)), '0123456789abcdef', 'abcdefghijklmnop') FROM x),
 j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos, w) AS text FROM a GROUP BY 1) SELECT t.doc_id, md5(CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(j.text, '') END) AS noisy_md5 FROM t LEFT JOIN j USING (doc_id)""")
def noisy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with words put in by a hash (as md5 of the whole text)."""
    return S.noise(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("text").alias("noisy_md5"))


# ---- econometrics (N): documents as texts, orders as outcomes
_SAMPLE = f"""x AS (SELECT doc_id, ln(greatest(n_chars, 1)) AS m, CAST(doc_id % 2 AS DOUBLE) AS t, o_totalprice AS y, CAST(o_orderdate > TIMESTAMP '1998-07-01' AS INTEGER) AS post, o_orderpriority AS g, {_quality('text')} AS quality FROM documents JOIN orders ON doc_id = o_orderkey WHERE n_chars IS NOT NULL)"""


def _sample(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "orders"), F.col("doc_id") == F.col("o_orderkey")).filter("n_chars is not null")
    return j.select(
        "doc_id", F.log(F.greatest(F.col("n_chars"), F.lit(1)).cast("double")).alias("m"), (F.col("doc_id") % 2).cast("double").alias("t"), F.col("o_totalprice").alias("y"),
        (F.col("o_orderdate") > F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")).cast("int").alias("post"), F.col("o_orderpriority").alias("g"), X.simple_quality(F.col("text")).alias("quality"),
    )


@query(f"""WITH {_SAMPLE} SELECT 't:post' AS term, round(avg(y) FILTER (t = 1 AND post = 1) - avg(y) FILTER (t = 0 AND post = 1) - avg(y) FILTER (t = 1 AND post = 0) + avg(y) FILTER (t = 0 AND post = 0), 4) AS coef FROM x""")
def did_2x2(spark: SparkSession, d: str) -> DataFrame:
    """The saturated two by two model is the difference of differences of cell means."""
    ship_package(spark)
    return E.ols(_sample(spark, d), "y ~ t*post").frame(spark).filter("term = 't:post'").select("term", F.round("coef", 4).alias("coef"))


@query(f"WITH {_SAMPLE} SELECT 'm:post' AS term, round(regr_slope(y, m) FILTER (post = 1) - regr_slope(y, m) FILTER (post = 0), 4) AS coef FROM x")
def interaction_slopes(spark: SparkSession, d: str) -> DataFrame:
    """An interaction with a flag is the difference of two slopes."""
    ship_package(spark)
    return E.ols(_sample(spark, d), "y ~ m*post").frame(spark).filter("term = 'm:post'").select("term", F.round("coef", 4).alias("coef"))


@query(f"WITH {_SAMPLE}, w AS (SELECT y - avg(y) OVER (PARTITION BY g) AS y, m - avg(m) OVER (PARTITION BY g) AS m FROM x) SELECT 'm' AS term, round(regr_slope(y, m), 4) AS coef FROM w")
def within_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    """A slope with fixed effects is the slope of what is left within groups."""
    ship_package(spark)
    return E.ols(_sample(spark, d), "y ~ m + C(g)").frame(spark).filter("term = 'm'").select("term", F.round("coef", 4).alias("coef"))


@query(f"""WITH {_SAMPLE}, s AS (SELECT covar_pop(y, m) AS ym, covar_pop(y, t) AS yt, covar_pop(m, t) AS mt, var_pop(m) AS mm, var_pop(t) AS tt FROM x)
SELECT round(mt / tt * ((ym * tt - yt * mt) / (mm * tt - mt * mt)), 4) AS acme, round((yt * mm - ym * mt) / (mm * tt - mt * mt), 4) AS ade FROM s""")
def mediation_paths(spark: SparkSession, d: str) -> DataFrame:
    """What goes through the mediator, and what doesn't."""
    ship_package(spark)
    return E.mediation(_sample(spark, d), "t", "m", "y", [], "doc_id", draws=1).select(F.round("acme", 4).alias("acme"), F.round("ade", 4).alias("ade"))


# Two regressors by centred sums; p of Student's t and of the normal distribution by Simpson's rule over their densities.
_TWO = """SELECT post, count(*)::DOUBLE AS n, avg(m) AS ma, avg(quality) AS mb, avg(y) AS my, var_pop(m) * count(*) AS aa, var_pop(quality) * count(*) AS bb, covar_pop(m, quality) * count(*) AS ab, covar_pop(m, y) * count(*) AS ay, covar_pop(quality, y) * count(*) AS b_y, var_pop(y) * count(*) AS yy FROM {src} GROUP BY post"""
_SOLVED = """d AS (SELECT *, aa * bb - ab * ab AS det FROM two), e AS (SELECT *, (ay * bb - b_y * ab) / det AS c1, (b_y * aa - ay * ab) / det AS c2 FROM d), g AS (SELECT *, my - c1 * ma - c2 * mb AS c0, (yy - c1 * ay - c2 * b_y) / (n - 3) AS s2, 1 - (yy - c1 * ay - c2 * b_y) / yy AS r2 FROM e),
 h AS (SELECT *, sqrt(s2 * bb / det) AS e1, sqrt(s2 * aa / det) AS e2, sqrt(s2 * (1 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) AS e0 FROM g)"""
_SIMPSON = "(SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(generate_series(0, 2000)) AS i))"


@query(f"""WITH {_SAMPLE}, two AS ({_TWO.format(src="(SELECT *  REPLACE (0 AS post) FROM x)")}), {_SOLVED}, l AS (SELECT 'Intercept' AS term, c0 AS coef, e0 AS se, r2, n FROM h UNION ALL SELECT 'm', c1, e1, r2, n FROM h UNION ALL SELECT 'quality', c2, e2, r2, n FROM h), t AS (SELECT *, coef / se AS t FROM l),
 p AS (SELECT term, 1 - 2 * sum(w * exp(lgamma((n - 2) / 2) - lgamma((n - 3) / 2)) / sqrt((n - 3) * pi()) * pow(1 + pow(i * abs(t) / 2000, 2) / (n - 3), -(n - 2) / 2)) * max(abs(t)) / 2000 / 3 AS p FROM t, {_SIMPSON} GROUP BY term)
SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(t, 6) AS t, round(abs(p), 6) AS p, round(r2, 9) AS r2, CAST(n AS BIGINT) AS n FROM t JOIN p USING (term)""")
def ols_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients, standard errors, t, p, R2 and n of a model of two regressors."""
    ship_package(spark)
    c = E.ladder(_sample(spark, d), [("m", "y ~ m + quality", None)])
    return c.select("term", *[F.round(k, n).alias(k) for k, n in (("coef", 3), ("se", 3), ("t", 6), ("p", 6), ("r2", 9))], "n")


@query(f"""WITH {_SAMPLE}, two AS ({_TWO.format(src="x")}), {_SOLVED}, z AS (SELECT b.c1 - a.c1 AS difference, (b.c1 - a.c1) / sqrt(a.e1 * a.e1 + b.e1 * b.e1) AS z FROM h a JOIN h b ON a.post = 0 AND b.post = 1),
 p AS (SELECT difference, z, abs(1 - 2 * sum(w * exp(-pow(i * abs(z) / 2000, 2) / 2)) / sqrt(2 * pi()) * abs(z) / 2000 / 3) AS p FROM z, {_SIMPSON} GROUP BY 1, 2)
SELECT round(difference, 3) AS difference, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'changed' ELSE 'no change found' END AS verdict FROM p""")
def slope_change(spark: SparkSession, d: str) -> DataFrame:
    """Two samples' slopes, the z of their difference, its p and the verdict."""
    ship_package(spark)
    x = _sample(spark, d).withColumn("before", 1 - F.col("post"))
    f = E.fit_all(x, [("before", "y ~ m + quality", "before"), ("after", "y ~ m + quality", "post")])
    diff, z, p = E.slope_difference(f["before"], f["after"], "m")
    return spark.createDataFrame([(round(diff, 3), round(z, 6), round(p, 6), E.verdict(p))], "difference double, z double, p double, verdict string")


@query()
def mediation_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """What goes through quality, before and after apart, with the limits of 1,000 draws; without SQL.  The
    treatment is the stand-in `t` of the sample, not preparation_time."""
    ship_package(spark)
    x = saved(_sample(spark, d))
    one = lambda p: E.mediation(x.filter(F.col("post") == p), "t", "quality", "y", ["m"], "doc_id", draws=1000).withColumn("post", F.lit(p))
    return one(0).unionByName(one(1))


_MODELS = [(f"M{i}", f, None) for i, f in enumerate(E.LADDER, 1)] + [(f"successful M{i}", f, "success_indicator") for i, f in enumerate(E.LADDER_SUCCESSFUL, 1)]


def _campaigns(spark: SparkSession, d: str) -> DataFrame:
    """The variables of the models, of the campaigns in dollars of both platforms."""
    c = table(spark, d, "combined_all_columns")
    goal = T.impute_goal(F.col("platform"), F.col("goal"), F.col("pledged"), F.col("funds_raised_percent"))
    x = T.unify_category(c).withColumns({"t": wall_clock_iso(), "g": goal, "pct": T.funding_percent(F.col("platform"), F.col("percent_funded"), F.col("funds_raised_percent"))})
    x = x.filter((F.col("currency") == "USD") & (F.nanvl("pledged", F.lit(None)) > 0) & F.col("t").isNotNull() & F.col("story_content").isNotNull())
    f = X.linguistic_features(F.col("story_content"), _STOP)
    x = X.text_arrays(x, F.col("story_content"))
    return x.select(
        "row_id", F.round(T.log_floor(F.col("pct") / 100 * F.col("g"), True), 9).alias("log_pledged_amount"), T.log_floor(F.when(F.col("g") > 0, F.col("g"))).alias("log_goal"),
        X.simple_quality(F.col("story_content")).alias("text_quality"), X.word_count(F.col("story_content")).alias("word_count"), F.month("t").alias("month"), F.year("t").alias("year"), "category_unified",
        (F.col("t") > F.lit("2022-11-30 00:00:00").cast("timestamp_ntz")).cast("int").alias("PostGPT"), (F.col("platform") == "Indiegogo").cast("int").alias("indiegogo"), X.ai_score(f).alias("ai_score"),
        T.success(F.col("pct"), F.col("state")).alias("success_indicator"),
    )


@query()
def ols_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Nested models on the campaigns, both platforms, with stars: M1-M5 on all, successful M1-M5 on those
    that succeeded; without SQL (ols_summary and the closed forms have it)."""
    ship_package(spark)
    return E.ladder(saved(_campaigns(spark, d)), _MODELS)


_CAMPAIGNS = f"""c AS ({_GOAL.replace("state FROM", f"state, {_WALL} AS t, story_content FROM")} WHERE currency = 'USD' AND {nn('pledged')} > 0 AND story_content IS NOT NULL),
 x AS (SELECT round(ln(greatest(coalesce(pct / 100 * goal, 0), 1)), 9) AS y, {_quality('story_content')} AS q, CAST(platform = 'Indiegogo' AS INTEGER)::DOUBLE AS ig, CAST(t > TIMESTAMP '2022-11-30 00:00:00' AS INTEGER)::DOUBLE AS po, CASE WHEN goal > 0 THEN ln(greatest(goal, 1)) END AS lg, coalesce(len({_words('story_content')}), 0)::DOUBLE AS wc,
 coalesce(pct >= 100, false) OR coalesce(state = 'successful', false) AS won FROM c WHERE t IS NOT NULL)"""
_BASIC = {"text_quality": "q", "indiegogo": "ig", "PostGPT": "po", "text_quality:indiegogo": "q * ig", "text_quality:PostGPT": "q * po", "indiegogo:PostGPT": "ig * po"}
_MORE = _BASIC | {"log_goal": "lg", "word_count": "wc"}


def _swept(name: str, columns: dict[str, str], keep: str) -> str:
    """Least squares in SQL: the cross products of centred columns, swept on one column after the other."""
    k, cols = len(columns), [*columns.values(), "y"]
    v = f"v AS (SELECT {', '.join(f'({c}) - avg({c}) OVER () AS c{i}' for i, c in enumerate(cols))} FROM x WHERE {keep})"
    steps = [f"g0 AS (SELECT count(*)::DOUBLE AS n, {', '.join(f'sum(c{i} * c{j}) AS a{i}_{j}' for i in range(k + 1) for j in range(k + 1))}, sum(c{k} * c{k}) AS yy FROM v)"]
    for p in range(k):
        new = lambda i, j: f"-1 / a{p}_{p}" if i == j == p else f"a{i}_{j} / a{p}_{p}" if p in (i, j) else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p}"  # noqa: B023, E731
        steps.append(f"g{p + 1} AS (SELECT n, yy, {', '.join(f'{new(i, j)} AS a{i}_{j}' for i in range(k + 1) for j in range(k + 1))} FROM g{p})")
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, a{i}_{k} AS coef, sqrt(-a{i}_{i} * a{k}_{k} / (n - {k + 1})) AS se, 1 - a{k}_{k} / yy AS r2, n, n - {k + 1} AS df FROM g{k}" for i, t in enumerate(columns))
    return f"SELECT '{name}' AS model, * FROM (WITH {v}, {', '.join(steps)} {rows})"


_FITTED = " UNION ALL ".join(_swept(n, c, w) for n, c, w in (("M1", _BASIC, "true"), ("M2", _MORE, "lg IS NOT NULL"), ("successful M1", _BASIC, "won"), ("successful M2", _MORE, "won AND lg IS NOT NULL")))


@query(f"""WITH {_CAMPAIGNS}, l AS ({_FITTED}), t AS (SELECT *, coef / se AS t FROM l), p AS (SELECT model, term, abs(1 - 2 * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(i * abs(t) / 2000, 2) / df, -(df + 1) / 2)) * max(abs(t)) / 2000 / 3) AS p FROM t, {_SIMPSON} GROUP BY 1, 2)
SELECT model, term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 4) AS t, round(p, 5) AS p, round(r2, 8) AS r2, CAST(n AS BIGINT) AS n, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS stars FROM t JOIN p USING (model, term)""")
def ols_ladder_basic(spark: SparkSession, d: str) -> DataFrame:
    """M1 and M2 of both samples, with what SQL can solve: coefficients, standard errors, t, p, R2, stars."""
    c = ols_ladder(spark, d).filter(F.col("model").isin("M1", "M2", "successful M1", "successful M2") & (F.col("term") != "Intercept"))
    return c.select("model", "term", *[F.round(k, n).alias(k) for k, n in (("coef", 6), ("se", 6), ("t", 4), ("p", 5), ("r2", 8))], "n", "stars")


@query()
def ols_table(spark: SparkSession, d: str) -> DataFrame:
    """The table of the study, terms by models; without SQL."""
    return E.coefficient_table(ols_ladder(spark, d), [n for n, _, _ in _MODELS])


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """The campaigns with preparation_time in days, and before and after as 0/1."""
    c = _campaigns(spark, d)
    x = c.join(QUERIES_DATA["preparation_time"](spark, d).withColumnRenamed("preparation_days", "preparation_time"), "row_id", "left")
    return saved(x.withColumns({"after": F.col("PostGPT"), "before": 1 - F.col("PostGPT"), "preparation_time": F.col("preparation_time").cast("double")}))


_HELD = "log_goal + word_count + C(category_unified) + C(month) + C(year)"


@query()
def joint_model(spark: SparkSession, d: str) -> DataFrame:
    """Quality by period with preparation_time and the controls, on the campaigns; without SQL."""
    ship_package(spark)
    return E.ladder(_prepared(spark, d), [("joint", f"log_pledged_amount ~ text_quality*PostGPT + preparation_time + {_HELD}", None)])


@query()
def effort_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from effort to quality and from quality to funding before and after, and whether they changed;
    without SQL."""
    ship_package(spark)
    return E.paths_compared(_prepared(spark, d), "preparation_time", "text_quality", "log_pledged_amount", _HELD, ("before", "after"))


@query()
def effort_mediation(spark: SparkSession, d: str) -> DataFrame:
    """What of preparation_time goes through quality, and through ai_score in its place, before and after, with the
    limits of 1,000 draws; without SQL."""
    ship_package(spark)
    x = _prepared(spark, d)
    out = None
    for mediator in ("text_quality", "ai_score"):
        for p in (0, 1):
            m = E.mediation(x.filter(F.col("PostGPT") == p), "preparation_time", mediator, "log_pledged_amount", ["log_goal", "word_count"], "row_id", draws=1000, factors=("category_unified", "month", "year"))
            m = m.select(F.lit(mediator).alias("mediator"), F.lit(p).alias("post"), "*")
            out = m if out is None else out.unionByName(m)
    return out


# ---- windows over time and joins the study lacks (P)
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """P: counts by hour."""
    return I.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("""WITH l AS (SELECT user_id, ts, CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS INTEGER) AS new FROM events), s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """P: sessions that end after half an hour."""
    return I.user_sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS click_ts, event_id AS click_id FROM events WHERE event_type = 'click')
SELECT event_id, click_id FROM (SELECT event_id, click_id, row_number() OVER (PARTITION BY event_id ORDER BY click_ts DESC, click_id DESC) AS rn FROM e LEFT JOIN c ON e.user_id = c.user_id AND c.click_ts <= e.ts) WHERE rn = 1""")
def asof_last_click(spark: SparkSession, d: str) -> DataFrame:
    """P: the last click before each purchase, within one table."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "click"))
    order = [F.col("ts"), F.col("event_type") == "purchase", F.col("event_id")]
    e = W.carry_last(e, ["user_id"], order, F.when(F.col("event_type") == "click", F.col("event_id")), "click_id", "ts")
    return e.filter("event_type = 'purchase'").select("event_id", "click_id")
