"""Queries over sources and sinks: each writes a table into the shared folder and reads it back; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scoring as S
from .operators.tables import pick_column
from .queries_text import query as _query
from .session import scratch, ship_package, table
from .sources import io
from .streaming.incremental import run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    return _query(sql, QUERIES, SQL)


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT id, number, nullif(title, '') AS title, md5(nullif(body, '')) AS body_md5 FROM updates")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """CSV with quotes and line ends in its texts; an empty text comes back as null."""
    path = _new(spark, "csv")
    io.write_table(table(spark, d, "updates").select("id", "number", "title", "body"), path, "csv")
    return io.read_csv(spark, path, "id string, number int, title string, body string").select("id", "number", "title", F.md5("body").alias("body_md5"))


@query("SELECT doc_id, lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents")
def formats_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parquet, JSON and text by their names' endings, required columns checked."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source")
    p, j, t = _new(spark, "p") + ".parquet", _new(spark, "j") + ".json", _new(spark, "t") + ".txt"
    io.write_table(x, p)
    x.filter("lang is not null").write.json(j)
    x.select(F.col("doc_id").cast("string")).write.text(t)
    a = io.read_any(spark, p, ["doc_id", "lang"]).select("doc_id", "lang", "source")
    b = io.read_any(spark, j, ["doc_id", "lang"])
    b = b.select("doc_id", "lang", b["source"] if pick_column(b, ["origin", "source"]) == "source" else F.lit(None).alias("source"))
    c = io.read_any(spark, t).select(F.col("value").cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT project_id, error_stage, CASE WHEN error_stage = 'comments' THEN 'two' ELSE 'one' END AS batch, 'rows' AS part FROM scrape_failures UNION ALL
SELECT project_id, error_stage, CASE WHEN error_stage = 'comments' THEN 'two' ELSE 'one' END, 'failures' FROM scrape_failures WHERE error_message IS NULL""")
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    """Batches of three outputs, one of them written again, read as one."""
    path, f = _new(spark, "batches"), table(spark, d, "scrape_failures").select("project_id", "error_stage", "error_message")
    comments = F.coalesce(F.col("error_stage") == "comments", F.lit(False))
    for batch, x in (("one", f.filter(~comments)), ("two", f.limit(1)), ("two", f.filter(comments))):
        io.write_batch(x, x.filter("error_message is null"), x.groupBy("error_stage").agg(F.count("*").alias("n")), path, batch)
    schema = "project_id string, error_stage string, error_message string, batch string"  # a part may have no row at all
    one = lambda part: spark.read.schema(schema).parquet(f"{path}/{part}").select("project_id", "error_stage", "batch", F.lit(part).alias("part"))
    return one("rows").unionByName(one("failures"))


@query("SELECT DISTINCT trim(project_id) AS id FROM scrape_failures WHERE trim(project_id) <> ''")
def checkpoint_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a checkpoint file, one a line, appended twice, blank lines dropped."""
    path = _new(spark, "ids")
    lines = table(spark, d, "scrape_failures").select(F.coalesce(F.concat(F.lit(" "), "project_id"), F.lit("")).alias("value"))
    lines.write.text(path)
    lines.write.mode("append").text(path)
    return io.ids_of_checkpoint(spark, path).unionByName(io.ids_of_checkpoint(spark, f"{path}-none"))


@query("SELECT user_id, kind, CAST(count(*) AS BIGINT) AS n, min(CAST(event_id AS BIGINT)) AS first_id FROM (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'START' WHEN 'error' THEN 'ERROR' END AS kind FROM events) WHERE kind IS NOT NULL GROUP BY 1, 2")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    """A log's lines in the order of their file, as typed events."""
    path = _new(spark, "log") + ".log"
    said = F.when(F.col("event_type") == "signup", F.concat(F.lit("[PROJECT_START] Processing project "), "event_id")).when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] "), "event_id")).otherwise("nothing")
    e = table(spark, d, "events").select("user_id", "event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - "), F.col("user_id"), F.lit(" - "), said).alias("value"))
    e.orderBy("event_id").select("value").write.text(path)
    from .operators.eventlog import typed_events

    x = typed_events(io.read_log(spark, path)).select(F.split("value", " - ")[1].cast("bigint").alias("user_id"), "kind", F.col("detail").cast("bigint").alias("id"), "file", "offset")
    # within a file the order of the lines is that of the ids, so the first line holds the least id
    g = x.groupBy("user_id", "kind", "file").agg(F.count("*").alias("n"), F.min_by("id", "offset").alias("first_id"))
    return g.groupBy("user_id", "kind").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


@query("SELECT DISTINCT id AS id, project_id FROM updates WHERE id IS NOT NULL")
def incremental_updates(spark: SparkSession, d: str) -> DataFrame:
    """What is new in a folder, taken once over two runs, the second of which finds repeated rows."""
    src, out, state = _new(spark, "in"), _new(spark, "out"), _new(spark, "state")
    u = table(spark, d, "updates").select("id", "project_id").filter("id is not null")
    u.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).write.parquet(src)
    run_available(spark, src, u.schema, "id", lambda x: x, out, state)
    u.write.mode("append").parquet(src)
    run_available(spark, src, u.schema, "id", lambda x: x, out, state)
    return spark.read.parquet(out).select("id", "project_id")


@query("SELECT doc_id, CASE WHEN text IS NULL OR regexp_replace(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g') = '' THEN 0.0::DOUBLE ELSE length(text)::DOUBLE END AS score FROM documents")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model (here the length) made once a worker and called on batches; blank texts have 0."""
    ship_package(spark)
    make = lambda: lambda texts: [float(len(t)) for t in texts]
    return table(spark, d, "documents").select("doc_id", S.score_texts(F.col("text"), make).alias("score"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 5.0::DOUBLE * least(pow(2.0::DOUBLE, event_id % 6), 10.0::DOUBLE) ELSE 0.0::DOUBLE END AS delay FROM events")
def throttle_delays(spark: SparkSession, d: str) -> DataFrame:
    """The delay after failures, 0 where it is switched off."""
    return table(spark, d, "events").select("event_id", io.throttle_delay(F.col("event_id") % 6, F.col("event_type") == "error").alias("delay"))


@query("SELECT story_row_id, scrape_round FROM stories")
def light_report(spark: SparkSession, d: str) -> DataFrame:
    """The table without its heavy columns."""
    x = io.without_heavy(table(spark, d, "stories").select("story_row_id", "scrape_round", "story_content"))
    return x.select(*x.columns)


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(3 AS INTEGER) AS n FROM embeddings")
def chart_values(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a page's script (made of the vectors), read as JSON and never run."""
    page = F.concat(F.lit("<script>var other = [1]; var raised = "), F.to_json(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)), F.lit(";</script>"))
    x = io.chart_arrays(table(spark, d, "embeddings").select("vec_id", page.alias("html")), "html", ["raised"])
    return x.select("vec_id", F.col("raised")[0].alias("first_value"), F.size("raised").alias("n"))
