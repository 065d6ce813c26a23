"""Sources and sinks: tables with a format fallback, many files at once, logs, checkpoints of ids, batches."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import first_by

FAILURES = T.StructType([T.StructField(c, T.StringType()) for c in ("project_id", "project_url", "error_stage", "error_message", "timestamp")])


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, multi_line: bool = True, infer: bool = False, **options: str
) -> DataFrame:
    """CSV with a header, quoted texts over several lines, and '' as null (A1, A4: `path` may be a glob).

    Without a schema all columns are strings; `infer` reads the files once more for their types.  A file whose texts
    may hold line ends can't be split: `multi_line` off reads large files in parts.  Files that can't be read are
    skipped; `files_without_rows` tells which.
    """
    r = spark.read.options(header=True, multiLine=multi_line, escape='"', ignoreCorruptFiles="true", **options)
    return (r.schema(schema) if schema else r.option("inferSchema", infer)).csv(path)


def files_without_rows(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """file of each file at `path` that gave `df`, as it was read, no row: it couldn't be read or is empty."""
    every = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # contents aren't read
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return every.select(bare("file").alias("file")).join(df.select(bare("_metadata.file_path").alias("file")).distinct(), "file", "left_anti")


def prefer_raw(df: DataFrame, file: Column, mark: str = "_sentiment_") -> DataFrame:
    """Rows of files whose name is without the mark, if there are any, else all."""
    x = df.withColumn("_raw", ~F.coalesce(file.contains(mark), F.lit(False))).withColumn("_one", F.lit(1))
    some = x.groupBy("_one").agg(F.max("_raw").alias("_any"))  # one row
    return x.join(F.broadcast(some), "_one").filter(F.col("_raw") | ~F.col("_any")).drop("_raw", "_any", "_one")


def read_any(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Parquet, CSV, JSON or text by the name's ending (A2, A3); raises if a required column is missing."""
    kind = PurePosixPath(path.rstrip("/*")).suffix.lower()
    if kind == ".csv":
        df = read_csv(spark, path)
    elif kind in (".json", ".jsonl"):
        df = spark.read.json(path)
    elif kind in (".txt", ".log"):
        df = read_log(spark, path)
    else:
        df = spark.read.option("mergeSchema", True).parquet(path)
    if missing := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and line order.

    Lines keep the order of their file: `offset` rises within a file, as a split's lines are read in order and
    monotonically_increasing_id rises from split to split.
    """
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("offset"))


def ids_of_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Different ids, one a line, blanks dropped (A8); a missing file has none."""
    try:
        df = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string")
    return df.select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def ids_with_data(summary: DataFrame, count: str | None = None) -> DataFrame:
    """Ids that succeeded, and have data if the summary counts it (A9, A10); without a status all ids."""
    key = "id" if "id" in summary.columns else "project_id"
    df = summary
    if "status" in df.columns:
        df = df.filter(F.col("status") == "Success")
        if count and count in df.columns:
            df = df.filter(F.coalesce(F.col(count).try_cast("double"), F.lit(0.0)) > 0)
    return df.select(F.col(key).cast("string").alias("id")).filter("id is not null").distinct()


def without_heavy(df: DataFrame, heavy: tuple[str, ...] = ("story_content", "html_content")) -> DataFrame:
    """Columns too heavy for a report are dropped where they are."""
    return df.drop(*[c for c in heavy if c in df.columns])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", sample: int | None = None, order: str | None = None) -> None:
    """Parquet or CSV, whole or (where the feature is a sample) the first rows by an order."""
    out = df.orderBy(order).limit(sample) if sample and order else df
    w = out.write.mode(mode)
    w.option("header", True).option("escape", '"').csv(path) if kind == "csv" else w.parquet(path)


def write_batch(rows: DataFrame, failures: DataFrame, summary: DataFrame, path: str, batch: str) -> None:
    """Three outputs of a batch, each partitioned by it; writing a batch again replaces it."""
    for name, df in (("rows", rows), ("failures", failures), ("summary", summary)):
        out = df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch").parquet(f"{path}/{name}")


def failure_rows(df: DataFrame, project_id: str, url: str, stage: Column, message: Column) -> DataFrame:
    """Rows of a failure list; messages are cut at 500 characters."""
    return df.select(
        F.col(project_id).cast("string").alias("project_id"), F.col(url).alias("project_url"), stage.alias("error_stage"),
        F.substring(message, 1, 500).alias("error_message"),
    )


def merge_batches(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """All batches, the first row of each key by an order; rows without a key are kept."""
    return first_by(df, [key], order, keep_null_keys=True)


def flatten_comments(nested: DataFrame) -> DataFrame:
    """Comments, each followed by its replies (A11, O1): one row each, parent_id null for the first."""
    edge = F.explode(F.col("project.comments.edges")).alias("e")
    c = nested.select(F.col("project.id").alias("project_id"), edge).select("project_id", "e.node.*")
    cols = ["project_id", "id", "body", F.timestamp_seconds("createdAt").alias("created_at"), F.col("author.name").alias("author"), F.col("author.id").alias("author_id")]
    top = c.select(*cols, F.lit(None).cast("string").alias("parent_id"))
    r = c.select("project_id", F.col("id").alias("parent_id"), F.explode(F.col("replies.edges")).alias("r")).select("project_id", "parent_id", "r.node.*")
    return top.unionByName(r.select(*cols, "parent_id"))


def chart_arrays(pages: DataFrame, html: str, names: list[str]) -> DataFrame:
    """JavaScript arrays of a page as arrays of numbers, read as JSON and never run (A14); unreadable ones are null."""
    return pages.withColumns({n: F.from_json(F.regexp_extract(html, rf"\b{n}\s*[=:]\s*(\[[^\]]*\])", 1), "array<double>") for n in names})


def funding_progress(pages: DataFrame, key: str, chart: str, ongoing: Column) -> DataFrame:
    """Rows of the chart's JSON: seven columns while it runs, three after; trend rows and (while it runs) the last
    two rows are dropped, gaps filled (O4, C9, B23, I2)."""
    from pyspark.sql import Window

    x = pages.select(key, ongoing.alias("ongoing"), F.posexplode(F.from_json(F.col(chart), "array<array<string>>")).alias("pos", "r"))
    at = lambda i: F.try_element_at("r", F.lit(i))
    num = lambda i: F.coalesce(at(i).try_cast("double"), F.lit(0.0))
    late = lambda c: F.when(F.col("ongoing"), c)
    x = x.select(
        key, "ongoing", "pos", at(1).try_cast("date").alias("date"), num(2).alias("funds_raised"), num(3).alias("goal"),
        F.coalesce(late(at(4).try_cast("double")), F.lit(0.0)).alias("trend"), F.coalesce(late(at(5).try_cast("double")), F.lit(0.0)).alias("projection_low"),
        F.coalesce(late(at(6).try_cast("double")), F.lit(0.0)).alias("projection_high"), F.coalesce(late(at(7)), F.lit("")).alias("tooltip"),
    )
    x = x.filter(~F.col("tooltip").contains("Trending:") & ~F.col("tooltip").contains("Trend:"))
    left = F.row_number().over(Window.partitionBy(key).orderBy(F.col("pos").desc()))
    return x.withColumn("_left", left).filter(~F.col("ongoing") | (F.col("_left") > 2)).drop("_left", "ongoing")


def throttle_delay(failures: Column, enabled: Column, base: float = 5.0, jitter: Column | None = None) -> Column:
    """base x min(2^failures, 10) x jitter, 0 if switched off."""
    return F.when(enabled, F.lit(base) * F.least(F.pow(F.lit(2.0), failures), F.lit(10.0)) * (F.lit(1.0) if jitter is None else jitter)).otherwise(0.0)
