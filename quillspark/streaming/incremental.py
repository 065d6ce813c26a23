"""Incremental runs: files as a stream, scored in batches, every row taken once; windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, key: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 50
) -> StreamingQuery:
    """Reads what is new in a folder of Parquet files, transforms it and appends it to `out`.

    A key comes through once over all runs: a batch's rows whose key other batches have written are left out by a
    join with these keys, so that no state grows in memory; rows without a key stay.  A batch that is written again
    after a failure replaces its own partition.  Ends when everything there is has been read.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            known = known.join(spark.read.parquet(out).filter(F.col("batch") != batch_id).select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch = known.unionByName(batch.filter(F.col(key).isNull()))
        transform(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window (P); with `late` a watermark, so that it runs on a stream too."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))
    x = x.withWatermark(ts, late) if late else x
    g = x.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "total")


def user_sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap (P); rows of a session that meet in a partition are joined before they are moved."""
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))
    x = x.withWatermark(ts, late) if late else x
    g = x.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")
