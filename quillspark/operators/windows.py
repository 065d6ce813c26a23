"""Running values over long groups: a group is cut into buckets of time, so no task gets a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn("_b", F.coalesce(F.call_function("div", F.unix_seconds(F.col(ts).cast("timestamp")), F.lit(seconds)), F.lit(0)))


def running_count(df: DataFrame, keys: list[str], order: list[str], hit: Column, out: str, ts: str, seconds: int = 86400, bucket: Column | None = None) -> DataFrame:
    """Adds how many rows of the group hold `hit` up to each row; `order` begins with `ts`, nulls of which come first
    only where all are null.  The group is cut by `bucket`, if it is given, which must rise with the order."""
    x = (_bucketed(df, ts, seconds) if bucket is None else df.withColumn("_b", bucket)).withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("bigint"))
    own = [*keys, "_b"]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*own).agg(F.sum("_hit").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    x = x.withColumn("_in", F.sum("_hit").over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return x.join(sums, own).withColumn(out, F.col("_in") + F.col("_before")).drop("_b", "_hit", "_in", "_before")


def carry_last(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, ts: str, seconds: int = 86400) -> DataFrame:
    """Adds the last value of the group that isn't null, up to and with each row (an as-of join within one table)."""
    x = _bucketed(df, ts, seconds).withColumn("_v", value)
    own = [*keys, "_b"]
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    last = x.groupBy(*own).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.last("_l", ignorenulls=True).over(before)).drop("_l")
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_in", inside).join(last, own).withColumn(out, F.coalesce("_in", "_before")).drop("_b", "_v", "_in", "_before")
