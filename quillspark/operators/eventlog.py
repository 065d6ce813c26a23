"""An event log read as sessions: typed events, sessions, their states, run chart and efficacy of resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_count

# The log's line patterns, first match wins.
TS = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
PATTERNS = {
    "START": r"\[PROJECT_START\] Processing project (\d+)",
    "END": r"\[PROJECT_END\] Finished .* Status=(\w+)",
    "SLEEP": r"(?:Sleeping|Pausing) (?:for )?(\d+)(?:s| seconds)",
    "RESET": r"Resetting (?:scraper )?session",
    "METRIC": r"\[METRIC\] .* Fetched (\d+) (?:comments|updates)",
    "ERROR": r"\[ERROR\] (.*)",
}


def typed_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines with kind, detail (id, status, seconds, count or message) and ts; lines of no kind are dropped (L1)."""
    kind, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, p in reversed(list(PATTERNS.items())):
        hit = F.col(text).rlike(p)
        kind = F.when(hit, k).otherwise(kind)
        detail = F.when(hit, F.lit(None) if k == "RESET" else F.regexp_extract(text, p, 1)).otherwise(detail)
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract(text, TS, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.withColumns({"kind": kind, "detail": detail, "ts": ts}).filter("kind is not null")


def sessions(events: DataFrame, log: str, order: list[str], amount: str = "amount", status: str = "status", ts: str = "ts") -> DataFrame:
    """One row a session of each log: START opens (closing an open one), END closes; events after it own none (L2, L3).

    Columns of events: `log`, `order` (unique within a log), kind, amount, status.  Result: log, session, sleeps,
    errors, amount (of METRIC), was_reset, status, total and longest sleep, start and end order.
    """
    x = running_count(events, [log], order, F.col("kind") == "START", "session", ts).filter("session > 0")
    ws = Window.partitionBy(log, "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("kind") == "END").cast("int")).over(ws), F.lit(0))
    x = x.withColumn("_after", ended).filter("_after = 0")
    of = lambda k: F.col("kind") == k
    return x.groupBy(log, "session").agg(
        F.count_if(of("SLEEP")).alias("sleeps"), F.count_if(of("ERROR")).alias("errors"),
        F.coalesce(F.sum(F.when(of("METRIC"), F.col(amount))), F.lit(0)).alias("metric"),
        F.coalesce(F.max(F.when(of("RESET"), 1)), F.lit(0)).alias("was_reset"),
        F.coalesce(F.max(F.when(of("END"), F.col(status))), F.lit("Unknown")).alias("status"),
        F.coalesce(F.sum(F.when(of("SLEEP"), F.col(amount))), F.lit(0)).alias("total_sleep"),
        F.coalesce(F.max(F.when(of("SLEEP"), F.col(amount))), F.lit(0)).alias("longest_sleep"),
        F.min(F.when(of("START"), F.col("ts"))).alias("start_ts"), F.max(F.when(of("END"), F.col("ts"))).alias("end_ts"),
    )


def state() -> Column:
    """FAILED, CLEAN, HARD_BLOCK or SOFT_BLOCK (L4)."""
    return (
        F.when(F.col("status") != "Success", "FAILED").when(F.col("total_sleep") == 0, "CLEAN")
        .when((F.col("longest_sleep") >= 60) | (F.col("total_sleep") >= 60), "HARD_BLOCK").otherwise("SOFT_BLOCK")
    )


SPAN = 10_000  # sessions of a log that are counted together


def run_chart(s: DataFrame, log: str) -> DataFrame:
    """Runs of equal states: log, run, state, n (L7).  Sessions are numbered without gaps, as `sessions` does.

    There may be one log: each session hands its state to the next by its number, and runs are counted over spans.
    """
    after = s.select(log, (F.col("session") + 1).alias("session"), F.col("state").alias("_prior"), F.lit(None).cast("string").alias("state"), F.lit(False).alias("_own"))
    own = s.select(log, "session", F.lit(None).cast("string").alias("_prior"), "state", F.lit(True).alias("_own"))
    x = own.unionByName(after).groupBy(log, "session").agg(F.max("state").alias("state"), F.max("_prior").alias("_prior"), F.max("_own").alias("_own")).filter("_own")
    x = running_count(x, [log], ["session"], ~F.col("state").eqNullSafe(F.col("_prior")), "run", "session", bucket=F.floor(F.col("session") / SPAN))
    return x.groupBy(log, "run").agg(F.min("state").alias("state"), F.count("*").alias("n"))


def reset_efficacy(s: DataFrame, log: str, ahead: int = 5) -> DataFrame:
    """resets, worked: resets whose next sessions are all clean or soft; none after it isn't a success.

    Sessions are numbered without gaps: each tells the `ahead` sessions before it whether it is good.
    """
    good = F.col("state").isin("CLEAN", "SOFT_BLOCK").cast("int")
    told = s.select(log, F.explode(F.sequence(F.col("session") - ahead, F.col("session") - 1)).alias("session"), good.alias("_good"), F.lit(0).alias("was_reset"))
    own = s.select(log, "session", F.lit(None).cast("int").alias("_good"), "was_reset")
    x = own.unionByName(told).groupBy(log, "session").agg(F.max("was_reset").alias("was_reset"), F.min("_good").alias("_good")).filter("was_reset = 1")
    return x.groupBy(log).agg(F.count("*").alias("resets"), F.sum(F.coalesce("_good", F.lit(0))).alias("worked"))


def tipping_point(s: DataFrame, log: str) -> DataFrame:
    """The clean streak at the start and the speed advised from it (L6); nulls below two clean sessions."""
    first_bad = F.min(F.when(F.col("state") != "CLEAN", F.col("session")))
    t = s.groupBy(log).agg(first_bad.alias("first_bad"), F.min("session").alias("first"), F.count("*").alias("n_sessions"))
    j = s.join(t, log)
    clean = (F.col("session") < F.col("first_bad")) | F.col("first_bad").isNull()
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    g = j.groupBy(log).agg(
        F.count_if(clean).alias("clean_streak"), F.max_by(F.when(clean, secs("end_ts")), F.when(clean, F.col("session"))).alias("_e"),
        F.min_by(F.when(clean, secs("start_ts")), F.when(clean, F.col("session"))).alias("_s"), F.max("first_bad").alias("first_bad"),
    )
    k, dur = F.col("clean_streak"), F.col("_e") - F.col("_s")
    rpm = F.when((k > 1) & F.col("first_bad").isNotNull() & (dur > 0), k / (dur / 60))
    target = 60 / (rpm * 0.8)
    return g.select(
        log, "clean_streak", F.round(rpm, 6).alias("clean_rpm"), F.round(target, 6).alias("target_s"),
        F.round(F.when(rpm.isNotNull(), F.greatest(F.lit(0.5), target - dur / k + 1.0)), 6).alias("added_sleep_s"),
    )
