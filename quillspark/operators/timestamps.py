"""Timestamps of many spellings, precisions and zones made into one UTC instant.

Values are taken apart by built-in regular expressions.  A local time gets its offset by an
as-of join to the zone's offset intervals, cut into segments of local time: in a segment two
intervals match (the hour that occurs twice), one matches, or none (the hour the clock skipped).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_YEAR, LAST_YEAR = 1970, 2099
_EPOCH = datetime(1970, 1, 1)

# Spellings of a time stamp.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(Z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[A-Z]{2,5})"
ISO = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]+{_CLOCK}\s*{_ZONE}?)?$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_ZONE}?)?$"
NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:,? +{_CLOCK} ?([AaPp][Mm])?\s*{_ZONE}?)?$"
DAY_NAME = rf"^(?:[A-Za-z]{{3,9}},? +)?(\d{{1,2}}) +([A-Za-z]{{3,9}})\.? +(\d{{4}})(?:,? +{_CLOCK} ?([AaPp][Mm])?\s*{_ZONE}?)?$"
NAME_DAY = rf"^(?:[A-Za-z]{{3,9}}, +)?([A-Za-z]{{3,9}})\.? +(\d{{1,2}}),? +(\d{{4}})(?:,? +(?:at +)?{_CLOCK} ?([AaPp][Mm])?\s*{_ZONE}?)?$"
EPOCH = r"^\d{9,10}(?:\.\d*)?$|^\d{12,13}(?:\.\d*)?$|^\d{15,16}(?:\.0*)?$|^\d{18,19}(?:\.0*)?$"
PLAIN_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
PLAIN_SECONDS = r"^[1-9]\d{0,10}$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_PARTS = "struct<y:string,m:string,d:string,h:string,mi:string,s:string,ap:string,z:string,n:boolean>"


@lru_cache(maxsize=None)  # a few hundred zones exist; each is worked out once a process
def zone_intervals(zone: str) -> list[tuple[int, int, int, str]]:
    """(utc_from, utc_to, offset, abbreviation) of each interval of constant offset."""
    tz = ZoneInfo(zone)

    def at(s: int) -> tuple[int, str]:
        t = (_EPOCH + timedelta(seconds=s)).replace(tzinfo=timezone.utc).astimezone(tz)
        return int(t.utcoffset().total_seconds()), t.tzname()

    begin = int((datetime(FIRST_YEAR, 1, 1) - _EPOCH).total_seconds()) - 86400
    end = int((datetime(LAST_YEAR + 1, 1, 1) - _EPOCH).total_seconds()) + 86400
    out, start, now = [], begin, at(begin)
    step = 7 * 86400
    for s in range(begin + step, end + step, step):
        s = min(s, end)
        if at(s) != now:
            lo, hi = s - step, s
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            out.append((start, hi, *now))
            start, now = hi, at(hi)
    return [*out, (start, end, *now)]


@lru_cache(maxsize=None)
def local_segments(zone: str) -> list[tuple[int, int, int, int]]:
    """(local_from, local_to, intervals that match, offset to use): disjoint, in order.

    Of two matching intervals the earlier instant counts; in a gap the offset before it, which
    moves the time forward by the length of the skip.
    """
    iv = [(a + off, b + off, off) for a, b, off, _ in zone_intervals(zone)]
    cuts = sorted({x for a, b, _ in iv for x in (a, b)})
    segments, k = [], 0
    for a, b in zip(cuts, cuts[1:]):
        near = [i for i in range(max(0, k - 2), min(len(iv), k + 3))]
        match = [iv[i] for i in near if iv[i][0] <= a and b <= iv[i][1]]
        past = [i for i in near if iv[i][0] <= a]
        k = past[-1] if past else 0
        offset = max(o for _, _, o in match) if match else iv[k if iv[k][1] <= a else k - 1][2]
        segments.append((a, b, len(match), offset))
    return segments


def zone_tables(spark: SparkSession, zones: list[str]) -> tuple[DataFrame, DataFrame]:
    """The segments exploded by local month, and the abbreviations of each zone.

    Bound: months of 1970..2099 times zones, plus two a transition; a zone has about 2 000 rows.
    """
    rows, abbr = [], []
    for zone in zones:
        for a, b, n, off in local_segments(zone):
            t0, t1 = _EPOCH + timedelta(seconds=a), _EPOCH + timedelta(seconds=b - 1)
            for ym in range(t0.year * 12 + t0.month - 1, t1.year * 12 + t1.month):
                rows.append((zone, ym, a, b, n, off))
        last: dict[str, int] = {}
        for _, to, off, name in zone_intervals(zone):
            if to > 946684800:  # abbreviations as used since 2000
                last[name] = off
        abbr += [(zone, k, v) for k, v in last.items()]
    return (
        spark.createDataFrame(rows, "seg_zone string, seg_month int, seg_from long, seg_to long, seg_matches int, seg_offset int"),
        spark.createDataFrame(abbr, "abbr_zone string, abbr_name string, abbr_offset int"),
    )


def _groups(v: Column, pattern: str, y: int, m: int, d: int, h: int, ap: int | None, z: int, numeric: bool) -> Column:
    g = lambda i: F.regexp_extract(v, pattern, i)
    return F.struct(
        g(y).alias("y"), g(m).alias("m"), g(d).alias("d"), g(h).alias("h"), g(h + 1).alias("mi"), g(h + 2).alias("s"),
        (F.upper(g(ap)) if ap else F.lit("")).alias("ap"), g(z).alias("z"), F.lit(numeric).alias("n"),
    ).cast(_PARTS)


def timestamp_parts(v: Column) -> Column:
    """The parts of a trimmed time stamp as strings; null where no spelling fits."""
    return (
        F.when(v.rlike(ISO), _groups(v, ISO, 1, 2, 3, 4, None, 7, False))
        .when(v.rlike(NUMERIC), _groups(v, NUMERIC, 3, 1, 2, 4, 7, 8, True))
        .when(v.rlike(DAY_NAME), _groups(v, DAY_NAME, 3, 2, 1, 4, 7, 8, False))
        .when(v.rlike(NAME_DAY), _groups(v, NAME_DAY, 3, 1, 2, 4, 7, 8, False))
        .when(v.rlike(COMPACT), _groups(v, COMPACT, 1, 2, 3, 4, None, 7, False))
    )


def _whole(c: Column) -> Column:
    return c.try_cast("int")


def epoch_of_number(v: Column) -> Column:
    """Whole seconds of a number of seconds, milli-, micro- or nanoseconds since 1970."""
    head = F.regexp_extract(v, r"^(\d+)", 1)
    n, digits = head.try_cast("bigint"), F.length(head)
    div = F.when(digits <= 10, 1).when(digits <= 13, 1000).when(digits <= 16, 1000000).otherwise(1000000000).cast("bigint")
    return F.when(v.rlike(EPOCH), F.call_function("div", n, div)).cast("bigint")


def normalise_timestamps(
    df: DataFrame,
    fields: list[str],
    sources: DataFrame,
    key: str = "row_id",
    source_col: str = "source_url",
) -> DataFrame:
    """One row for each value of `fields`: key, field_name, raw, is_plain, epoch_s, status.

    `sources` has `source_col`, time_zone and day_first, one row a source (a fixed table).
    status: `zoned`, `local`, `ambiguous` (the earlier instant), `nonexistent` (moved forward),
    `epoch`, or `none` where the value tells no instant.  Null and blank values give `none`;
    a local time whose source is unknown too.  Fractions are cut off.  Repeated rows are kept.
    """
    spark = df.sparkSession
    types = dict(df.dtypes)
    src = sources.select(
        F.col(source_col).alias("_src"), F.col("time_zone").alias("_zone"), F.col("day_first").alias("_dayfirst")
    ).dropDuplicates(["_src"])
    zones = sorted({r[0] for r in src.select("_zone").distinct().collect() if r[0]})
    segments, abbreviations = zone_tables(spark, zones)
    values = F.explode(
        F.array(*[
            F.struct(
                F.lit(f).alias("field_name"),
                F.col(f).cast("string").alias("raw"),
                F.lit(types[f] in ("bigint", "int")).alias("num"),
            )
            for f in fields
        ])
    )
    x = df.select(F.col(key), F.col(source_col).alias("_s"), values.alias("v")).select(key, "_s", "v.*")
    x = x.withColumn("t", F.regexp_replace("raw", r"^[\s ]+|[\s ]+$", ""))
    x = x.withColumn("is_plain", F.coalesce(F.when(F.col("num"), F.col("raw").rlike(r"^[1-9]\d{8,9}$")).otherwise(F.col("raw").rlike(PLAIN_TEXT)), F.lit(False)))
    x = x.join(F.broadcast(src), F.col("_s") == F.col("_src"), "left")  # crawl sources: fixed table
    x = x.withColumn("p", timestamp_parts(F.col("t"))).withColumn("epoch_n", epoch_of_number(F.col("t")))
    month_no = reduce(
        lambda acc, i: acc.when(F.lower(F.substring(F.col("p.m"), 1, 3)) == MONTHS[i], i + 1), range(1, 12),
        F.when(F.lower(F.substring(F.col("p.m"), 1, 3)) == MONTHS[0], 1),
    )
    swap = F.col("p.n") & F.col("_dayfirst")
    known_order = ~F.col("p.n") | F.col("_dayfirst").isNotNull()
    mon = F.coalesce(_whole(F.when(swap, F.col("p.d")).otherwise(F.col("p.m"))), month_no)
    day = _whole(F.when(swap, F.col("p.m")).otherwise(F.col("p.d")))
    hour = _whole(F.col("p.h"))
    hour = (
        F.when(F.col("p.ap") == "", hour)
        .when(~hour.between(1, 12), None)
        .when(F.col("p.ap") == "AM", hour % 12)
        .otherwise(hour % 12 + 12)
    )
    hour = F.when(F.col("p.h") == "", 0).otherwise(hour)
    minute = F.when(F.col("p.mi") == "", 0).otherwise(_whole(F.col("p.mi")))
    second = F.when(F.col("p.s") == "", 0).otherwise(_whole(F.col("p.s")))
    x = x.withColumns({
        "_y": _whole(F.col("p.y")), "_m": F.when(known_order, mon), "_d": day, "_h": hour, "_mi": minute, "_sec": second, "z": F.col("p.z"),
    })
    date = F.format_string("%04d-%02d-%02d", "_y", "_m", "_d").try_cast("date")
    ok = F.col("_y").isNotNull() & F.col("_m").between(1, 12) & F.col("_d").between(1, 31) & (F.col("_h") < 24) & (F.col("_mi") < 60) & (F.col("_sec") < 61)
    seconds = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_sec")
    x = x.withColumn("local_s", F.when(ok, seconds)).withColumn("month_no", F.col("_y") * 12 + F.col("_m") - 1)
    num = F.regexp_extract("z", r"([+-])(\d{2}):?(\d{2})$", 0)
    given = (
        F.when(F.col("z").isin("Z", "UTC", "GMT"), 0)
        .when(num != "", F.concat(F.substring(num, 1, 1), F.lit("1")).try_cast("int") * (F.substring(num, 2, 2).try_cast("int") * 3600 + F.substring(num, -2, 2).try_cast("int") * 60))
    )
    x = x.withColumn("given", given)
    x = x.join(F.broadcast(abbreviations), (F.col("_zone") == F.col("abbr_zone")) & (F.col("z") == F.col("abbr_name")), "left")
    x = x.withColumn("given", F.coalesce("given", "abbr_offset"))
    no_zone = F.col("z") == ""
    join_on = (
        (F.when(no_zone, F.col("_zone")) == F.col("seg_zone"))
        & (F.col("month_no") == F.col("seg_month"))
        & (F.col("local_s") >= F.col("seg_from"))
        & (F.col("local_s") < F.col("seg_to"))
    )
    x = x.join(F.broadcast(segments), join_on, "left")  # bound: see zone_tables
    epoch_s = (
        F.when(F.col("epoch_n").isNotNull(), F.col("epoch_n"))
        .when(no_zone, F.col("local_s") - F.col("seg_offset"))
        .otherwise(F.col("local_s") - F.col("given"))
    )
    status = (
        F.when(F.col("epoch_n").isNotNull(), "epoch")
        .when(F.col("epoch_s").isNull(), "none")
        .when(~no_zone, "zoned")
        .when(F.col("seg_matches") == 2, "ambiguous")
        .when(F.col("seg_matches") == 0, "nonexistent")
        .otherwise("local")
    )
    x = x.withColumn("epoch_s", F.when(F.col("epoch_n").isNotNull() | F.col("p").isNotNull(), epoch_s).cast("bigint"))
    return x.withColumn("status", status).select(key, "field_name", "raw", "is_plain", "epoch_s", "status")


def instants_to_mend(spark: SparkSession, df: DataFrame, sources: DataFrame) -> DataFrame:
    """Values of created_at, launched_at and deadline that tell an instant, but not in the plain form."""
    out = normalise_timestamps(df, ["created_at", "launched_at", "deadline"], sources)
    return out.filter(~F.col("is_plain") & F.col("epoch_s").isNotNull()).select("row_id", "field_name", "epoch_s")
