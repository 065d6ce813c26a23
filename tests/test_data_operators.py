"""Mixed units, filling from like records, mixed time stamps: brute force and edge cases."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillspark.functions.keys import project_number
from quillspark.operators.impute import KPrototypes, fill_errors, fill_from_similar, nearest_donors
from quillspark.operators.timestamps import local_segments, normalise_timestamps, zone_intervals
from quillspark.operators.units import Unit, amounts_in_common_unit, canonical, money_unit, parse_unit
from quillspark.operators.windows import carry_last, running_count


def test_project_number(spark):
    rows = [("110", 110), ("110.0", 110), (" 110 ", 110), ("110,010,528", 110010528), ("1.10162479E08", 110162479), ("1.1e+2", 110), ("12.5", None), ("", None), ("x1", None), (None, None), ("110 ", 110)]
    got = spark.createDataFrame(rows, "id string, n long").select("n", project_number(F.col("id")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["n"] for r in got]


# ---- time stamps
SOURCES = [("ny", "America/New_York", False), ("be", "Europe/Berlin", True), ("utc", "UTC", False), ("sy", "Australia/Sydney", True)]


def stamps(spark, values):
    src = spark.createDataFrame(SOURCES, "source_url string, time_zone string, day_first boolean")
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(values)], "row_id long, source_url string, created_at string")
    return {r["row_id"]: r for r in normalise_timestamps(df, ["created_at"], src).collect()}


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


def test_spellings(spark):
    cases = [
        ("ny", "2020-01-02T03:04:05Z", utc(2020, 1, 2, 3, 4, 5), "zoned"), ("ny", "2020-01-02 03:04:05", utc(2020, 1, 2, 8, 4, 5), "local"), ("be", "02.01.2020 03:04", utc(2020, 1, 2, 2, 4), "local"),
        ("ny", "01/02/2020 03:04 PM", utc(2020, 1, 2, 20, 4), "local"), ("be", "02/01/2020 03:04", utc(2020, 1, 2, 2, 4), "local"), ("ny", "Thu, 02 Jan 2020 03:04:05 GMT", utc(2020, 1, 2, 3, 4, 5), "zoned"),
        ("ny", "March 5, 2019 1:40 AM UTC-05:00", utc(2019, 3, 5, 6, 40), "zoned"), ("ny", "Jul 4, 2020 12:00 AM EDT", utc(2020, 7, 4, 4), "zoned"), ("sy", "June 22, 2018 10:09 PM AEST", utc(2018, 6, 22, 12, 9), "zoned"),
        ("ny", "20200102T030405Z", utc(2020, 1, 2, 3, 4, 5), "zoned"), ("ny", "2020-01-02", utc(2020, 1, 2, 5), "local"), ("ny", "1577934245678", 1577934245, "epoch"), ("ny", " 1577934245 ", 1577934245, "epoch"),
        ("ny", "1577934245.999", 1577934245, "epoch"), ("ny", "1577934245678901234", 1577934245, "epoch"), ("ny", "2020-01-02T03:04:05.999999999+00:00", utc(2020, 1, 2, 3, 4, 5), "zoned"),
        # clocks: twice, skipped, first midnight
        ("ny", "2018-11-04 01:30:00", utc(2018, 11, 4, 5, 30), "ambiguous"), ("ny", "2018-03-11 02:30:00", utc(2018, 3, 11, 7, 30), "nonexistent"), ("be", "2018-10-28 02:30:00", utc(2018, 10, 28, 0, 30), "ambiguous"),
        # no instant
        ("ny", "soon", None, "none"), ("ny", "", None, "none"), ("ny", None, None, "none"), ("ny", "0000-00-00 00:00:00", None, "none"), ("ny", "2021-13-45", None, "none"), ("ny", "2021-02-30", None, "none"), ("ny", "-1", None, "none"),
        (None, "2020-01-02 03:04:05", None, "none"), (None, "2020-01-02T03:04:05+01:00", utc(2020, 1, 2, 2, 4, 5), "zoned"), ("ny", "x" * 100000, None, "none"),
    ]
    got = stamps(spark, [(s, v) for s, v, _, _ in cases])
    for i, (_, v, want, status) in enumerate(cases):
        assert (got[i]["epoch_s"], got[i]["status"]) == (want, status), v
    assert got[0]["is_plain"] and not got[1]["is_plain"]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"])
def test_segments_against_zoneinfo(zone):
    tz, rng, segs = ZoneInfo(zone), random.Random(1), local_segments(zone)
    near = [a for a, *_ in segs if 0 < a < 4e9]
    for t in [rng.randrange(10**8, 19 * 10**8) for _ in range(300)] + [a + d for a in near for d in (-1800, -1, 0, 1800, 3600)]:
        want = int((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t)).replace(tzinfo=tz, fold=0).timestamp())
        seg = next(s for s in segs if s[0] <= t < s[1])
        assert t - seg[3] == want
    assert zone_intervals("UTC")[0][2] == 0 and len(zone_intervals("UTC")) == 1


def test_time_stamps_of_empty_tables_and_repeats(spark):
    assert stamps(spark, []) == {}
    src = spark.createDataFrame(SOURCES, "source_url string, time_zone string, day_first boolean")
    df = spark.createDataFrame([(1, "ny", "2020-01-02", "a")] * 3, "row_id long, source_url string, created_at string, v string")
    assert normalise_timestamps(df, ["created_at"], src).count() == 3


# ---- units
def test_unit_grammar():
    good = {
        "USD": ("USD", 1), " usd ": ("USD", 1), "US cents": ("USD", 0.01), "thousands of US dollars": ("USD", 1e3), "kEUR": ("EUR", 1e3), "TGBP": ("GBP", 1e3), "in 1,000 SEK": ("SEK", 1e3), "GBp": ("GBP", 0.01),
        "mio. JPY": ("JPY", 1e6), "mUSD": ("USD", 1e6), "USD x1000": ("USD", 1e3), "EUR x 0.01": ("EUR", 0.01), "GBP pence": ("GBP", 0.01), "hundredths of one British pound": ("GBP", 0.01), "dollars (US)": ("USD", 1),
        "Fr. (CH)": ("CHF", 1), "円": ("JPY", 1), "öre": ("SEK", 0.01), "centavos (MXN)": ("MXN", 0.01), "USD minor units": ("USD", 0.01),
    }
    for text, want in good.items():
        assert parse_unit(text) == want, text
    for text in (None, "", "N/A", "apples", "USD EUR", "USD per EUR", "thousand", "k", "USD k k", "x" * 5000):
        assert parse_unit(text) is None, text
    eur = Unit((("EUR", 1),), 1000.0)
    assert eur.times(Unit((("EUR", 1),)), -1).dims == () and eur.money() == "EUR"


UNITS = [(10, "USD", "major", 1.0), (11, "USD", "minor", 0.01), (12, "USD", "thousand", 1000.0), (20, "EUR", "major", 1.0), (22, "EUR", "thousand", 1000.0), (60, "JPY", "major", 1.0)]
COLS = "row_id long, currency string, goal double, pledged double, percent_funded double, funds_raised_percent double, name string, blurb string, story_content string, crawled_at timestamp"


def amounts(spark, rows):
    u = spark.createDataFrame(UNITS, "unit_id int, currency_code string, scale_name string, major_per_unit double")
    r = spark.createDataFrame([("USD", "2020-01", 1.0), ("EUR", "2020-01", 1.1), ("JPY", "2020-01", 0.01)], "currency_code string, fx_month string, usd_per_major double")
    t = dt.datetime(2020, 1, 5)
    df = spark.createDataFrame([(i, *x, t) for i, x in enumerate(rows)], COLS)
    return {(x["row_id"], x["field_name"]): x for x in amounts_in_common_unit(df, u, r).collect()}


def test_units_are_exponents_with_scale_and_offset(spark):
    celsius, kelvin_per = Unit((("K", 1),), 1.0, 273.15), Unit((("K", 1),), 5 / 9, 459.67 * 5 / 9)
    got = spark.range(1).select(canonical(F.lit(25.0), F.lit(celsius.factor), F.lit(celsius.offset)).alias("a"), canonical(F.lit(77.0), F.lit(kelvin_per.factor), F.lit(kelvin_per.offset)).alias("b")).first()
    assert got["a"] == pytest.approx(298.15) and got["b"] == pytest.approx(298.15)
    assert Unit((("USD", 1),)).times(Unit((("USD", 1),)), -1).dims == () and Unit((("USD", 1),)).times(Unit((("h", 1),)), -1).money() is None
    assert money_unit("GBX").factor == 0.01 and money_unit("USD per EUR") is None and money_unit(None) is None


def test_amounts(spark):
    nan = float("nan")
    got = amounts(spark, [
        ("USD", 100.0, 50.0, 50.0, None, "n", "b", "s"), ("usd", 100.0, 0.0, None, None, None, None, None), ("EUR '000", 1.5, nan, None, None, None, None, None),
        ("USD", 100.0, 5000.0, 50.0, None, None, None, None), ("USD", 60.865, 359.57, None, 0.5908, None, None, None), (None, 5.0, None, None, None, "n", "Cyclists (all amounts in thousands of euros)", None),
        (None, 5.0, None, None, None, None, "Rewards start at 28 euros", "Price\n14 €"), ("N/A", 5.0, None, None, None, None, None, None), ("JPY", 100.0, 100.0, 1.0, None, None, None, None),
        ("USD", -1.0, 9999999999.0, None, None, None, None, None), ("shells", 5.0, 5.0, None, None, None, None, None), (None, 5.0, 1.0, None, None, None, "in euros", "in yen"),
    ])
    unit = lambda i, f: (got[i, f]["unit_id"], got[i, f]["told_by"])
    assert unit(0, "goal") == unit(0, "pledged") == (10, "plain")
    assert unit(1, "goal") == unit(1, "pledged") == (10, "currency")
    assert unit(2, "goal") == (22, "currency") and got[2, "goal"]["usd"] == pytest.approx(1650) and (2, "pledged") not in got
    assert unit(3, "pledged") == (11, "share") and unit(3, "goal") == (10, "plain") and got[3, "pledged"]["usd"] == 50
    assert unit(4, "goal") == (12, "share")
    assert unit(5, "goal") == (22, "text")
    for i in (6, 7, 10, 11):
        assert unit(i, "goal") == (None, "nothing") and got[i, "goal"]["usd"] is None
    assert unit(8, "pledged") == (None, "nothing")  # a yen has no hundredth
    assert not any(k[0] == 9 for k in got)
    assert amounts(spark, []) == {}


# ---- filling
def test_nearest_donor_brute_force_with_hot_group(spark):
    rng = random.Random(3)
    base = dt.datetime(2020, 1, 1)
    rows = [
        (i, "p", 7 if rng.random() < 0.4 else rng.choice([1, 2, 3, None]), base + dt.timedelta(hours=rng.randrange(0, 400, 7)) if rng.random() > 0.02 else None, rng.random() < 0.5) for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "row_id long, platform string, pid long, at timestamp, has boolean").withColumn("t", F.lit("clash"))
    got = {r["row_id"]: r["from_x"] for r in nearest_donors(df, ["platform", "pid"], "at", "row_id", {"x": F.col("has")}).collect()}
    assert len(got) == len(rows)
    for i, _, pid, at, _ in rows:
        have = [r for r in rows if r[2] == pid and r[4] and r[3] is not None]
        want = min(have, key=lambda r: (abs(r[3] - at), r[0]))[0] if pid is not None and at is not None and have else None
        assert got[i] == want


FILL = "row_id long, platform string, id string, goal double, pledged double, funds_raised_percent double, backers_count long, category_parent_name string, currency string, crawled_at timestamp"


def test_fill(spark):
    t = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    rows = [
        (1, "Indiegogo", "5", 100.0, 0.0, 1.0, 1, "Art", "USD", t(0)), (2, "Indiegogo", "5.0", -1.0, None, float("nan"), 1, "Art", "USD", t(1)), (3, "Indiegogo", "5", 300.0, 5.0, 2.0, 1, "Art", "USD", t(2)),
        (4, "Kickstarter", None, 0.0, 9999999999.0, None, None, None, None, t(0)), (5, "Kickstarter", "5", 999999999.0, 10.0, None, 3, "Art", "USD", t(0)), (2, "Indiegogo", "5.0", -1.0, None, float("nan"), 1, "Art", "USD", t(1)),
    ]
    df = spark.createDataFrame(rows, FILL).withColumn("v", F.lit(1))
    got = fill_from_similar(df, k=2).collect()
    key = sorted((r["row_id"], r["field_name"], r["from_row_id"], r["method"] == "same_project") for r in got)
    two = [(2, f, 1, True) for f in ("funds_raised_percent", "goal", "pledged")]
    assert key == sorted([*two, *two, (4, "goal", -1, False), (4, "pledged", -1, False), (5, "goal", -1, False)])
    assert all(r["filled_value"] is not None for r in got)
    assert fill_from_similar(df.limit(0)).count() == 0


def test_fill_falls_back_to_parent_and_all_and_fills_texts(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(i, "Kickstarter", str(i), 100.0 if i < 8 else None, 10.0, None, 1, "Art" if i % 4 < 3 else "Music", "USD", t) for i in range(9)]
    rows += [(50 + i, "Kickstarter", str(50 + i), None if i == 0 else 7e6, 9e6, None, 900000, "Film", "JPY", t) for i in range(3)]
    rows += [(90, "Kickstarter", "1", 100.0, 10.0, None, 1, None, " n/a ", t), (91, "Kickstarter", None, 100.0, 10.0, None, 1, "Art", None, t)]
    df = spark.createDataFrame(rows, FILL)
    got = {(r["row_id"], r["field_name"]): r for r in fill_from_similar(df, k=2, support=5, categories=("currency", "category_parent_name")).collect()}
    assert got[8, "goal"]["method"] == "cluster" and got[8, "goal"]["filled_value"] == 100.0
    assert got[50, "goal"]["method"] == "all" and got[50, "goal"]["filled_value"] is not None  # two values are too few for a cluster or a group
    assert (got[90, "currency"]["filled_text"], got[90, "currency"]["from_row_id"]) == ("USD", 1)
    assert (got[90, "category_parent_name"]["filled_text"], got[90, "category_parent_name"]["method"]) == ("Art", "same_project")
    assert (got[91, "currency"]["filled_text"], got[91, "currency"]["method"]) == ("USD", "cluster")


def test_held_out_error_of_filling(spark, data):
    e = {(r["field_name"], r["method"]): r["median_error"] for r in fill_errors(spark.read.parquet(f"{data}/sf0.1/combined_all_columns.parquet")).collect()}
    for f in ("goal", "pledged", "funds_raised_percent"):
        assert e[f, "same_project"] < e[f, "cluster"] < e[f, "all"]


def test_k_prototypes_separate_clear_groups(spark):
    rows = [(i, float(i % 2) * 100 + i % 5, "a" if i % 2 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string")
    m = KPrototypes(["x"], ["c"], k=2, passes=5).fit(df, "row_id")
    got = df.withColumn("g", m.assign()).groupBy("c").agg(F.count_distinct("g").alias("n")).collect()
    assert all(r["n"] == 1 for r in got)


def test_running_values_over_buckets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(200)), rng.random() < 0.2, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp, h boolean, v long")
    n = {r["i"]: r["n"] for r in running_count(df, ["k"], ["ts", "i"], F.col("h"), "n", "ts").collect()}
    last = {r["i"]: r["l"] for r in carry_last(df, ["k"], [F.col("ts"), F.col("i")], F.col("v"), "l", "ts").collect()}
    for k in "ab":
        count, seen = 0, None
        for i, _, _, h, v in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            count, seen = count + h, v if v is not None else seen
            assert n[i] == count and last[i] == seen
