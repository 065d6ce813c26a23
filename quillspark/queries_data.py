"""The queries of the data-preparation operators of the core: p3, p4 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.impute import fill_errors, fill_from_similar
from .operators.tables import whole_days
from .operators.timestamps import instants_to_mend, normalise_timestamps
from .operators.units import amounts_in_common_unit
from .queries_tables import pid
from .session import ship_package, spread, table


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return amounts_in_common_unit(spread(table(spark, d, "combined_all_columns")), table(spark, d, "money_units"), table(spark, d, "fx_rates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).filter(F.col("unit_id").isNotNull() & (F.col("told_by") != "plain")).select("row_id", "field_name", "unit_id")


def p3_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every present amount in US dollars, with the unit it was recorded in and what told it (`other` for the currency
    field or the text)."""
    told = F.when(F.col("told_by").isin("currency", "text"), "other").otherwise(F.col("told_by"))
    return _amounts(spark, d).select("row_id", "field_name", F.round("value", 6).alias("value"), "unit_id", told.alias("told_by"), F.round("usd", 4).alias("usd"))


def _filled(spark: SparkSession, d: str, categories: tuple[str, ...] = ()) -> DataFrame:
    ship_package(spark)
    return fill_from_similar(table(spark, d, "combined_all_columns"), categories=categories)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("row_id", "field_name", "from_row_id")


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every missing number, currency and parent category with its fill and the method that gave it."""
    return _filled(spark, d, ("currency", "category_parent_name"))


def p4_donors(spark: SparkSession, d: str) -> DataFrame:
    """The fills that come from the same project, with the donor's value."""
    x = _filled(spark, d).filter("method = 'same_project'")
    return x.select("row_id", "field_name", "from_row_id", F.round("filled_value", 6).alias("filled_value"), "method")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """Held-out error of each method of filling."""
    ship_package(spark)
    return fill_errors(table(spark, d, "combined_all_columns"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return instants_to_mend(spark, table(spark, d, "combined_all_columns"), table(spark, d, "crawl_sources"))


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three dates with its instant."""
    return _instants(spark, d).select("row_id", "field_name", "is_plain", "epoch_s")


def p5_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How the instants of the three dates were told, and how often."""
    return _instants(spark, d).groupBy("field_name", "status").agg(F.count("*").alias("n"))


def preparation_time(spark: SparkSession, d: str) -> DataFrame:
    """Whole days from creation to launch of every row, from the instants of all spellings; null where one tells none."""
    at = lambda f: F.max(F.when(F.col("field_name") == f, F.col("epoch_s")))
    x = normalise_timestamps(table(spark, d, "combined_all_columns"), ["created_at", "launched_at"], table(spark, d, "crawl_sources"))
    g = x.groupBy("row_id").agg(at("launched_at").alias("launched"), at("created_at").alias("made"))
    return g.select("row_id", whole_days(F.col("launched"), F.col("made")).alias("preparation_days"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    return normalise_timestamps(
        table(spark, d, "combined_all_columns"), ["created_at", "launched_at", "deadline"], table(spark, d, "crawl_sources")
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_amounts, p4_found, p4_filled, p4_donors, p4_errors, p5_found, p5_normalised, p5_statuses, preparation_time)}

_FIELDS = ("goal", "pledged", "funds_raised_percent")


def _gone(f: str) -> str:
    zero = f" OR {f} = 0" if f == "goal" else ""
    return f"({f} IS NULL OR isnan({f}) OR {f} < 0{zero} OR ({f} >= 999999999 AND regexp_matches(printf('%.0f', CAST({f} AS DOUBLE)), '^9{{9,}}$')))"


_LONG = " UNION ALL ".join(
    f"SELECT row_id, platform, pid, crawled_at, '{f}' AS field_name, {_gone(f)} AS gone FROM c" + (" WHERE NOT (platform = 'Kickstarter' AND " + _gone(f) + ")" if f == "funds_raised_percent" else "") for f in _FIELDS
)
_ABBR = [("America/New_York", "EST", -5), ("America/New_York", "EDT", -4), ("America/Los_Angeles", "PST", -8), ("America/Los_Angeles", "PDT", -7), ("Europe/Berlin", "CET", 1), ("Europe/Berlin", "CEST", 2), ("Europe/London", "GMT", 0), ("Europe/London", "BST", 1), ("Australia/Sydney", "AEST", 10), ("Australia/Sydney", "AEDT", 11), ("Asia/Tokyo", "JST", 9), ("Asia/Kolkata", "IST", 5.5)]
_ANY = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%a, %d %B %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%B %d, %Y %I:%M %p"]
_DAY_FIRST = ["%d/%m/%Y %H:%M", "%d.%m.%Y %H:%M", "%d/%m/%Y %I:%M %p"]
_MONTH_FIRST = ["%m/%d/%Y %H:%M", "%m.%d.%Y %H:%M", "%m/%d/%Y %I:%M %p"]
_FORMATS = "CASE WHEN day_first THEN try_strptime(body, {}) ELSE try_strptime(body, {}) END".format(*(str(_ANY + x) for x in (_DAY_FIRST, _MONTH_FIRST)))
_CODES = [("CAD", r"CAD|C\$|CA\$|CDN\$|CANADIAN"), ("AUD", r"AUD|^A\$|AU\$|AUSTRALIAN"), ("USD", r"USD|US DOLLAR|U\.S\. DOLLAR|DOLLARS \(US\)|US\$|US CENT"), ("EUR", "EUR|€"), ("GBP", "GBP|£|POUND|PENCE"), ("JPY", "JPY|YEN|円|JP¥"), ("SEK", "SEK|ÖRE|SWEDISH|SVENSKA"), ("CHF", r"CHF|SFR|^FR\.|SWISS|RAPPEN"), ("MXN", r"MXN|MX\$|PESO")]
_CODE = "CASE " + " ".join(f"WHEN regexp_matches(u, '{r}') THEN '{c}'" for c, r in _CODES) + " END"
_SCALE = """CASE WHEN said = 'GBp' OR regexp_matches(u, 'CENT|PENCE|¢|MINOR|X 0[.]01|HUNDREDTH|ÖRE|RAPPEN|^P |^CT ') THEN 'minor' WHEN regexp_matches(u, 'THOUSAND| K$|^[KT][A-Z]{3}$|''000|X1000|1,000') THEN 'thousand'
 WHEN regexp_matches(u, 'MILLION|MIO|^M[A-Z]{3}$') THEN 'million' ELSE 'major' END"""
_NOTE = r"(?:Figures on this page are in|read the numbers as|Goal and pledges given in|report funding in|Totals shown in|money counted in|Sums are|keeps the account in|all amounts in|Amounts:) ((?:[^ .,)]+ ?){1,6})"
_EXACT = "coalesce(currency IN (SELECT currency_code FROM money_units), false)"
# A whole-table self-join: fine on the small tables that it checks, and exact.
SQL: dict[str, str] = {
    "p3_found": f"""WITH c AS (SELECT row_id, currency, {', '.join(f"CASE WHEN NOT {_gone(f)} THEN {f} END AS {f}" for f in ('goal', 'pledged'))}, coalesce(CASE WHEN NOT isnan(percent_funded) THEN percent_funded END, CASE WHEN NOT isnan(funds_raised_percent) THEN funds_raised_percent END) AS share,
  {_EXACT} AS exact, coalesce(lower(trim(currency)) IN ('', 'n/a'), true) AS blank, regexp_replace(concat_ws(' | ', name, blurb, story_content), '[\\s\\x{{A0}}]+', ' ', 'g') AS txt FROM combined_all_columns),
 n AS (SELECT *, CASE WHEN exact THEN currency WHEN NOT blank THEN trim(currency) ELSE coalesce(nullif(regexp_extract(txt, '{_NOTE}', 1), ''), nullif(regexp_extract(txt, '[[]([A-Za-zö ]+)[]]', 1), ''), regexp_extract(txt, '[*]([^,*]+), not anything else', 1)) END AS said FROM c),
 u AS (SELECT *, {_CODE} AS code, {_SCALE} AS scale FROM (SELECT *, upper(said) AS u FROM n)), o AS (SELECT *, CASE WHEN exact AND goal > 0 AND pledged > 0 AND share > 0 THEN log10(pledged / goal * 100 / share) END AS off FROM u),
 l AS (SELECT row_id, 'goal' AS field_name, goal AS v, exact, code, CASE WHEN NOT exact THEN scale WHEN abs(off + 2) < 0.25 THEN 'minor' WHEN abs(off - 3) < 0.25 THEN 'thousand' WHEN abs(off - 6) < 0.25 THEN 'million' END AS scale FROM o
  UNION ALL SELECT row_id, 'pledged', pledged, exact, code, CASE WHEN NOT exact THEN scale WHEN abs(off - 2) < 0.25 THEN 'minor' WHEN abs(off + 3) < 0.25 THEN 'thousand' WHEN abs(off + 6) < 0.25 THEN 'million' END FROM o)
SELECT row_id, field_name, unit_id FROM l JOIN money_units ON code = currency_code AND scale = scale_name WHERE v IS NOT NULL""",
    "p4_found": f"""WITH c AS (SELECT row_id, platform, {pid('id')} AS pid, crawled_at, {', '.join(_FIELDS)} FROM combined_all_columns), l AS ({_LONG})
SELECT m.row_id, m.field_name, coalesce(arg_min(h.row_id, struct_pack(d := abs(epoch_us(h.crawled_at) - epoch_us(m.crawled_at)), r := h.row_id)), -1) AS from_row_id
FROM (SELECT * FROM l WHERE gone) m LEFT JOIN (SELECT * FROM l WHERE NOT gone AND pid IS NOT NULL) h ON m.platform = h.platform AND m.pid = h.pid AND m.field_name = h.field_name GROUP BY m.row_id, m.field_name""",
    "p4_donors": f"""WITH c AS (SELECT row_id, platform, {pid('id')} AS pid, crawled_at, {', '.join(_FIELDS)} FROM combined_all_columns), l AS ({_LONG}), v AS (UNPIVOT (SELECT row_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FIELDS)} FROM c) ON {', '.join(_FIELDS)} INTO NAME field_name VALUE x),
 d AS (SELECT m.row_id, m.field_name, arg_min(h.row_id, struct_pack(d := abs(epoch_us(h.crawled_at) - epoch_us(m.crawled_at)), r := h.row_id)) AS from_row_id FROM (SELECT * FROM l WHERE gone) m JOIN (SELECT * FROM l WHERE NOT gone AND pid IS NOT NULL) h ON m.platform = h.platform AND m.pid = h.pid AND m.field_name = h.field_name GROUP BY m.row_id, m.field_name)
SELECT d.row_id, d.field_name, from_row_id, round(x, 6) AS filled_value, 'same_project' AS method FROM d JOIN v ON v.row_id = from_row_id AND v.field_name = d.field_name""",
    "p5_found": f"""WITH v AS (SELECT row_id, source_url, 'created_at' AS field_name, created_at AS raw FROM combined_all_columns UNION ALL SELECT row_id, source_url, 'deadline', deadline FROM combined_all_columns
 UNION ALL SELECT row_id, source_url, 'launched_at', CAST(launched_at AS VARCHAR) FROM combined_all_columns),
 t AS (SELECT row_id, field_name, raw, trim(raw) AS t, time_zone, day_first FROM v LEFT JOIN crawl_sources USING (source_url)
  WHERE NOT (field_name = 'launched_at' AND regexp_matches(raw, '^[1-9][0-9]{{8,9}}$')) AND NOT (field_name <> 'launched_at' AND regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$'))),
 z AS (SELECT *, regexp_extract(t, '(?:[0-9]T[0-9]{{6}}|:[0-9]{{2}}(?:[.][0-9]+)?(?: ?[AP]M)?) ?(Z|(?:UTC|GMT)?[+-][0-9]{{2}}:?[0-9]{{2}}|[A-Z]{{3,4}})$', 1) AS z FROM t),
 b AS (SELECT *, regexp_replace(trim(substr(t, 1, length(t) - length(z))), '[.][0-9]+$', '') AS body FROM z),
 p AS (SELECT *, CASE WHEN NOT regexp_matches(body, '^[0-9.]+$') OR regexp_matches(body, '^[0-9]{{1,2}}[.]') THEN {_FORMATS} END AS l FROM b),
 o AS (SELECT p.*, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_matches(z, '[0-9]$') THEN (CASE WHEN contains(z, '-') THEN -1 ELSE 1 END) * (CAST(regexp_extract(z, '[+-]([0-9]{{2}})', 1) AS INTEGER) * 3600 + CAST(substr(z, length(z) - 1) AS INTEGER) * 60) ELSE CAST(h * 3600 AS INTEGER) END AS off,
  epoch(timezone(time_zone, l)) AS u FROM p LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in _ABBR)}) a(tz, ab, h) ON time_zone = tz AND z = ab),
 e AS (SELECT row_id, field_name, CASE WHEN regexp_matches(t, '^[0-9]{{9,10}}([.][0-9]*)?$') THEN CAST(split_part(t, '.', 1) AS BIGINT) WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN CAST(t AS BIGINT) // 1000 WHEN regexp_matches(t, '^[0-9]{{16}}$') THEN CAST(t AS BIGINT) // 1000000
  WHEN regexp_matches(t, '^[0-9]{{19}}$') THEN CAST(t AS BIGINT) // 1000000000 WHEN z <> '' THEN CAST(epoch(l) AS BIGINT) - off WHEN timezone(time_zone, to_timestamp(u - 3600)) = l THEN CAST(u AS BIGINT) - 3600 ELSE CAST(u AS BIGINT) END AS epoch_s FROM o)
SELECT row_id, field_name, CAST(epoch_s AS BIGINT) AS epoch_s FROM e WHERE epoch_s IS NOT NULL""",
}
# Every present amount: the unit as above, else the plain one of the exact code; every date, plain or mended.
SQL["p3_amounts"] = SQL["p3_found"].replace("SELECT row_id, field_name, unit_id FROM l JOIN", """, b AS (SELECT row_id, strftime(crawled_at, '%Y-%m') AS month, currency, """ + _EXACT + """ AS exact FROM combined_all_columns),
 a AS (SELECT l.row_id, l.field_name, l.v AS value, CASE WHEN l.exact THEN b.currency ELSE l.code END AS code, CASE WHEN l.exact THEN coalesce(l.scale, 'major') ELSE l.scale END AS scale, l.exact, l.scale IS NOT NULL AS told, month FROM l JOIN b USING (row_id) WHERE l.v IS NOT NULL)
SELECT row_id, field_name, round(value, 6) AS value, unit_id, CASE WHEN unit_id IS NULL THEN 'nothing' WHEN exact AND told THEN 'share' WHEN exact THEN 'plain' ELSE 'other' END AS told_by, round(value * major_per_unit * usd_per_major, 4) AS usd
FROM a LEFT JOIN money_units u ON a.code = u.currency_code AND a.scale = u.scale_name LEFT JOIN fx_rates r ON u.currency_code = r.currency_code AND month = fx_month --""")
SQL["p5_normalised"] = "WITH f AS (" + SQL["p5_found"] + """), v AS (SELECT row_id, 'created_at' AS field_name, created_at AS raw FROM combined_all_columns UNION ALL SELECT row_id, 'deadline', deadline FROM combined_all_columns
 UNION ALL SELECT row_id, 'launched_at', CAST(launched_at AS VARCHAR) FROM combined_all_columns),
 p AS (SELECT *, coalesce(CASE WHEN field_name = 'launched_at' THEN regexp_matches(raw, '^[1-9][0-9]{8,9}$') ELSE regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') END, false) AS is_plain FROM v)
SELECT row_id, field_name, is_plain, CASE WHEN NOT is_plain THEN f.epoch_s WHEN field_name = 'launched_at' THEN CAST(raw AS BIGINT) ELSE CAST(epoch(try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) END AS epoch_s FROM p LEFT JOIN f USING (row_id, field_name)"""
SQL["preparation_time"] = "SELECT row_id, CAST(floor((max(epoch_s) FILTER (field_name = 'launched_at') - max(epoch_s) FILTER (field_name = 'created_at')) / 86400.0::DOUBLE) AS BIGINT) AS preparation_days FROM (" + SQL["p5_normalised"] + ") GROUP BY 1"
