"""Queries over tables: alignment, filters, joins, duplicates, summaries, windows, reshaping; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions.keys import project_number
from .operators import tables as T
from .session import table
from .sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = X.WS
NUM_ID = r"""CASE WHEN regexp_matches(regexp_replace({c}, '[\s\x{A0},]+', '', 'g'), '^\d+(\.\d*)?([eE][+-]?\d{1,2})?$')
 THEN CAST(TRY_CAST(regexp_replace({c}, '[\s\x{A0},]+', '', 'g') AS DECIMAL(38,6)) AS BIGINT) END"""


def pid(c: str) -> str:
    return NUM_ID.replace("{c}", c)


def nn(c: str) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TARGETS = ["id", "name", "blurb", "category", "category_url", "project_url", "created_date", "deadline", "pledged_amount", "goal_amount", "backers_count", "currency", "image_url", "state", "source_url"]
KS = ["id", "name", "blurb", "category_parent_name", "category_url", "project_url", "created_at", "deadline", "pledged", "goal", "backers_count", "currency", "photo_full", "state", "source_url"]
IG = [*KS[:13], "is_indemand", "source_url"]


def _std(cols: list[str], platform: str) -> str:
    text = lambda c: f"round(CAST({c} AS DOUBLE), 4)" if c in ("pledged", "goal") else f"CAST({c} AS VARCHAR)"
    return f"SELECT '{platform}' AS platform, " + ", ".join(f"{text(c)} AS {t}" for c, t in zip(cols, TARGETS)) + f" FROM combined_all_columns WHERE platform = '{platform}'"


@query(_std(KS, "Kickstarter") + " UNION ALL " + _std(IG, "Indiegogo"))
def standardize_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sources under one schema, both amounts as doubles; NaN stays NaN, null stays null."""
    c = table(spark, d, "combined_all_columns")
    parts = [T.standardise(c.filter(F.col("platform") == p), dict(zip(TARGETS, cols)), p) for p, cols in (("Kickstarter", KS), ("Indiegogo", IG))]
    return T.union_all(*parts).withColumns({a: T.rounded(F.col(a).cast("double"), 4) for a in ("pledged_amount", "goal_amount")})


@query("SELECT row_id, round(TRY_CAST(replace(CAST(backers_count AS VARCHAR) || '%', '%', '') AS DOUBLE), 6) AS share, CASE WHEN regexp_matches(deadline, '^[0-9]+$') THEN TRY_CAST(deadline AS DOUBLE) END AS other FROM combined_all_columns")
def percent_strings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a percent sign; texts that are none are null."""
    c = table(spark, d, "combined_all_columns")
    return c.select("row_id", F.round(T.percent(F.concat(F.col("backers_count").cast("string"), F.lit("%"))), 6).alias("share"), F.when(F.col("deadline").rlike("^[0-9]+$"), T.percent(F.col("deadline"))).alias("other"))


@query(rf"""SELECT row_id, regexp_replace(id, '\.0$', '') AS clean_id, {pid('id')} AS project_id, TRY_CAST(replace(deadline, '%', '') AS BIGINT) AS deadline_number
FROM combined_all_columns""")
def id_cleanup_cast(spark: SparkSession, d: str) -> DataFrame:
    """Suffix cut, the number in an id, safe casts."""
    c = table(spark, d, "combined_all_columns")
    bare = F.replace(F.col("deadline"), F.lit("%"), F.lit(""))
    return c.select("row_id", T.clean_id(F.col("id")).alias("clean_id"), project_number(F.col("id")).alias("project_id"), F.when(bare.rlike(r"^\s*\d+\s*$"), F.trim(bare).try_cast("bigint")).when(bare.rlike(r"^\d+\.\d+$"), F.round(bare.try_cast("decimal(38,6)")).try_cast("bigint")).alias("deadline_number"))


_GOAL = f"""SELECT row_id, platform, CASE WHEN platform = 'Indiegogo' AND {nn('goal')} IS NULL AND {nn('pledged')} > 0 AND {nn('funds_raised_percent')} > 0
 THEN {nn('pledged')} / ({nn('funds_raised_percent')} / 100) ELSE {nn('goal')} END AS goal,
 CASE WHEN platform = 'Kickstarter' THEN {nn('percent_funded')} WHEN platform = 'Indiegogo' THEN {nn('funds_raised_percent')} END AS pct, state FROM combined_all_columns"""


@query(f"""WITH g AS ({_GOAL}) SELECT row_id, round(goal, 4) AS goal, round(pct, 4) AS funding_percent,
 CAST(coalesce(pct >= 100, false) OR coalesce(state = 'successful', false) AS INTEGER) AS success, CAST(coalesce(pct >= 100, false) AS INTEGER) AS goal_reached,
 round(ln(greatest(coalesce(pct / 100 * goal, 0), 1)), 6) AS log_pledged, round(CASE WHEN goal IS NOT NULL THEN ln(greatest(goal, 1)) END, 6) AS log_goal FROM g""")
def goal_impute_success(spark: SparkSession, d: str) -> DataFrame:
    """Goals from shares, one funding percent, success, logarithms."""
    c = table(spark, d, "combined_all_columns")
    goal = T.impute_goal(F.col("platform"), F.col("goal"), F.col("pledged"), F.col("funds_raised_percent"))
    g = c.select("row_id", "state", goal.alias("goal"), T.funding_percent(F.col("platform"), F.col("percent_funded"), F.col("funds_raised_percent")).alias("pct"))
    return g.select(
        "row_id", F.round("goal", 4).alias("goal"), F.round("pct", 4).alias("funding_percent"), T.success(F.col("pct"), F.col("state")).alias("success"),
        T.success(F.col("pct")).alias("goal_reached"), F.round(T.log_floor(F.col("pct") / 100 * F.col("goal"), True), 6).alias("log_pledged"), F.round(T.log_floor(F.col("goal")), 6).alias("log_goal"),
    )


ISO_ANY = r"^\s*(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(?:Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"


def wall_clock_iso() -> Column:
    """created_at without its zone, the wall clock kept (D18), from all forms of ISO 8601: blank or T, fractions (to
    microseconds), no seconds, a date alone (its midnight), without hyphens and colons, offsets of all forms; other
    spellings are null."""
    g = lambda i: F.regexp_extract("created_at", ISO_ANY, i)
    or0 = lambda c: F.when(c == "", "00").otherwise(c)
    text = F.concat(F.concat_ws("-", g(1), g(3), g(4)), F.lit(" "), F.concat_ws(":", or0(g(5)), or0(g(6)), or0(g(7))), F.when(g(8) != "", F.concat(F.lit("."), g(8))).otherwise(""))
    return F.when(F.col("created_at").rlike(ISO_ANY), text.try_cast("timestamp_ntz"))


_SQL_ISO = r"^\s*([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ]([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?)?\s*(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\s*$"
_SQL_PART = lambda i: f"regexp_extract(created_at, '{_SQL_ISO}', {i})"
_SQL_OR0 = lambda i: f"CASE WHEN {_SQL_PART(i)} = '' THEN '00' ELSE {_SQL_PART(i)} END"
_WALL = f"""CASE WHEN regexp_matches(created_at, '{_SQL_ISO}') AND regexp_matches(created_at, '^\\s*[0-9]{{4}}(-[0-9]{{2}}-|[0-9]{{2}}[0-9])') THEN TRY_CAST(concat({_SQL_PART(1)}, '-', {_SQL_PART(2)}, '-', {_SQL_PART(3)}, ' ', {_SQL_OR0(4)}, ':', {_SQL_OR0(5)}, ':', {_SQL_OR0(6)},
 CASE WHEN {_SQL_PART(7)} <> '' THEN '.' || {_SQL_PART(7)} ELSE '' END) AS TIMESTAMP) END"""


@query(f"""WITH c AS (SELECT row_id, platform, {_WALL} AS t FROM combined_all_columns)
SELECT row_id, CAST(coalesce(t > TIMESTAMP '2022-11-30 00:00:00', false) AS INTEGER) AS post, CAST(coalesce(platform = 'Indiegogo', false) AS INTEGER) AS indiegogo,
 CAST(coalesce(t > TIMESTAMP '2022-11-30 00:00:00', false) AND coalesce(platform = 'Indiegogo', false) AS INTEGER) AS post_indiegogo,
 CAST(month(t) AS INTEGER) AS month, CAST(year(t) AS INTEGER) AS year, strftime(t, '%Y-%m') AS month_year FROM c""")
def treatment_flags(spark: SparkSession, d: str) -> DataFrame:
    """After the cutoff (a parameter), by platform, and parts of the date."""
    c = table(spark, d, "combined_all_columns").select("row_id", "platform", wall_clock_iso().alias("t"))
    post = F.coalesce(F.col("t") > F.lit("2022-11-30 00:00:00").cast("timestamp_ntz"), F.lit(False)).cast("int")
    ig = F.coalesce(F.col("platform") == "Indiegogo", F.lit(False)).cast("int")
    return c.select("row_id", post.alias("post"), ig.alias("indiegogo"), (post * ig).alias("post_indiegogo"), F.month("t").alias("month"), F.year("t").alias("year"), F.date_format("t", "yyyy-MM").alias("month_year"))


def _case(platform: str, col: str) -> str:
    q = lambda s: s.replace("'", "''")
    return " ".join(f"WHEN platform = '{platform}' AND {col} IN ({', '.join(chr(39) + q(n) + chr(39) for n in names)}) THEN '{g}'" for g, names in T.CATEGORY_GROUPS[platform].items())


@query(f"SELECT row_id, CASE {_case('Kickstarter', 'category_name')} {_case('Indiegogo', 'category_parent_name')} ELSE 'Other' END AS category_unified FROM combined_all_columns")
def category_unify(spark: SparkSession, d: str) -> DataFrame:
    """Groups of categories."""
    return T.unify_category(table(spark, d, "combined_all_columns")).select("row_id", "category_unified")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT) AS days, CAST(count(*) AS BIGINT) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def funding_duration(spark: SparkSession, d: str) -> DataFrame:
    """Whole days between two instants, rounded down."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", "l_linenumber", T.whole_days(secs("l_shipdate"), secs("o_orderdate")).alias("days")).agg(F.count("*").alias("n"))


@query(f"""SELECT platform, currency, CAST(count(*) AS BIGINT) AS n, CAST(count_if(percent_funded >= 100) AS BIGINT) AS n_success FROM combined_all_columns
WHERE currency = 'USD' AND {nn('pledged')} > 0 AND story_content IS NOT NULL AND platform = 'Kickstarter' AND {_WALL} IS NOT NULL GROUP BY ALL""")
def analysis_sample(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the models use, and how many succeeded."""
    c = table(spark, d, "combined_all_columns")
    c = c.filter((F.col("currency") == "USD") & (F.nanvl("pledged", F.lit(None)) > 0) & (F.col("platform") == "Kickstarter")).na.drop(subset=["story_content"]).filter(wall_clock_iso().isNotNull())
    return c.groupBy("platform", "currency").agg(F.count("*").alias("n"), F.count_if(F.col("percent_funded") >= 100).alias("n_success"))


@query(r"""SELECT row_id, CASE WHEN contains(project_url, '/projects/') THEN trim(split_part(split_part(split_part(project_url, '?', 1), '#', 1), '/projects/', 2), '/') ELSE '' END AS slug
FROM combined_all_columns WHERE regexp_matches(project_url, '(?i)ks.example')""")
def url_filter_slug(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by pattern, whatever their case; the part after /projects/."""
    c = table(spark, d, "combined_all_columns").filter(F.coalesce(F.col("project_url").rlike("(?i)ks.example"), F.lit(False)))
    return c.select("row_id", X.slug(F.col("project_url")).alias("slug"))


@query(rf"""SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(count_if(regexp_matches(t, '(?i)\b(warranty|prototype|prototypes)\b')) AS BIGINT) AS n_hits FROM (
 SELECT 'updates' AS role, body AS t FROM updates UNION ALL SELECT 'stories', story_content FROM stories) WHERE t IS NOT NULL AND regexp_replace(t, '{WS}', '', 'g') <> '' GROUP BY role""")
def keyword_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Texts that aren't blank, and those with a term, by the role of their table."""
    u = table(spark, d, "updates").select(F.lit("updates").alias("role"), F.col("body").alias("t"))
    s = table(spark, d, "stories").select(F.lit("stories").alias("role"), F.col("story_content").alias("t"))
    x = u.unionByName(s).filter(F.col("t").isNotNull() & X.holds_text(F.col("t")))
    return x.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("t").rlike(r"(?i)\b(warranty|prototype|prototypes)\b")).alias("n_hits"))


@query(r"""SELECT id, coalesce(regexp_matches(body, '(?i)\b(patent|patents|patent pending|patented|patenting)\b'), false) AS patent FROM updates""")
def patent_flag(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name a patent; null is false."""
    return table(spark, d, "updates").select("id", X.has_patent_terms(F.col("body")).alias("patent"))


_HINTS = ["Access denied", "Error code", "You have been blocked", "Incident"]


@query("SELECT story_row_id, " + " + ".join(f"CAST(coalesce(contains(story_content, '{h}'), false) AS INTEGER)" for h in _HINTS) + " >= 2 AS challenged FROM stories")
def challenge_predicate(spark: SparkSession, d: str) -> DataFrame:
    """At least two indicators."""
    return table(spark, d, "stories").select("story_row_id", X.challenge_present(F.col("story_content"), _HINTS).alias("challenged"))


@query("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)
WHERE rn = 1""".replace("SELECT * FROM", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM", 1))
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key by a full order."""
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return T.first_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT DISTINCT id, project_slug, author, author_id, body, created_at, parent_id, project_id FROM comments")
def comments_seen_once(spark: SparkSession, d: str) -> DataFrame:
    """Each comment once, rows without an id kept."""
    c = table(spark, d, "comments").select("id", "project_slug", "author", "author_id", "body", "created_at", "parent_id", "project_id")
    return io.merge_batches(c, "id", [F.col("body"), F.col("created_at"), F.col("author"), F.col("project_id")])


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_common FROM (SELECT {pid('id')} AS k FROM combined_all_columns INTERSECT SELECT {pid('id')} FROM stories) WHERE k IS NOT NULL")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two tables share."""
    a, b = (table(spark, d, t).select(project_number(F.col("id")).alias("k")).filter("k is not null") for t in ("combined_all_columns", "stories"))
    return a.intersect(b).agg(F.count("*").alias("n_common"))


@query(f"""WITH m AS (SELECT platform, k AS project_id, category_parent_name FROM (SELECT platform, {pid('id')} AS k, category_parent_name, row_number() OVER (PARTITION BY platform, {pid('id')} ORDER BY crawled_at, row_id) AS rn
 FROM combined_all_columns) WHERE rn = 1 AND k IS NOT NULL), s AS (SELECT story_row_id, platform, {pid('id')} AS k FROM stories WHERE id IS NOT NULL)
SELECT story_row_id, s.platform, k AS project_id, category_parent_name FROM s LEFT JOIN m ON s.platform = m.platform AND s.k = m.project_id WHERE k IS NOT NULL""")
def stories_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """stories left-joined to the first metadata row of their project."""
    m = T.known_projects(table(spark, d, "combined_all_columns")).select("platform", "project_id", "category_parent_name", "crawled_at", "row_id")
    m = T.first_by(m, ["platform", "project_id"], [F.col("crawled_at"), F.col("row_id")]).drop("crawled_at", "row_id")
    s = T.known_projects(table(spark, d, "stories")).select("story_row_id", "platform", "project_id")
    return s.join(m, ["platform", "project_id"], "left").select("story_row_id", "platform", "project_id", "category_parent_name")


@query(f"""WITH s AS (SELECT platform, {pid('id')} AS project_id, story_content, scrape_round, story_row_id FROM stories), r AS (SELECT *, row_number() OVER (PARTITION BY platform, project_id ORDER BY
 CAST(coalesce(story_content <> '', false) AS INTEGER) DESC, scrape_round, CASE WHEN scrape_round = 1 THEN -story_row_id ELSE story_row_id END) AS rn FROM s WHERE project_id IS NOT NULL)
SELECT platform, project_id, story_row_id, scrape_round, md5(story_content) AS story_md5 FROM r WHERE rn = 1""")
def story_multi_round(spark: SparkSession, d: str) -> DataFrame:
    """one story a project: the last of round 1, filled from later rounds."""
    s = T.known_projects(table(spark, d, "stories")).select("platform", "project_id", "story_content", "scrape_round", "story_row_id")
    return T.fill_rounds(s, ["platform", "project_id"]).select("platform", "project_id", "story_row_id", "scrape_round", F.md5("story_content").alias("story_md5"))


@query("""SELECT platform, CAST(count(*) AS BIGINT) AS n, CAST(count_if(coalesce(story_content <> '', false)) AS BIGINT) AS n_with, round(count_if(coalesce(story_content <> '', false)) / nullif(count(*), 0), 6) AS coverage
FROM stories GROUP BY platform""")
def story_coverage(spark: SparkSession, d: str) -> DataFrame:
    """how many rows have a text, by platform."""
    has = F.coalesce(F.col("story_content") != "", F.lit(False))
    return table(spark, d, "stories").groupBy("platform").agg(F.count("*").alias("n"), F.count_if(has).alias("n_with"), F.round(F.avg(has.cast("double")), 6).alias("coverage"))


@query(f"""WITH p AS (SELECT DISTINCT platform, {pid('id')} AS project_id FROM combined_all_columns WHERE {pid('id')} IS NOT NULL), u AS (SELECT DISTINCT {pid('project_id')} AS k FROM updates),
c AS (SELECT DISTINCT {pid('project_id')} AS k FROM comments) SELECT platform, CAST(count(*) AS BIGINT) AS n, CAST(count_if(project_id IN (SELECT k FROM u WHERE k IS NOT NULL)) AS BIGINT) AS with_updates,
 CAST(count_if(project_id NOT IN (SELECT k FROM c WHERE k IS NOT NULL)) AS BIGINT) AS without_comments FROM p GROUP BY platform""")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    """Projects with updates, and projects without comments."""
    p = T.known_projects(table(spark, d, "combined_all_columns")).select("platform", "project_id").distinct()
    k = lambda t: table(spark, d, t).select(project_number(F.col("project_id")).alias("project_id")).filter("project_id is not null").distinct()
    a = p.join(k("updates"), "project_id", "left_semi").groupBy("platform").agg(F.count("*").alias("with_updates"))
    b = p.join(k("comments"), "project_id", "left_anti").groupBy("platform").agg(F.count("*").alias("without_comments"))
    n = p.groupBy("platform").agg(F.count("*").alias("n"))
    return n.join(a, "platform", "left").join(b, "platform", "left").na.fill(0).select("platform", "n", "with_updates", "without_comments")


@query(f"""WITH p AS (SELECT {pid('id')} AS k, min(project_url) AS url FROM combined_all_columns GROUP BY 1 HAVING k IS NOT NULL)
SELECT CAST(k AS VARCHAR) AS project_id, url AS project_url, CASE WHEN coalesce(url, '') = '' THEN 'skip' ELSE 'no_data' END AS error_stage, CASE WHEN coalesce(url, '') = '' THEN 'no address' ELSE 'no comments' END AS error_message
FROM p WHERE k NOT IN (SELECT {pid('project_id')} FROM comments WHERE {pid('project_id')} IS NOT NULL)""")
def failure_list(spark: SparkSession, d: str) -> DataFrame:
    """Projects that couldn't be scored, and why."""
    p = T.known_projects(table(spark, d, "combined_all_columns")).groupBy("project_id").agg(F.min("project_url").alias("url"))
    c = table(spark, d, "comments").select(project_number(F.col("project_id")).alias("project_id")).filter("project_id is not null")
    none = F.coalesce(F.col("url"), F.lit("")) == ""
    return io.failure_rows(p.join(c, "project_id", "left_anti"), "project_id", "url", F.when(none, "skip").otherwise("no_data"), F.when(none, "no address").otherwise("no comments"))


@query("SELECT DISTINCT project_id AS id FROM scrape_failures WHERE error_message IS NOT NULL AND project_id IS NOT NULL")
def ids_of_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a summary by status."""
    s = table(spark, d, "scrape_failures").select("project_id", F.when(F.col("error_message").isNotNull(), "Success").alias("status"))
    return io.ids_with_data(s)


@query("""SELECT t.id AS thread_id, t.project_id, CAST(count(r.id) AS BIGINT) AS n_replies, min(r.created_at) AS first_reply FROM (SELECT DISTINCT id, project_id FROM comments WHERE parent_id IS NULL) t
LEFT JOIN (SELECT DISTINCT id, parent_id, created_at FROM comments WHERE parent_id IS NOT NULL) r ON r.parent_id = t.id GROUP BY ALL""")
def comment_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads with their replies."""
    c = table(spark, d, "comments")
    top = c.filter("parent_id is null").select(F.col("id").alias("thread_id"), "project_id").distinct()
    r = c.filter("parent_id is not null").select("id", "parent_id", "created_at").distinct().groupBy(F.col("parent_id").alias("thread_id")).agg(F.count("id").alias("n_replies"), F.min("created_at").alias("first_reply"))
    return top.join(r, "thread_id", "left").select("thread_id", "project_id", F.coalesce("n_replies", F.lit(0)).alias("n_replies"), "first_reply")


@query("""SELECT category_parent_name, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM combined_all_columns), 6) AS pct FROM combined_all_columns WHERE category_parent_name IS NOT NULL GROUP BY 1""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """H1: counts and shares of all rows."""
    return T.value_counts(table(spark, d, "combined_all_columns"), "category_parent_name")


@query("SELECT currency, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM combined_all_columns), 6) AS pct FROM combined_all_columns GROUP BY 1")
def value_counts_with_null(spark: SparkSession, d: str) -> DataFrame:
    """H2: null as a group."""
    return T.value_counts(table(spark, d, "combined_all_columns"), "currency", keep_null=True)


@query("SELECT strftime(crawled_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM combined_all_columns GROUP BY 1")
def counts_by_month(spark: SparkSession, d: str) -> DataFrame:
    """H3: counts by month."""
    return table(spark, d, "combined_all_columns").groupBy(F.date_format("crawled_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT platform, " + ", ".join(f"CAST(count_if(state = '{s}') AS BIGINT) AS {s}" for s in ("canceled", "failed", "live", "successful")) + " FROM combined_all_columns WHERE state IS NOT NULL GROUP BY 1")
def crosstab_state(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as a table, 0 where there is none."""
    return T.crosstab(table(spark, d, "combined_all_columns").filter("state is not null"), "platform", "state", ["canceled", "failed", "live", "successful"])


@query("""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'Total' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN grouping(c_nationkey) = 1 THEN 'Total' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
 CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    """H5: pairs with totals."""
    return T.crosstab_margins(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("""SELECT CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
 round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders)""")
def describe_prices(spark: SparkSession, d: str) -> DataFrame:
    """H6, H7: the summary of a number."""
    return T.describe(table(spark, d, "orders"), "o_totalprice")


@query("""SELECT scrape_round, CAST(count(*) AS BIGINT) AS n, CAST(count_if(is_throttled) AS BIGINT) AS throttled, CAST(count_if(cloudflare_detected) AS BIGINT) AS challenged, CAST(count_if(story_content IS NULL OR story_content = '') AS BIGINT) AS empty,
 round(avg(CAST(coalesce(is_throttled, false) AS INTEGER)), 6) AS throttle_rate FROM stories GROUP BY 1""")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates under conditions."""
    t = F.coalesce("is_throttled", F.lit(False))
    return table(spark, d, "stories").groupBy("scrape_round").agg(
        F.count("*").alias("n"), F.count_if("is_throttled").alias("throttled"), F.count_if("cloudflare_detected").alias("challenged"),
        F.count_if(F.col("story_content").isNull() | (F.col("story_content") == "")).alias("empty"), F.round(F.avg(t.cast("int")), 6).alias("throttle_rate"),
    )


@query(f"""WITH c AS (SELECT {_WALL} AS t, created_at, story_content FROM combined_all_columns) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(created_at IS NULL) AS BIGINT) AS null_dates, CAST(count_if(created_at IS NOT NULL AND t IS NULL) AS BIGINT) AS other_dates,
 CAST(count_if(t IS NULL AND story_content IS NOT NULL) AS BIGINT) AS only_date_missing, CAST(count_if(t IS NOT NULL AND story_content IS NULL) AS BIGINT) AS only_text_missing, CAST(count_if(t IS NULL AND story_content IS NULL) AS BIGINT) AS both_missing,
 CAST(count_if(t IS NOT NULL AND story_content IS NOT NULL) AS BIGINT) AS usable, min(t) AS first_date, max(t) AS last_date FROM c""")
def quality_audit(spark: SparkSession, d: str) -> DataFrame:
    """H9: what is missing, in one pass."""
    c = table(spark, d, "combined_all_columns").select(wall_clock_iso().alias("t"), "created_at", F.col("story_content").isNull().alias("no"))
    t = F.col("t").isNull()
    return c.agg(
        F.count("*").alias("n"), F.count_if(F.col("created_at").isNull()).alias("null_dates"), F.count_if(F.col("created_at").isNotNull() & t).alias("other_dates"),
        F.count_if(t & ~F.col("no")).alias("only_date_missing"), F.count_if(~t & F.col("no")).alias("only_text_missing"), F.count_if(t & F.col("no")).alias("both_missing"),
        F.count_if(~t & ~F.col("no")).alias("usable"), F.min("t").alias("first_date"), F.max("t").alias("last_date"),
    )


_MONTHLY = "SELECT last_day(o_orderdate) AS month, CAST(count(o_totalprice) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


def _monthly(spark: SparkSession, d: str, fill: bool, quarter: bool = False) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    o = o.filter(F.quarter("o_orderdate") != 2) if quarter else o
    return T.monthly_mean(o, F.col("o_orderdate"), F.col("o_totalprice"), fill)


@query(_MONTHLY)
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    """Means by month; months without rows are left out."""
    return _monthly(spark, d, False)


_FILLED = _MONTHLY.replace("GROUP BY 1", "AND quarter(o_orderdate) <> 2 GROUP BY 1")


@query(f"""WITH g AS ({_FILLED}), s AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS DATE)) AS month FROM g)
SELECT s.month, coalesce(g.n, 0) AS n, g.mean FROM s LEFT JOIN g ON s.month = g.month""")
def monthly_trend_filled(spark: SparkSession, d: str) -> DataFrame:
    """Months without rows are kept."""
    return _monthly(spark, d, True, True)


@query(f"""WITH g AS ({_MONTHLY}), s AS (SELECT regr_slope(mean, CAST(date_diff('day', DATE '1970-01-01', month) AS DOUBLE)) AS b, regr_intercept(mean, CAST(date_diff('day', DATE '1970-01-01', month) AS DOUBLE)) AS a FROM g)
SELECT round(b * 1e6, 4) AS slope_per_million_days, round(b * 30, 6) AS monthly_change, round(a, 4) AS intercept, CASE WHEN b > 0 THEN 'up' WHEN b < 0 THEN 'down' ELSE 'flat' END AS direction FROM s""")
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    """The line through the months."""
    return T.trend_line(_monthly(spark, d, False))


@query("""WITH t AS (SELECT unnest(CAST(TRY_CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM combined_all_columns WHERE json_valid(tags) AND json_type(tags) = 'ARRAY')
SELECT tag, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t WHERE tag IS NOT NULL), 6) AS pct FROM t WHERE tag IS NOT NULL GROUP BY tag""")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags of JSON lists; unreadable lists count as none."""
    return T.tag_counts(table(spark, d, "combined_all_columns"), "tags")


@query("SELECT platform, CAST(count(DISTINCT category_parent_name) AS BIGINT) AS n_categories, CAST(count(DISTINCT source_url) AS BIGINT) AS n_sources, array_to_string(list_sort(list_distinct(list(source_url) FILTER (source_url IS NOT NULL))), ' ') AS sources FROM combined_all_columns GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many different values, and which."""
    c = table(spark, d, "combined_all_columns")
    return c.groupBy("platform").agg(F.count_distinct("category_parent_name").alias("n_categories"), F.count_distinct("source_url").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_url")), " ").alias("sources"))


@query("""SELECT doc_id, kind, t AS text_md5, CASE WHEN kind = 'title' THEN 0 ELSE 1 END AS label FROM (SELECT id AS doc_id, 'title' AS kind, md5(title) AS t FROM updates WHERE title IS NOT NULL UNION ALL SELECT id, 'body', md5(body) FROM updates WHERE body IS NOT NULL)""")
def melt_labels(spark: SparkSession, d: str) -> DataFrame:
    """Columns become rows with a label; nulls are dropped."""
    u = table(spark, d, "updates").select(F.col("id").alias("doc_id"), "title", "body")
    m = u.unpivot(["doc_id"], ["title", "body"], "kind", "t").filter("t is not null")
    return m.select("doc_id", "kind", F.md5("t").alias("text_md5"), F.when(F.col("kind") == "title", 0).otherwise(1).alias("label"))


_MD5_SHARE = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5_SHARE}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM orders""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """I8: the same share of each label on either side."""
    return T.split_sample(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS BIGINT) AS place FROM orders")
def shuffled_orders(spark: SparkSession, d: str) -> DataFrame:
    """A seeded shuffle, the same wherever a row is."""
    return T.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 1000.0::DOUBLE) AS BIGINT) AS batch FROM orders")
def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """Rows in batches of a thousand."""
    return T.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS left_ FROM orders) WHERE left_ > 2")
def drop_last_two(spark: SparkSession, d: str) -> DataFrame:
    """All but the last two rows of each group."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return T.without_last(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey", 2).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


_FILE = "CASE WHEN author IS NULL THEN 'comments_sentiment_1.csv' ELSE 'comments_1.csv' END"


@query(f"SELECT id, {_FILE} AS file FROM comments WHERE NOT contains({_FILE}, '_sentiment_') UNION ALL SELECT id, 'x_sentiment_x' FROM comments WHERE parent_id IS NULL")
def raw_files_first(spark: SparkSession, d: str) -> DataFrame:
    """Rows of raw files where there are any (told by the file's name, here made up), else all."""
    c = table(spark, d, "comments")
    some = io.prefer_raw(c.select("id", F.when(F.col("author").isNull(), "comments_sentiment_1.csv").otherwise("comments_1.csv").alias("file")), F.col("file"))
    none = io.prefer_raw(c.filter("parent_id is null").select("id", F.lit("x_sentiment_x").alias("file")), F.col("file"))
    return some.unionByName(none)


@query("""SELECT id, NULL AS parent_id, title AS body, project_id, author FROM updates UNION ALL SELECT id || '-r', id, body, project_id, author_id FROM updates""")
def nested_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments and replies out of nested JSON (made of the updates: titles with their bodies as replies)."""
    u = table(spark, d, "updates")
    author = lambda n: F.struct(F.col(n).alias("name"), F.col("author_id").alias("id"))
    at = F.unix_seconds(F.col("published_at").cast("timestamp")).alias("createdAt")
    reply = F.struct(F.concat(F.col("id"), F.lit("-r")).alias("id"), F.col("body"), at, author("author_id").alias("author"))
    node = F.struct(F.col("id"), F.col("title").alias("body"), at, author("author").alias("author"), F.struct(F.array(F.struct(reply.alias("node"))).alias("edges")).alias("replies"))
    page = F.struct(F.struct(F.col("project_id").alias("id"), F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("comments")).alias("project"))
    one = "id: string, body: string, createdAt: bigint, author: struct<name: string, id: string>"
    schema = f"struct<project: struct<id: string, comments: struct<edges: array<struct<node: struct<{one}, replies: struct<edges: array<struct<node: struct<{one}>>>>>>>>>>"
    pages = u.select(F.to_json(page).alias("j")).select(F.from_json("j", schema).alias("p")).select("p.*")
    return io.flatten_comments(pages).select("id", "parent_id", "body", "project_id", "author")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def top_three(spark: SparkSession, d: str) -> DataFrame:
    """The three highest above a bound."""
    return table(spark, d, "orders").filter("o_totalprice > 100000").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")


@query("SELECT id, coalesce(author, 'unknown') AS author, coalesce(body, '') AS body, CASE WHEN coalesce(body, '') <> '' THEN body ELSE coalesce(project_slug, '') END AS shown FROM comments")
def null_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fills by column, and the first text there is."""
    c = table(spark, d, "comments").withColumn("shown", X.first_text(F.col("body"), F.col("project_slug")))
    return c.na.fill({"author": "unknown", "body": ""}).select("id", "author", "body", "shown")


@query("SELECT vec_id, CASE WHEN s > 0.1 THEN 'high' WHEN s >= -0.1 THEN 'middle' ELSE 'low' END AS bucket, CASE WHEN abs(s) < 0.001 THEN '***' WHEN abs(s) < 0.01 THEN '**' WHEN abs(s) < 0.05 THEN '*' WHEN abs(s) < 0.1 THEN '.' ELSE '' END AS stars FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings)")
def buckets_and_stars(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds, buckets, stars."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("s"))
    return e.select("vec_id", F.when(F.col("s") > 0.1, "high").when(F.col("s") >= -0.1, "middle").otherwise("low").alias("bucket"), X.stars(F.abs("s")).alias("stars"))


@query("SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_balances(spark: SparkSession, d: str) -> DataFrame:
    """P: subtotals, in SQL text."""
    for t in ("customer", "nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"qs_{t}")
    return spark.sql("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM qs_customer JOIN qs_nation ON c_nationkey = n_nationkey JOIN qs_region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def keys_except(spark: SparkSession, d: str) -> DataFrame:
    """P: keys of one set without another's."""
    o = table(spark, d, "orders")
    k = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey"))
    return k("F").subtract(k("P"))
