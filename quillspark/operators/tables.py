"""Aligning, filtering, joining, de-duplicating and summarising tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import project_number
from ..session import saved

# Category groups by platform.
CATEGORY_GROUPS = {
    "Kickstarter": {
        "Creative_Visual_Arts": ["Illustration", "Digital Art", "Art", "Animation", "Painting", "Sculpture", "Photography", "Mixed Media", "Design", "Fine Art", "Public Art"],
        "Publishing_Writing": ["Comic Books", "Graphic Novels", "Fiction", "Nonfiction", "Anthologies", "Zines", "Poetry", "Literature", "Academic", "Journals", "Comics"],
        "Technology_Hardware": ["Product Design", "Hardware", "Apps", "Gadgets", "DIY Electronics", "Wearables", "Gaming Hardware", "Robotics", "3D Printing", "Software", "Technology"],
        "Games_Toys": ["Playing Cards", "Tabletop Games", "Video Games", "Mobile Games", "Live Games", "Puzzles", "Toys", "Games"],
        "Film_Music_Performance": ["Shorts", "Drama", "Comedy", "Horror", "Documentary", "Music", "Rock", "Hip-Hop", "Pop", "Jazz", "Classical Music", "Country & Folk", "Electronic Music", "Indie Rock", "Theater", "Performance Art", "Festivals", "Film & Video", "Musical", "Webseries", "Television", "Radio & Podcasts", "Audio", "Narrative Film", "Dance", "Sound", "Blues", "World Music", "Latin", "Metal", "Punk", "R&B"],
        "Food_Lifestyle": ["Restaurants", "Drinks", "Food Trucks", "Vegan", "Cookbooks", "Candles", "Fashion", "Apparel", "Accessories", "Jewelry", "Footwear", "Cosmetics", "Food"],
        "Community_Education": ["Community Gardens", "Faith", "Social Practice", "Events", "Community"],
    },
    "Indiegogo": {
        "Creative_Visual_Arts": ["Art", "Photography", "Web Series & TV Shows"],
        "Publishing_Writing": ["Comics", "Writing & Publishing", "Blogs/Podcasts/Vlogs"],
        "Technology_Hardware": ["Productivity", "Phones & Accessories", "Energy & Green Tech", "Smart Home", "Computers", "IoT", "Security", "Drones", "VR/AR", "Transportation"],
        "Games_Toys": ["Tabletop Games", "Video Games", "Toys"],
        "Film_Music_Performance": ["Film", "Music", "Audio", "Web Series & TV", "Dance & Theater"],
        "Food_Lifestyle": ["Food & Beverages", "Fashion & Wearables", "Home", "Beauty", "Health & Fitness", "Wellness"],
        "Community_Education": ["Education", "Human Rights", "Local Businesses", "Environment", "Social Innovations", "Culture"],
    },
}


def pick_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidates that the table has."""
    return next((c for c in candidates if c in df.columns), None)


def standardise(df: DataFrame, mapping: dict[str, str | None], platform: str) -> DataFrame:
    """Columns by a mapping target -> source; a missing source gives nulls; the platform's name comes first (B1)."""
    cols = [(F.col(s).cast("string") if s in df.columns else F.lit(None).cast("string")).alias(t) for t, s in mapping.items()]
    return df.select(F.lit(platform).alias("platform"), *cols)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name, absent columns null, columns sorted."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return out.select(*sorted(out.columns))


def rounded(x: Column, places: int) -> Column:
    """A double rounded as DuckDB does: the scaled double, halves away from zero.  F.round goes by the shortest decimal
    instead, so 1.27205 (a little less in binary) would be 1.2721, not 1.272.  NaN, infinities and what overflows stay."""
    y = F.round(x * 10.0**places) / 10.0**places
    return F.when(F.abs(y) == float("inf"), x).otherwise(y)


def clean_id(col: Column) -> Column:
    """A suffix .0 is cut off."""
    return F.regexp_replace(col, r"\.0$", "")


def number(col: Column) -> Column:
    """A double, null where the text is none (B5); NaN becomes null."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def percent(col: Column) -> Column:
    """`123%` as 123.0."""
    return number(F.replace(col, F.lit("%"), F.lit("")))


def impute_goal(platform: Column, goal: Column, pledged: Column, share: Column) -> Column:
    """Indiegogo goals from the amount pledged and its share."""
    g, p, s = (F.nanvl(x, F.lit(None)) for x in (goal, pledged, share))
    return F.when((platform == "Indiegogo") & g.isNull() & (p > 0) & (s > 0), p / (s / 100)).otherwise(g)


def funding_percent(platform: Column, ks: Column, ig: Column) -> Column:
    return F.when(platform == "Kickstarter", F.nanvl(ks, F.lit(None))).when(platform == "Indiegogo", F.nanvl(ig, F.lit(None)))


def success(percent_: Column, state: Column | None = None) -> Column:
    """1 if 100 percent were reached, or (if given) the state says so."""
    ok = F.coalesce(percent_ >= 100, F.lit(False))
    return (ok if state is None else ok | F.coalesce(state == "successful", F.lit(False))).cast("int")


def log_floor(x: Column, null_is_floor: bool = False) -> Column:
    """ln of at least 1; null stays null unless it counts as the floor."""
    y = F.log(F.greatest(F.coalesce(x, F.lit(0.0)) if null_is_floor else x, F.lit(1.0)))
    return y if null_is_floor else F.when(x.isNotNull(), y)


def unify_category(df: DataFrame, out: str = "category_unified") -> DataFrame:
    """Groups of categories: Kickstarter's by category_name, Indiegogo's by category_parent_name, else Other."""
    groups = {p: F.create_map(*[F.lit(x) for g, names in m.items() for n in names for x in (n, g)]) for p, m in CATEGORY_GROUPS.items()}
    hit = F.when(F.col("platform") == "Kickstarter", groups["Kickstarter"][F.col("category_name")]).when(
        F.col("platform") == "Indiegogo", groups["Indiegogo"][F.col("category_parent_name")]
    )
    return df.withColumn(out, F.coalesce(hit, F.lit("Other")))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants in epoch seconds, rounded down."""
    return F.floor((later - earlier) / 86400).cast("bigint")


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key by an explicit rising order, nulls first (G4); rows with a null key stay if asked.

    Only the first row of a key leaves each partition (Spark limits the groups before it moves them), so a key that
    holds a third of all rows is no bottleneck.  Ties must be broken by `order`.  Null keys form one group unless
    they are kept.
    """
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    x = df.filter(~null) if keep_null_keys else df
    out = x.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return out.unionByName(df.filter(null)) if keep_null_keys else out


def without_last(df: DataFrame, group: list[str], order: list[Column], key: str, n: int) -> DataFrame:
    """All but the last n rows of each group by a rising order (I2); `key` tells rows apart.

    The last rows are found by limited groups as in first_by and taken out by their key, so no task gets a whole group.
    """
    last = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*[o.desc() for o in order]))).filter(F.col("_rn") <= n).select(key)
    return df.join(last, key, "left_anti")


def best_by(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of the row that comes last by `order`: an aggregate, so a hot key is reduced before it is moved."""
    picked = F.max_by(F.struct(*values), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_v")).select(*keys, "_v.*")


def fill_rounds(stories: DataFrame, keys: list[str]) -> DataFrame:
    """One text a key: the last of round 1, filled from the first text of later rounds where it is null or empty."""
    has = F.coalesce(F.col("story_content") != "", F.lit(False)).cast("int")
    first = F.col("scrape_round") == 1
    # a text beats none; then the lower round; then the last row of round 1, the first of the others
    order = [has, -F.col("scrape_round"), F.when(first, F.col("story_row_id")).otherwise(-F.col("story_row_id"))]
    return best_by(stories, keys, order, ["story_content", "scrape_round", "story_row_id"])


def value_counts(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """Counts and their share of all rows, nulls counted among all (H1); nulls as a group of their own (H2)."""
    g = df.groupBy(col).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    total = g.groupBy("_one").agg(F.sum("n").alias("_total"))  # one row
    out = g.join(F.broadcast(total), "_one").select(col, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 6).alias("pct"))
    return out if keep_null else out.filter(F.col(col).isNotNull())


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of pairs, 0 where there is none (H4)."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0, [str(v) for v in values])


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of pairs and the totals of rows, columns and all, as `Total` (H5)."""
    return df.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c")).select(
        F.when(F.col("_r") == 1, "Total").otherwise(F.col(row).cast("string")).alias(row),
        F.when(F.col("_c") == 1, "Total").otherwise(F.col(col).cast("string")).alias(col),
        "n",
    )


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row: n and q0, q1, ..., the exact quantiles (linear between neighbours) of the values that aren't null.

    Equal values are counted first, so a value that a third of all rows have is one row; the different values are
    put into ranges and their counts added up range by range, so no task holds them all.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = df.select(value.alias("_x")).filter("_x is not null").groupBy("_x").agg(F.count("*").alias("_k"))
    g = saved(g.repartitionByRange(parts, "_x").withColumn("_p", F.spark_partition_id()))  # the ranges must stay as they are
    sums = g.groupBy("_p").agg(F.sum("_k").alias("_s"))  # a row a range
    before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    n = sums.agg(F.coalesce(F.sum("_s"), F.lit(0))).first()[0]
    end = F.sum("_k").over(Window.partitionBy("_p").orderBy("_x")) + F.col("_before")
    x = g.join(F.broadcast(before), "_p").withColumn("_end", end)
    at = lambda i: F.max(F.when((F.col("_end") > i) & (F.col("_end") - F.col("_k") <= i), F.col("_x")))
    places = [(n - 1) * q for q in shares] if n else [0.0 for _ in shares]
    out = x.agg(F.lit(n).alias("n"), *[f for i, p in enumerate(places) for f in (at(int(p)).alias(f"_a{i}"), at(min(int(p) + 1, max(n - 1, 0))).alias(f"_b{i}"))])
    return out.select("n", *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (p - int(p))).alias(f"q{i}") for i, p in enumerate(places)])


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max (H6, H7)."""
    x = F.nanvl(F.col(col).cast("double"), F.lit(None))
    one = df.agg(F.lit(1).alias("_one"), F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, x, [0.25, 0.5, 0.75]).select(F.lit(1).alias("_one"), *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return one.join(F.broadcast(q), "_one").select("n", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row each


def monthly_mean(df: DataFrame, date: Column, value: Column, fill_gaps: bool) -> DataFrame:
    """month (its last day), n, mean; months without rows are kept with nulls or dropped."""
    g = df.select(F.last_day(date).alias("month"), value.alias("v")).filter("month is not null").groupBy("month").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    if not fill_gaps:
        return g
    spine = g.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")
    )
    return spine.select(F.last_day("m").alias("month")).join(g, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def trend_line(monthly: DataFrame) -> DataFrame:
    """Unweighted line through the monthly means: slope a day, change a month, direction."""
    day = F.datediff(F.col("month"), F.lit("1970-01-01").cast("date")).cast("double")
    slope = F.regr_slope(F.col("mean"), day)
    return monthly.filter("mean is not null").agg(
        F.round(slope * 1e6, 4).alias("slope_per_million_days"), F.round(slope * 30, 6).alias("monthly_change"), F.round(F.regr_intercept(F.col("mean"), day), 4).alias("intercept"),
        F.when(slope > 0, "up").when(slope < 0, "down").otherwise("flat").alias("direction"),
    )


def tag_counts(df: DataFrame, col: str) -> DataFrame:
    """Tags of JSON lists and their share of all tags; unreadable lists count as none."""
    tags = df.select(F.explode(F.from_json(F.col(col), "array<string>")).alias("tag")).filter("tag is not null")
    return value_counts(tags, "tag")


def _hash(key: str, seed: str = "") -> Column:
    """A number from 0 to 1 (32 bits) told by a row's key."""
    text = F.col(key).cast("string") if not seed else F.concat(F.col(key).cast("string"), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_sample(df: DataFrame, key: str, label: str, share: float = 0.8, buckets: int = 4096) -> DataFrame:
    """Stratified split (I8): of each label the first floor(share x n) rows by a hash of the key are `train`, the rest
    `test`; a null label is one of its own.

    A label may hold any share of the rows: they are counted by ranges of the hash first, and ranked within these.
    """
    x = df.select(key, label, _hash(key).alias("_h")).withColumn("_b", F.floor(F.col("_h") * buckets).cast("int"))
    counts = x.groupBy(label, "_b").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(label)
    counts = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_bb"), (F.sum("_k").over(w.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    j = x.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_bb")))
    return j.select(key, label, F.when(rank <= F.floor(F.col("_n") * share), "train").otherwise("test").alias("part"))


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the place (from 1) of each row in a unique order.

    The order is cut into ranges first: a range's rows are counted, and numbered on from the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = saved(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))  # the ranges must stay as they are
    starts = x.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a range
    before = starts.select(F.col("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    return x.join(F.broadcast(before), "_p").withColumn(out, rn).select(*df.columns, out)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows with `place`, their position in an order told by a hash of key and seed."""
    x = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    return ranked(x, ["_h", key], "place").drop("_h")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows numbered into batches of `size` by a unique order."""
    return ranked(df, [order], "_place").withColumn("batch", F.ceil(F.col("_place") / size).cast("bigint")).drop("_place")


def known_projects(df: DataFrame, ident: str = "id") -> DataFrame:
    """Adds project_id, the number in the id, and drops rows without one."""
    return df.withColumn("project_id", project_number(F.col(ident))).filter("project_id is not null")
