"""The best representative of each group of duplicate records.

Skyline selection: a record is kept as a candidate unless another of its group is at least as good in
every dimension (usable, trusted, complete, recent) and better in one.  A lexicographic policy picks the
survivor among the candidates; its nulls are filled from the next layers of dominance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import project_number
from ..session import parts_of, saved
from .residue import template_residue


def completeness(normal_text: Column) -> Column:
    """Characters of the different lines of a normalised text (see residue.normalised); 0 for null."""
    lines = F.array_distinct(F.split(F.trim(normal_text), "\n"))
    return F.coalesce(F.length(F.array_join(lines, "")), F.lit(0))


def dominated(part: list[str], flags: tuple[str, str], size: str, time: str, key: str) -> Column:
    """Whether an earlier record of the partition is as good in all dimensions.

    Records are read by falling size and time, so that only earlier ones can dominate, and of those just
    the latest time among each combination of flags at least as good is needed.  Of equal records the
    one with the smaller key dominates.  Null times are the oldest.
    """
    a, b = flags
    t = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)))
    w = Window.partitionBy(*part).orderBy(F.col(size).desc(), t.desc(), F.col(a).desc(), F.col(b).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    out = F.lit(False)
    for x in (0, 1):
        for y in (0, 1):
            best = F.max(F.when((F.col(a) >= x) & (F.col(b) >= y), t)).over(w)
            out = F.when((F.col(a) == x) & (F.col(b) == y), F.coalesce(best >= t, F.lit(False))).otherwise(out)
    return out


def story_features(stories: DataFrame) -> DataFrame:
    """platform, project_id, story_row_id and the four dimensions of each row of a known project."""
    carry = {
        "platform": F.col("platform"),
        "project_id": project_number(F.col("id")),
        "trusted": F.when(F.coalesce("is_throttled", F.lit(False)), 0).otherwise(1),
        "n_chars": completeness(F.col("_t")),
        "blank": F.coalesce(F.btrim(F.col("_t"), F.lit(" \n")) == "", F.lit(True)),
        "scraped_at": F.col("scraped_at"),
        "is_throttled": F.col("is_throttled"),
        "cloudflare_detected": F.col("cloudflare_detected"),
        "no_text": F.col("_t").isNull(),
    }
    x = template_residue(stories, carry=carry)
    x = x.filter(F.col("platform").isNotNull() & F.col("project_id").isNotNull())
    return x.withColumn("usable", F.when(F.col("is_residue") | F.col("blank"), 0).otherwise(1))


_GROUP, _FLAGS = ["platform", "project_id"], ("usable", "trusted")


def _best() -> Column:
    """The policy: usable, trusted, most complete, latest, smallest id."""
    return F.struct(
        F.col("usable"), F.col("trusted"), F.col("n_chars"), F.col("scraped_at"), (-F.col("story_row_id")).alias("k")
    )


def candidates(features: DataFrame, salts: int) -> DataFrame:
    """The skyline of each project, with the number of the rows it stands for in `_n` (sum it by project).

    A project may hold a third of all rows: parts of it, split by a hash of the row, are thinned first;
    only what no part dominates is brought together.
    """
    x = features.withColumn("_salt", F.pmod(F.xxhash64("story_row_id"), F.lit(salts)).cast("int"))
    part = [*_GROUP, "_salt"]
    x = x.withColumn("_out", dominated(part, _FLAGS, "n_chars", "scraped_at", "story_row_id"))
    x = x.withColumn("_all", F.count("*").over(Window.partitionBy(*part)))
    x = x.filter(~F.col("_out"))
    first = F.row_number().over(Window.partitionBy(*part).orderBy("story_row_id")) == 1
    x = x.withColumn("_n", F.when(first, F.col("_all")).otherwise(0)).drop("_all", "_salt", "_out")
    return x.withColumn("_out", dominated(_GROUP, _FLAGS, "n_chars", "scraped_at", "story_row_id"))


def survivors(stories: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """platform, project_id, story_row_id, n_rows, n_candidates: the survivor of each project with two or more rows.

    Rows with a null or unreadable id, or a null platform, belong to no known project.  If no row of a
    project is usable, the same policy decides among all.  Repeated rows (equal in every dimension) tie
    and the smallest story_row_id wins.  `features` may be given with another idea of what is usable.
    """
    c = candidates(story_features(stories) if features is None else features, parts_of(stories))
    g = c.groupBy(*_GROUP).agg(
        F.sum("_n").alias("n_rows"), F.count_if(~F.col("_out")).alias("n_candidates"), F.max(F.when(~F.col("_out"), _best())).alias("_best")
    )
    return g.filter("n_rows >= 2").select(*_GROUP, (-F.col("_best.k")).alias("story_row_id"), "n_rows", "n_candidates")


def peeled(df: DataFrame, part: list[str], layers: int) -> DataFrame:
    """Adds `_deep`, the layer of dominance from 1 on; what lies deeper than `layers` has layers + 1."""
    x = df.withColumn("_deep", F.lit(1))
    for i in range(1, layers + 1):  # a layer's rows stay, the rest is peeled again
        x = x.withColumn("_out", dominated([*part, "_deep"], _FLAGS, "n_chars", "scraped_at", "_first"))
        x = x.withColumn("_deep", F.when((F.col("_deep") == i) & F.col("_out"), i + 1).otherwise(F.col("_deep")))
    return x.drop("_out")


_FIELDS = {"story_content": "_text", "is_throttled": "_throttled", "cloudflare_detected": "_cloudflare"}


def points(features: DataFrame) -> DataFrame:
    """Rows that are equal in every dimension as one point, so that they share a layer: its smallest id (`_first`),
    and for each field the smallest id that has a value (`_k...`), with the value where it is small."""
    has = {"_text": ~F.col("blank"), "_throttled": F.col("is_throttled").isNotNull(), "_cloudflare": F.col("cloudflare_detected").isNotNull()}
    giver = lambda n: F.struct(F.col("story_row_id").alias("k"), *([] if n == "_text" else [F.col("is_throttled" if n == "_throttled" else "cloudflare_detected").alias("v")]))
    return features.groupBy(*_GROUP, "usable", "trusted", "n_chars", "scraped_at").agg(
        F.count("*").alias("_rows"), F.min("story_row_id").alias("_first"), *[F.min(F.when(c, giver(n))).alias(f"_k{n}") for n, c in has.items()]
    )


def filled_survivors(stories: DataFrame, layers: int = 3) -> DataFrame:
    """The survivors' rows with story_content, is_throttled and cloudflare_detected; nulls are filled.

    filled_<field> is the story_row_id that gave the value (null: nothing was filled).  A null comes from
    the first layer of dominance that has the value, within it from the best row by the policy; equal rows share a
    layer.  `layers` are peeled at a time, until every null is filled that some row of its project can fill: only
    projects that still lack a value go on.
    """
    f = saved(story_features(stories).drop("is_residue", "kind"))
    salts = parts_of(f)
    best = F.max(F.struct(*[F.col(c) for c in ("usable", "trusted", "n_chars", "scraped_at")], (-F.col("story_row_id")).alias("k"), F.col("is_throttled").alias("t"), F.col("cloudflare_detected").alias("c"), F.col("no_text").alias("x")))
    own = f.groupBy(*_GROUP).agg(
        F.count("*").alias("n_rows"), best.alias("_b"), F.max(~F.col("blank")).alias("_text"), F.max(F.col("is_throttled").isNotNull()).alias("_throttled"), F.max(F.col("cloudflare_detected").isNotNull()).alias("_cloudflare"),
    )
    # what a survivor lacks and some other row of its project has
    lacks = {"_text": F.col("_b.x"), "_throttled": F.col("_b.t").isNull(), "_cloudflare": F.col("_b.c").isNull()}
    own = saved(own.filter("n_rows >= 2").select(*_GROUP, (-F.col("_b.k")).alias("story_row_id"), F.col("_b.t").alias("is_throttled"), F.col("_b.c").alias("cloudflare_detected"), F.col("_b.scraped_at").alias("scraped_at"), *[(lacks[n] & F.col(n)).alias(f"_open{n}") for n in lacks]))
    still = own.filter("_open_text or _open_throttled or _open_cloudflare").select(*_GROUP, *[f"_open{n}" for n in lacks])
    rest, got = points(f).join(still, _GROUP).withColumn("_salt", F.pmod(F.xxhash64("_first"), F.lit(salts)).cast("int")), None
    while True:
        rest = saved(rest)
        # a row of the first layers of its project is in the first layers of its hashed part, and so is whatever
        # dominates it: the rest of a part can wait before the parts meet
        thin = peeled(rest, [*_GROUP, "_salt"], layers).filter(F.col("_deep") <= layers).drop("_deep")
        near = saved(peeled(thin, _GROUP, layers).filter(F.col("_deep") <= layers))
        if near.isEmpty():
            break
        order = lambda n: F.struct((-F.col("_deep")).alias("deep"), *[F.col(c) for c in ("usable", "trusted", "n_chars", "scraped_at")], (-F.col(f"_k{n}.k")).alias("k"))
        one = saved(near.groupBy(*_GROUP).agg(*[F.max_by(f"_k{n}", F.when(F.col(f"_open{n}") & F.col(f"_k{n}").isNotNull(), order(n))).alias(f"_d{n}") for n in lacks]))
        got = one if got is None else got.unionByName(one)
        done = one.select(*_GROUP, *[F.col(f"_d{n}").isNotNull().alias(f"_done{n}") for n in lacks])
        open_ = [(F.col(f"_open{n}") & ~F.col(f"_done{n}")).alias(f"_open{n}") for n in lacks]
        keep = [c for c in rest.columns if not c.startswith("_open")]
        rest = rest.join(near.select(*_GROUP, "_first"), [*_GROUP, "_first"], "left_anti").join(done, _GROUP).select(*keep, *open_).filter("_open_text or _open_throttled or _open_cloudflare")
    if got is not None:
        got = got.groupBy(*_GROUP).agg(*[F.first(f"_d{n}", ignorenulls=True).alias(f"_d{n}") for n in lacks])
        own = own.join(got, _GROUP, "left")
    else:
        own = own.withColumns({f"_d{n}": F.lit(None).cast("struct<k:bigint>" if n == "_text" else "struct<k:bigint,v:boolean>") for n in lacks})
    out = own.select(
        *_GROUP, "story_row_id", "scraped_at", F.coalesce("is_throttled", F.col("_d_throttled.v")).alias("is_throttled"), F.coalesce("cloudflare_detected", F.col("_d_cloudflare.v")).alias("cloudflare_detected"),
        F.col("_d_text.k").alias("filled_story_content"), F.col("_d_throttled.k").alias("filled_is_throttled"), F.col("_d_cloudflare.k").alias("filled_cloudflare_detected"), F.coalesce("_d_text.k", "story_row_id").alias("_from"),
    )
    texts = stories.select(F.col("story_row_id").alias("_from"), "story_content")  # one text a project is fetched
    return out.join(texts, "_from", "left").select(*_GROUP, "story_row_id", "story_content", "is_throttled", "cloudflare_detected", "scraped_at", *[f"filled_{c}" for c in _FIELDS])
