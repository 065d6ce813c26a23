"""Filling missing numbers from like records, with a mark on every value that was filled.

First the same group's row nearest in time, then the median of the row's k-prototypes cluster, then
that of its parent group, then that of all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import project_number
from ..session import saved
from .units import missing_value


def nearest_donors(
    df: DataFrame, group: list[str], ts: str, key: str, present: dict[str, Column], bucket_days: int = 1, value: dict[str, Column] | None = None
) -> DataFrame:
    """For each field the key of the row of the same group that has it and is nearest in time.

    Adds from_<field> (and value_<field>, that row's value, for the fields in `value`): null where the group has none (or any group column or time is null); of equally
    near rows the smallest key counts.  A group may hold a third of all rows: it is cut into buckets of
    time; a bucket's rows see each other, and the nearest donors outside it come from a summary of one
    row a bucket, so no task gets a whole group.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket_us = bucket_days * 86400 * 1_000_000
    known = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], F.col(ts).isNotNull())
    x = df.withColumn("_t", t).withColumn("_b", F.call_function("div", F.col("_t"), F.lit(bucket_us)))
    value = value or {}
    kinds = dict(df.select(*[v.alias(f) for f, v in value.items()]).dtypes) if value else {}
    rest = x.filter(~known).withColumns({f"from_{f}": F.lit(None).cast("bigint") for f in present} | {f"value_{f}": F.lit(None).cast(kinds[f]) for f in value}).drop("_t", "_b")
    x = x.filter(known)
    own = [*group, "_b"]
    own_value = lambda f: [value[f].alias("v")] if f in value else []
    late = {f: F.when(c, F.struct(F.col("_t").alias("t"), (-F.col(key)).alias("k"), *own_value(f))) for f, c in present.items()}
    early = {f: F.when(c, F.struct(F.col("_t").alias("t"), F.col(key).alias("k"), *own_value(f))) for f, c in present.items()}
    # within the bucket: the latest donor up to now, the earliest from now on (peers included)
    w_up = Window.partitionBy(*own).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w_down = Window.partitionBy(*own).orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = x.withColumns({f"_up_{f}": F.max(late[f]).over(w_up) for f in present})
    inside = inside.withColumns({f"_down_{f}": F.min(early[f]).over(w_down) for f in present})
    # between buckets: one row each
    summary = x.groupBy(*own).agg(*[F.max(late[f]).alias(f"_l_{f}") for f in present], *[F.min(early[f]).alias(f"_e_{f}") for f in present])
    w_before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_after = Window.partitionBy(*group).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *[F.col(g).alias(f"_g_{g}") for g in own],
        *[F.max(f"_l_{f}").over(w_before).alias(f"_before_{f}") for f in present],
        *[F.min(f"_e_{f}").over(w_after).alias(f"_after_{f}") for f in present],
    )
    # only buckets with something missing need the rest of their group
    j = inside.join(summary, [F.col(g) == F.col(f"_g_{g}") for g in own], "left")
    for f in present:
        before = F.greatest(f"_up_{f}", f"_before_{f}")
        after = F.least(f"_down_{f}", f"_after_{f}")
        gap_b, gap_a = F.col("_t") - before["t"], after["t"] - F.col("_t")
        kb, ka = -before["k"], after["k"]
        earlier = before.isNotNull() & (after.isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (kb <= ka)))
        j = j.withColumn(f"from_{f}", F.when(earlier, kb).otherwise(ka))
        if f in value:
            j = j.withColumn(f"value_{f}", F.when(earlier, before["v"]).otherwise(after["v"]))
    return j.select(*rest.columns).unionByName(rest)


class KPrototypes:
    """Clusters over numbers (means over observed values) and categories (modes).

    Distance: mean squared difference of the observed standardised numbers plus gamma times the share of
    categories that differ.  The k prototypes are the model, k and the number of features are its
    bound; every pass over the rows is one aggregation, and all rows take part.
    """

    def __init__(self, numeric: list[str], categorical: list[str], k: int = 12, gamma: float = 1.0, passes: int = 4) -> None:
        self.numeric, self.categorical, self.k, self.gamma, self.passes = numeric, categorical, k, gamma, passes
        self.prototypes: list[dict] = []
        self.scale: dict[str, tuple[float, float]] = {}

    def assign(self) -> Column:
        """The nearest prototype's number (the first of equally near ones)."""
        numeric, categorical, gamma = self.numeric, self.categorical, self.gamma
        mean = np.array([self.scale[n][0] for n in numeric])
        sd = np.array([self.scale[n][1] for n in numeric])
        centre = np.array([[p[n] for n in numeric] for p in self.prototypes])
        modes = [[p[c] for c in categorical] for p in self.prototypes]

        def nearest(*cols: pd.Series) -> pd.Series:
            nums = [c.to_numpy(dtype=float) for c in cols[: len(numeric)]]
            cats = cols[len(numeric) :]
            z = (np.column_stack(nums) - mean) / sd
            seen = ~np.isnan(z)
            z, n = np.where(seen, z, 0.0), np.maximum(seen.sum(axis=1), 1)
            best, which = np.full(len(z), np.inf), np.zeros(len(z), dtype=np.int32)
            for i, row in enumerate(centre):
                d = (np.where(seen, z - row, 0.0) ** 2).sum(axis=1) / n
                for c, m in zip(cats, modes[i]):
                    same = c.isna() if m is None else c == m
                    d = d + gamma / max(1, len(categorical)) * (~same.to_numpy(dtype=bool))
                closer = d < best
                best, which = np.where(closer, d, best), np.where(closer, i, which).astype(np.int32)
            return pd.Series(which)

        return F.pandas_udf(nearest, T.IntegerType())(*[F.col(n).cast("double") for n in numeric], *[F.col(c).cast("string") for c in categorical])

    def fit(self, df: DataFrame, key: str) -> "KPrototypes":
        stats = df.agg(*[F.avg(n).alias(f"m_{n}") for n in self.numeric], *[F.stddev_samp(n).alias(f"s_{n}") for n in self.numeric]).first()
        self.scale = {n: (stats[f"m_{n}"] or 0.0, stats[f"s_{n}"] or 1.0) for n in self.numeric}  # one row
        seeds = df.orderBy(F.xxhash64(F.col(key)), key).limit(self.k).collect()
        self.prototypes = [self._standard(r.asDict()) for r in seeds]
        for _ in range(self.passes):
            if not self.prototypes:
                break
            rows = (
                df.withColumn("_c", self.assign())
                .groupBy("_c")
                .agg(*[F.avg(n).alias(n) for n in self.numeric], *[F.mode(c).alias(c) for c in self.categorical])
                .collect()  # k rows
            )
            new = {r["_c"]: self._standard(r.asDict()) for r in rows}
            self.prototypes = [new.get(i, p) for i, p in enumerate(self.prototypes)]
        return self

    def _standard(self, r: dict) -> dict:
        out = {c: r[c] for c in self.categorical}
        for n in self.numeric:
            mean, sd = self.scale[n]
            out[n] = 0.0 if r[n] is None else (float(r[n]) - mean) / (sd or 1.0)
        return out


NUMBERS = ("goal", "pledged", "funds_raised_percent")
NO_TEXT = ["", "n/a", "na", "none", "null", "nan", "-", "unknown"]  # fixed values: texts that stand for no value


def _narrow(df: DataFrame, key: str, ts: str, platform: str, ident: str, parent: str, categories: tuple[str, ...]) -> DataFrame:
    """What the filling needs of each row, missing values as null."""
    value = {f: F.when(~missing_value(F.col(f), f != "goal"), F.col(f).cast("double")) for f in NUMBERS}
    text = {c: F.when(~F.lower(F.trim(F.col(c))).isin(NO_TEXT), F.col(c).cast("string")) for c in dict.fromkeys(["currency", parent, *categories])}
    return df.select(
        F.col(key), F.col(ts).alias("_ts"), F.col(platform).alias("_platform"), project_number(F.col(ident)).alias("_pid"), F.coalesce(F.col(platform) == "Kickstarter", F.lit(False)).alias("_ks"),
        F.log1p(F.when(F.col("backers_count") >= 0, F.col("backers_count").cast("double"))).alias("_n_backers"),
        *[v.alias(f"_x_{f}") for f, v in value.items()], *[v.alias(f"_s_{c}") for c, v in text.items()],
    )


def _gaps(x: DataFrame, key: str, parent: str, categories: tuple[str, ...], k: int, passes: int, support: int) -> DataFrame:
    """A row for each missing value: _own (the donor's), _cluster, _group, _all, each a struct of number x and text s;
    _from, the donor; `_true`, what was there before, if x says so in `_true_<field>`."""
    logs = {f"_n_{f}": F.log1p(F.col(f"_x_{f}")) for f in NUMBERS}
    model = KPrototypes([*logs, "_n_backers"], ["_platform", f"_s_{parent}", "_s_currency"], k=k, passes=passes).fit(x.withColumns(logs).drop("_ts", "_pid"), key)
    x = x.withColumns(logs).withColumn("_c", model.assign() if model.prototypes else F.lit(0)).drop(*logs)
    fields = {**{f: f"_x_{f}" for f in NUMBERS}, **{c: f"_s_{c}" for c in categories}}
    x = nearest_donors(x, ["_platform", "_pid"], "_ts", key, {f: F.col(c).isNotNull() for f, c in fields.items()}, value={f: F.col(c) for f, c in fields.items()})
    wanted = {f: F.col(c).isNull() & (~F.col("_ks") if f == "funds_raised_percent" else F.lit(True)) for f, c in fields.items()}
    none = lambda t: F.lit(None).cast(t)
    both = lambda f, c: F.struct(c.cast("double").alias("x") if f in NUMBERS else none("double").alias("x"), none("string").alias("s") if f in NUMBERS else c.cast("string").alias("s"))
    true = lambda f: F.col(f"_true_{f}") if f"_true_{f}" in x.columns else none("double")
    gap = [F.when(w, F.struct(F.lit(f).alias("field_name"), F.col(f"from_{f}").alias("_from"), both(f, F.col(f"value_{f}")).alias("_own"), true(f).alias("_true"))) for f, w in wanted.items()]
    gaps = x.select(key, "_c", "_platform", F.col(f"_s_{parent}").alias("_p"), F.explode(F.array_compact(F.array(*gap))).alias("v")).select(key, "_c", "_platform", "_p", "v.*")

    def middle(by: list[str]) -> DataFrame:
        """The medians and modes of groups in which at least `support` rows have a value, as rows by field."""
        one = lambda f, c: F.when(F.count(c) >= (support if by else 1), F.percentile_approx(c, 0.5, 1000) if f in NUMBERS else F.mode(c))
        g = x.withColumnRenamed(f"_s_{parent}", "_p") if "_p" in by else x
        cols = {f: ("_p" if c == f"_s_{parent}" and "_p" in by else c) for f, c in fields.items()}
        g = g.groupBy(*by).agg(*[one(f, c).alias(f"_m_{f}") for f, c in cols.items()])
        tall = F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), both(f, F.col(f"_m_{f}")).alias("_m")) for f in fields])).alias("v")
        return g.select(*[F.col(b).alias(f"_by{b}") for b in by], tall).select(*[f"_by{b}" for b in by], "v.*")

    same = F.col("field_name") == F.col("_f")
    g = gaps.join(F.broadcast(middle(["_c"])), (F.col("_c") == F.col("_by_c")) & same, "left").withColumnRenamed("_m", "_cluster").drop("_f")  # k rows a field
    g = g.join(middle(["_platform", "_p"]), F.col("_platform").eqNullSafe(F.col("_by_platform")) & F.col("_p").eqNullSafe(F.col("_by_p")) & same, "left").withColumnRenamed("_m", "_group").drop("_f")
    return g.join(F.broadcast(middle([])), same, "left").withColumnRenamed("_m", "_all").drop("_f")  # one row a field


def fill_from_similar(
    df: DataFrame,
    key: str = "row_id",
    ts: str = "crawled_at",
    platform: str = "platform",
    ident: str = "id",
    parent: str = "category_parent_name",
    k: int = 12,
    passes: int = 4,
    categories: tuple[str, ...] = (),
    support: int = 5,
) -> DataFrame:
    """key, field_name, filled_value, filled_text, method, from_row_id for each missing goal, pledged and
    funds_raised_percent (the last of Indiegogo rows only), and each missing text of `categories`.

    method: `same_project` (from_row_id is the donor), else (no row of the project has the value, or the id is null;
    from_row_id -1) `cluster`, the median or mode of the row's k-prototypes cluster, `parent`, of its parent group, or
    `all`; a cluster or group in which fewer than `support` rows have the value gives none.  Equal rows give equal
    fills; an empty table gives no row; a field that no row has stays null with method `none`.  The rows are read
    once; what follows works on a saved table of numbers.
    """
    g = _gaps(saved(_narrow(df, key, ts, platform, ident, parent, categories)), key, parent, categories, k, passes, support)
    has = lambda c: F.coalesce(F.col(f"{c}.x").isNotNull() | F.col(f"{c}.s").isNotNull(), F.lit(False))
    method = (
        F.when(F.col("_from").isNotNull(), "same_project").when(has("_cluster"), "cluster").when(has("_group"), "parent")
        .when(has("_all"), "all").otherwise("none")
    )
    first = lambda c: F.coalesce(*[F.col(f"{n}.{c}") for n in ("_own", "_cluster", "_group", "_all")])
    return g.select(
        key, "field_name", first("x").alias("filled_value"), first("s").alias("filled_text"), method.alias("method"), F.coalesce("_from", F.lit(-1)).cast("bigint").alias("from_row_id"),
    )


def fill_errors(
    df: DataFrame, key: str = "row_id", ts: str = "crawled_at", platform: str = "platform", ident: str = "id", parent: str = "category_parent_name",
    k: int = 12, passes: int = 4, support: int = 5, hidden: float = 0.1,
) -> DataFrame:
    """field_name, method, n, median_error: a share `hidden` of the values that are there (by a hash of the row and
    field) is hidden and filled by each method that can; the error is the absolute difference of log10(1 + value)."""
    x = _narrow(df, key, ts, platform, ident, parent, ())
    hide = {f: F.pmod(F.xxhash64(F.col(key), F.lit(f)), F.lit(1000)) < int(hidden * 1000) for f in NUMBERS}
    x = x.withColumns({f"_true_{f}": F.when(hide[f], F.col(f"_x_{f}")) for f in NUMBERS}).withColumns({f"_x_{f}": F.when(~hide[f], F.col(f"_x_{f}")) for f in NUMBERS})
    g = _gaps(saved(x), key, parent, (), k, passes, support).filter("_true is not null")
    tall = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{c}.x").alias("x")) for m, c in (("same_project", "_own"), ("cluster", "_cluster"), ("parent", "_group"), ("all", "_all"))])).alias("v")
    e = g.select("field_name", "_true", tall).select("field_name", F.col("v.method").alias("method"), F.abs(F.log10(1 + F.col("v.x")) - F.log10(1 + F.col("_true"))).alias("_e")).filter("_e is not null")
    return e.groupBy("field_name", "method").agg(F.count("*").alias("n"), F.percentile_approx("_e", 0.5, 1000).alias("median_error"))
