"""Least squares by formula from sums over all rows, model ladders, mediation with a bootstrap.

A formula is compiled to columns of a design; one aggregation gives the cross products of all of them; the small
systems are solved on the driver.  Columns are centred by their means first, so that large offsets cost no digits.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LEVELS = 500  # a factor with more levels is refused: the design would not fit the driver


@dataclass
class Fit:
    """Coefficients and their tests."""

    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    n: int
    rank: int

    def frame(self, spark: SparkSession, model: str = "m") -> DataFrame:
        rows = [(model, k, *(None if math.isnan(x) else float(x) for x in v)) for k, v in zip(self.names, zip(self.coef, self.se, self.t, self.p))]
        return spark.createDataFrame(rows, "model string, term string, coef double, se double, t double, p double")


def student_p(t: float, df: int) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    if x <= 0 or x >= 1:
        return 1.0 if x >= 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def terms(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """Outcome and terms of `y ~ a*b + c:d + C(f)`, each once, in order."""
    y, rhs = (x.strip() for x in formula.split("~"))
    out: list[tuple[str, ...]] = []
    for part in (p.strip() for p in rhs.split("+")):
        if "*" in part:
            atoms = [a.strip() for a in part.split("*")]
            subsets = [tuple(a for k, a in enumerate(atoms) if m >> k & 1) for m in range(1, 1 << len(atoms))]
            new = sorted(subsets, key=len)
        else:
            new = [tuple(a.strip() for a in part.split(":"))]
        out += [t for t in new if t not in out]
    return y, sorted(out, key=len)


def _variables(ts: list[tuple[str, ...]]) -> tuple[list[str], list[str]]:
    plain, factors = [], []
    for t in ts:
        for a in t:
            m = re.fullmatch(r"C\((\w+)\)", a)
            (factors if m else plain).append(m.group(1) if m else a)
    return list(dict.fromkeys(plain)), list(dict.fromkeys(factors))


def solve(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, means: np.ndarray, ybar: float, names: list[str]) -> Fit:
    """From centred cross products; a rank-deficient design gets the pseudo-inverse's solution."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inv = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9, hermitian=True)) if len(names) else 0
    b = inv @ xy
    rss = max(yy - float(b @ xy), 0.0)
    df = n - rank - 1
    s2 = rss / df if df > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv), 0) * s2)
    b0 = ybar - float(b @ means)
    se0 = math.sqrt(max(s2 * (1 / n + float(means @ inv @ means)), 0)) if n and df > 0 else float("nan")
    coef, se = np.concatenate([[b0], b]), np.concatenate([[se0], se])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    p = np.array([student_p(float(x), df) for x in t])
    return Fit(["Intercept", *names], coef, se, t, p, 1 - rss / yy if yy > 0 else float("nan"), n, rank + 1)


def ols(df: DataFrame, formula: str) -> Fit:
    """Least squares of a formula; rows with a null or NaN in any variable are dropped."""
    return fit_all(df, [("m", formula, None)])["m"]


def _crosses(c: DataFrame, k: int) -> dict[str, np.ndarray]:
    """Sum of v v' by g: each partition gives what isn't zero of one k x k matrix a group, added up by Spark."""

    def part(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        total: dict[str, np.ndarray] = {}
        for b in batches:
            for g, rows in b.groupby("g")["v"]:
                v = np.vstack(rows.to_numpy())
                total[g] = total.get(g, 0) + v.T @ v
        for g, m in total.items():
            i, j = np.nonzero(m)
            yield pd.DataFrame({"g": g, "i": i.astype("int32"), "j": j.astype("int32"), "s": m[i, j]})

    got = c.mapInPandas(part, "g string, i int, j int, s double").groupBy("g", "i", "j").agg(F.sum("s").alias("s")).collect()  # groups x k x k numbers
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["g"], np.zeros((k, k)))[r["i"], r["j"]] = r["s"]
    return out


_CONTROLS = "text_quality*indiegogo + text_quality*PostGPT + indiegogo*PostGPT"
# The nested models of the study.
LADDER = [
    f"log_pledged_amount ~ {_CONTROLS}",
    f"log_pledged_amount ~ {_CONTROLS} + log_goal + word_count",
    f"log_pledged_amount ~ {_CONTROLS} + log_goal + word_count + C(category_unified)",
    f"log_pledged_amount ~ {_CONTROLS} + log_goal + word_count + C(category_unified) + C(year):C(month)",
    f"success_indicator ~ {_CONTROLS} + indiegogo:PostGPT:text_quality + ai_score + ai_score:PostGPT + log_goal + C(category_unified) + word_count + C(year):C(month)",
]

#: Those of the rows that succeeded: M4 and M5 leave out terms.
LADDER_SUCCESSFUL = [
    *LADDER[:3],
    "log_pledged_amount ~ indiegogo + text_quality*PostGPT + indiegogo*PostGPT + log_goal + word_count + C(category_unified) + C(year):C(month)",
    "log_pledged_amount ~ text_quality*PostGPT + PostGPT + ai_score*PostGPT + log_goal + C(category_unified) + word_count + C(year):C(month)",
]
# The terms that the study's table shows.
SHOWN = ["text_quality", "indiegogo", "PostGPT", "text_quality:indiegogo", "text_quality:PostGPT", "indiegogo:PostGPT", "ai_score", "ai_score:indiegogo", "ai_score:PostGPT"]


def fit_all(df: DataFrame, models: list[tuple[str, str, str | None]]) -> dict[str, Fit]:
    """Many formulas from one table: (name, formula, flag), where a flag is a 0/1 column that keeps the rows with 1.

    Three passes over the rows (means, levels, cross products), whatever the number of models; the last gives the cross
    products of every column of every design.  These are kept apart by flags and by which variables are missing, so that
    each model adds up the rows that it may use; its levels and its first levels are those of these rows.  A factor's
    first level (sorted) is left out, but in an interaction of factors only where its main effects are in the model.
    """
    split = [terms(f) for _, f, _ in models]
    plain = list(dict.fromkeys(v for y, ts in split for v in [y, *_variables(ts)[0]]))
    factors = list(dict.fromkeys(v for _, ts in split for v in _variables(ts)[1]))
    flags = list(dict.fromkeys(f for _, _, f in models if f))
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in plain], *[F.col(f).cast("string").alias(f"_f_{f}") for f in factors], *[F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f"_b_{f}") for f in flags])
    top = x.agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in plain]).first()
    if not top["_n"]:
        raise ValueError("no complete rows")
    levels: dict[str, list[str]] = {f: [] for f in factors}
    if factors:
        both = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_f_{f}").alias("v")) for f in factors])).alias("x")
        for r in x.select(both).select("x.*").filter("v is not null").distinct().limit(len(factors) * MAX_LEVELS + 1).collect():
            levels[r["f"]].append(r["v"])
    for f, got in levels.items():
        if len(got) > MAX_LEVELS or sum(map(len, levels.values())) > len(factors) * MAX_LEVELS:
            raise ValueError(f"a factor has more than {MAX_LEVELS} levels")
        levels[f] = sorted(got, key=(lambda v: (int(v), v)) if all(re.fullmatch(r"-?\d+", v) for v in got) else None)
    cols: dict[str, Column] = {}

    def named(t: tuple[str, ...]) -> list[tuple[str, ...]]:
        """Columns of a term, as tuples of atoms: a factor's atom is (its name, a level)."""
        out: list[tuple] = [()]
        for a in t:
            m = re.fullmatch(r"C\((\w+)\)", a)
            out = [(*o, x) for o in out for x in ([(m.group(1), v) for v in levels[m.group(1)]] if m else [a])]
        return out

    label = lambda atoms: ":".join(a if isinstance(a, str) else f"C({a[0]})[{a[1]}]" for a in atoms)
    for y, ts in split:
        cols.setdefault(y, F.col(y))
        for t in ts:
            for atoms in named(t):
                c = F.lit(1.0)
                for a in atoms:
                    c = c * (F.col(a) if isinstance(a, str) else (F.col(f"_f_{a[0]}") == a[1]).cast("double"))
                cols.setdefault(label(atoms), c)
    shift = {c: float(top[c] or 0.0) for c in cols if c in plain}  # a shift of each plain variable costs no model anything
    names = list(cols)
    at = {c: i + 1 for i, c in enumerate(names)}
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in plain], *[F.col(f"_f_{f}").isNull().cast("int").cast("string") for f in factors], *[F.col(f"_b_{f}").cast("string") for f in flags])
    rows = x.select(mask.alias("g"), F.array(F.lit(1.0), *[F.coalesce(cols[c] - F.lit(shift.get(c, 0.0)), F.lit(0.0)) for c in names]).alias("v"))
    crosses = _crosses(rows, len(names) + 1)
    place = {v: i for i, v in enumerate([*plain, *[f"_f_{f}" for f in factors], *[f"_b_{f}" for f in flags]])}
    out = {}
    for (name, _, flag), (y, ts) in zip(models, split):
        need = [place[v] for v in [y, *_variables(ts)[0]]] + [place[f"_f_{f}"] for f in _variables(ts)[1]]
        total = sum((m for g, m in crosses.items() if all(g[i] == "0" for i in need) and (not flag or g[place[f"_b_{flag}"]] == "1")), np.zeros((len(names) + 1, len(names) + 1)))
        n = int(round(total[0, 0]))
        if not n:
            raise ValueError(f"{name}: no complete rows")
        keep = []
        for t in ts:
            one = [label(a) for a in named(t)]
            here = [c for c in one if total[at[c], at[c]] != 0 or not re.search(r"C\(", c)]  # levels that these rows have
            whole = len(t) == 1 or all((a,) in ts for a in t if a.startswith("C("))
            keep += here[1:] if len(t) == 1 and t[0].startswith("C(") else [c for c in here if not (whole and _first_level(c, total, at, levels))]
        i, j = [at[c] for c in keep], at[y]
        s, sy = total[0, i], total[0, j]
        gram = total[np.ix_(i, i)] - np.outer(s, s) / n
        xy = total[i, j] - s * sy / n
        move = lambda c: shift.get(c, 0.0)
        means = s / n + np.array([move(c) for c in keep])
        out[name] = solve(gram, xy, float(total[j, j] - sy * sy / n), n, means, sy / n + move(y), keep)
    return out


def _first_level(column: str, total: np.ndarray, at: dict[str, int], levels: dict[str, list[str]]) -> bool:
    """Whether an interaction's column holds the first level (of those that the rows have) of one of its factors."""
    for f, v in re.findall(r"C\((\w+)\)\[([^\]]*)\]", column):
        have = [x for x in levels[f] if (c := f"C({f})[{x}]") in at and total[at[c], at[c]] != 0]
        if have and v == have[0]:
            return True
    return False


def ladder(df: DataFrame, models: list[tuple[str, str, str | None]]) -> DataFrame:
    """Coefficients of the models with stars (N2, N3): model, term, coef, se, t, p, r2, n, stars."""
    from ..functions.text import stars

    rows = []
    number = lambda x: None if math.isnan(x) else float(x)
    for name, fit in fit_all(df, models).items():
        rows += [(name, k, *(number(v) for v in values), number(fit.r2), fit.n) for k, values in zip(fit.names, zip(fit.coef, fit.se, fit.t, fit.p))]
    out = df.sparkSession.createDataFrame(rows, "model string, term string, coef double, se double, t double, p double, r2 double, n bigint")
    return out.withColumn("stars", stars(F.col("p")))


def coefficient_table(coefs: DataFrame, models: list[str], shown: list[str] = SHOWN) -> DataFrame:
    """Terms by models (N3): `0.123***` over `(0.045)`; terms that no model has are left out."""
    from ..functions.text import stars

    level = F.when(stars(F.col("p")) == ".", "").otherwise(stars(F.col("p")))
    cell = F.concat(F.format_string("%.3f", "coef"), level, F.lit(" ("), F.coalesce(F.format_string("%.3f", "se"), F.lit("")), F.lit(")"))
    order = F.array_position(F.array(*[F.lit(s) for s in shown]), F.col("term"))
    t = coefs.filter(F.col("term").isin(shown)).withColumn("cell", cell)
    return t.groupBy(order.cast("int").alias("place"), "term").pivot("model", models).agg(F.first("cell")).na.fill("", models)


def slope_difference(a: Fit, b: Fit, term: str) -> tuple[float, float, float]:
    """b - a, z and its two-sided p."""
    i, j = a.names.index(term), b.names.index(term)
    d = float(b.coef[j] - a.coef[i])
    z = d / math.sqrt(float(a.se[i] ** 2 + b.se[j] ** 2))
    return d, z, normal_p(z)


def verdict(p: float, alpha: float = 0.05) -> str:
    """`changed` if p is below alpha, else `no change found` (N8); a p that isn't a number decides nothing."""
    return "undecided" if math.isnan(p) else "changed" if p < alpha else "no change found"


def paths_compared(df: DataFrame, treat: str, mediator: str, outcome: str, controls: str, flags: tuple[str, str]) -> DataFrame:
    """Paths a (treatment to mediator) and b (mediator to outcome) of two samples, each told by a 0/1 column (N5, N7, N8):
    path, before, p_before, after, p_after, difference, z, p_difference, finding."""
    a, b = f"{mediator} ~ {treat} + {controls}", f"{outcome} ~ {mediator} + {treat} + {controls}"
    fits = fit_all(df, [(f"{p}{i}", f, flag) for p, f in (("a", a), ("b", b)) for i, flag in enumerate(flags)])
    rows = []
    for path, term in (("a", treat), ("b", mediator)):
        one, two = fits[f"{path}0"], fits[f"{path}1"]
        i, j = one.names.index(term), two.names.index(term)
        diff, z, p = slope_difference(one, two, term)
        c0, p0, c1, p1 = float(one.coef[i]), float(one.p[i]), float(two.coef[j]), float(two.p[j])
        finding = verdict(p) if path == "a" else "negative after" if c1 < 0 and p1 < 0.05 else "lower after" if c1 < c0 and p < 0.05 else "no change found"
        rows.append((path, *(None if math.isnan(x) else x for x in (c0, p0, c1, p1, diff, z, p)), finding))
    return df.sparkSession.createDataFrame(rows, "path string, before double, p_before double, after double, p_after double, difference double, z double, p_difference double, finding string")


def mediation(
    df: DataFrame, treat: str, mediator: str, outcome: str, controls: list[str], key: str, draws: int = 200, seed: int = 2025, factors: tuple[str, ...] = ()
) -> DataFrame:
    """acme (a x b), ade, total, and for acme the bootstrap's 95 % limits and p (N5, N6); `factors` are controls by level.

    A draw weights each row by a Poisson(1) number told by a hash of key, draw and seed, so a row has the
    same weights wherever it is; every partition gives one weighted cross product a draw, added up by Spark.
    """
    import pandas as pd

    cols = [treat, mediator, outcome, *controls]
    rows = df.na.drop(subset=[*cols, *factors])
    dummies = []
    for f in factors:
        got = [r[0] for r in rows.select(F.col(f).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(got) > MAX_LEVELS:
            raise ValueError(f"{f} has more than {MAX_LEVELS} levels")
        dummies += [(F.col(f).cast("string") == v).cast("double") for v in sorted(got)[1:]]
    rows = rows.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols], *dummies).alias("v"))
    k = len(cols) + len(dummies) + 1
    cum = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    upper = np.triu_indices(k)

    def part(batches):  # noqa: ANN001, ANN202
        total = np.zeros((draws + 1, k, k))
        for b in batches:
            if not len(b):
                continue
            v, h = np.vstack(b["v"].to_numpy()), b["h"].to_numpy().astype(np.uint64)
            total[0] += v.T @ v
            for d in range(draws):
                with np.errstate(over="ignore"):
                    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (d + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cum, (x >> np.uint64(11)).astype(np.float64) / 2.0**53)
                total[d + 1] += (v * w[:, None]).T @ v
        yield pd.DataFrame({"d": np.arange(draws + 1, dtype="int32"), "s": [m[upper] for m in total]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [g["d"].iloc[0]], "s": [np.sum(np.vstack(g["s"].to_numpy()), axis=0)]})

    got = rows.mapInPandas(part, "d int, s array<double>").groupBy("d").applyInPandas(added, "d int, s array<double>").collect()  # draws x k x k / 2 numbers
    g = np.zeros((draws + 1, k, k))
    for r in got:
        g[r["d"]][upper] = r["s"]
        g[r["d"]] = np.triu(g[r["d"]]) + np.triu(g[r["d"]], 1).T
    at = {c: i + 1 for i, c in enumerate(cols)}
    ctl = list(range(4, k))

    def paths(m: np.ndarray) -> tuple[float, float]:
        size = np.sqrt(np.maximum(np.diag(m), 1e-300))
        m = m / np.outer(size, size)  # the same scale for all, so that the pseudo-inverse drops only what is dependent
        xa, xb = [0, at[treat], *ctl], [0, at[treat], at[mediator], *ctl]
        a = np.linalg.pinv(m[np.ix_(xa, xa)], rcond=1e-12, hermitian=True) @ m[xa, at[mediator]]
        b = np.linalg.pinv(m[np.ix_(xb, xb)], rcond=1e-12, hermitian=True) @ m[xb, at[outcome]]
        back = lambda c, of, on: float(c * size[on] / size[of])
        return back(a[1], at[treat], at[mediator]) * back(b[2], at[mediator], at[outcome]), back(b[1], at[treat], at[outcome])

    acme, ade = paths(g[0])
    boot = np.array([paths(x)[0] for x in g[1:]])
    share = float(np.mean(boot > 0)) if draws else float("nan")
    row = (acme, ade, acme + ade, float(np.quantile(boot, 0.025)), float(np.quantile(boot, 0.975)), 2 * min(share, 1 - share))
    return df.sparkSession.createDataFrame([row], "acme double, ade double, total double, low double, high double, p double")
