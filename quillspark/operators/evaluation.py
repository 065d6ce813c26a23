"""How well a score tells a label: confusion matrix, accuracy, report by class (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn; a score at the threshold is positive; rows with a null don't count."""
    p = (score >= threshold).cast("int")
    return df.select(label.cast("int").alias("y"), p.alias("p")).filter("y is not null and p is not null").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"), F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def report(c: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support for 0, 1, macro avg, weighted avg, and accuracy as f1 of its own row;
    a ratio without cases is 0."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, p0, r0 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f = lambda p, r: _ratio(2 * p * r, p + r)
    s1, s0 = tp + fn, tn + fp
    wavg = lambda a, b: _ratio(a * s0 + b * s1, n)
    row = lambda name, p, r, f1, s: F.struct(F.lit(name).alias("class"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), s.cast("bigint").alias("support"))
    f0, f1_ = f(p0, r0), f(p1, r1)
    acc = _ratio(tp + tn, n)
    rows = [
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1_, s1), row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1_), n), row("accuracy", acc, acc, acc, n),
    ]
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
