"""Per-document text statistics and a verdict: natural prose, or a list, a table or junk.

All statistics together are held against the mean and covariance of their language's prose by the Mahalanobis
distance, which decides.  The reference are the documents that stand almost wholly in sentences; mean and
covariance are robust (concentration steps on the half of them nearest to the centre, from medians and deviations).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved
from .units import CJK, ENDS, cjk_count, is_sentence, sentences, units, weight, words_of

STATS = ["log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_end_share", "common_word_share", "distinct_word_share", "words_per_sentence", "sentence_share"]
LANGS = ["en", "de", "fr", "es", "ja"]
# What little is assumed of prose before documents are seen, and how much of a difference in each
# statistic proves nothing.
PRIOR = {"ja": [4.8, 1.05, 0.5, 0.01, 0.95, 0.5, 0.65, 14.0, 0.98], "": [4.5, 4.6, 0.03, 0.01, 0.95, 0.4, 0.75, 14.0, 0.98]}
PRIOR_DOCS = 10
TOLERANCE = [0.5, 0.5, 0.03, 0.03, 0.4, 0.08, 0.1, 6.0, 0.05]
_SCHEMA = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(s, T.DoubleType()) for s in STATS]])


def reads(words: list[str], every: frozenset[str]) -> bool:
    """Whether common words are spread over the whole of a long sentence: a list or junk that ends with one
    sentence, without a mark between them, has none over most of its length."""
    if len(words) < 16:
        return True
    parts = [words[i : i + 8] for i in range(0, len(words) - 7, 8)]
    return 2 * sum(any(w in every for w in p) for p in parts) >= len(parts)


def document_stats(text: str, common: dict[str, frozenset[str]], every: frozenset[str]) -> tuple:
    """The language (by common words, or by script) and the statistics of one text."""
    us = units(text, notes=True)
    chars = sum(weight(u) for u, _ in us)
    lower: list[str] = []
    shared: list[str] = []
    in_sentences = punct = n_sent = sent_words = letters = 0
    for u, _ in us:
        size = weight(u)
        if ENDS.search(u):
            punct += size
        for s in sentences(u):
            w = CJK.findall(s) if cjk_count(s) * 2 > len(s) else words_of(s)
            low = " ".join(w).lower().split(" ") if w else []  # words hold no blanks
            near = [x for x in low if x in every]
            lower += low
            shared += near
            letters += sum(map(len, w))
            if is_sentence(s, every, w, len(near)) and (reads(low, every) or cjk_count(s) * 2 > len(s)):
                in_sentences += weight(s)
                n_sent += 1
                sent_words += len(w)
    n = len(lower)
    counts = Counter(shared)
    hits = {k: sum([c for w, c in counts.items() if w in v]) for k, v in common.items()}
    if n and not text.isascii() and sum(1 for w in lower if len(w) == 1 and CJK.match(w)) * 2 > n:
        lang, known = "ja", sum(1 for w in lower if "ぁ" <= w <= "ん")
    else:
        lang = max(sorted(hits), key=lambda k: hits[k]) if hits else "und"
        known = hits.get(lang, 0)
        if known < 0.08 * n or known == 0:
            lang = "und"
    chars = max(chars, 1)
    digits = sum(map(str.isdigit, text))
    return (
        lang,
        math.log1p(n),
        min(letters / n, 60.0) if n else 0.0,
        max(0, chars - letters - digits) / chars,
        digits / chars,
        punct / chars,
        known / n if n else 0.0,
        len(set(lower)) / n if n else 0.0,
        min(sent_words / n_sent, 80.0) if n_sent else 0.0,
        in_sentences / chars,
    )


def stats_of(text: Column, common: dict[str, frozenset[str]]) -> Column:
    every = frozenset().union(*common.values()) if common else frozenset()

    def run(s: pd.Series) -> pd.DataFrame:
        seen: dict[str, tuple] = {}  # repeated crawls bring the same text; within a batch it is read once
        rows = []
        for t in s:
            if t is None or not t.strip():
                rows.append((None,) * (1 + len(STATS)))
            else:
                if t not in seen:
                    seen[t] = document_stats(t, common, every)
                rows.append(seen[t])
        return pd.DataFrame(rows, columns=["lang", *STATS])

    return F.pandas_udf(run, _SCHEMA)(text)


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    lo, hi = -8.0, 8.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return k * (1 - 2 / (9 * k) + lo * math.sqrt(2 / (9 * k))) ** 3


class ProseModel:
    """Robust mean and covariance of the statistics of each language's prose.

    The reference are the documents with at least `reference` of their characters in sentences; PRIOR counts as
    PRIOR_DOCS documents, so that a language of few documents (or none) has a model too.  The model has
    5 languages x (k + k^2) numbers whatever the size of the corpus; each step is one aggregation over all documents.
    """

    def __init__(self, steps: int = 3, reference: float = 0.8, mostly: float = 0.5, outlier: float = 0.99) -> None:
        self.steps, self.reference, self.mostly, self.outlier = steps, reference, mostly, outlier
        self.mean: dict[str, np.ndarray] = {}
        self.inv: dict[str, np.ndarray] = {}
        self.usual: dict[str, float] = {}  # the distance that `outlier` of the reference stay below

    def fit(self, stats: DataFrame) -> "ProseModel":
        k = len(STATS)
        for g in LANGS:
            self._set(g, np.array(PRIOR.get(g, PRIOR[""])), np.zeros((k, k)))
        ref = stats.filter(F.col("lang").isin(LANGS) & (F.col("sentence_share") >= self.reference)).select(F.col("lang").alias("g"), *STATS)
        for r in ref.groupBy("g").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(s) for s in STATS], F.count("*").alias("n")).collect():  # one row a language
            q = np.array([r[s] for s in STATS], dtype=float)
            w = r["n"] / (r["n"] + PRIOR_DOCS)
            self._set(r["g"], w * q[:, 1] + (1 - w) * self.mean[r["g"]], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))
        for _ in range(self.steps):
            d = ref.withColumn("d2", self.distance(F.col("g")))
            half = {r["g"]: r["m"] for r in d.groupBy("g").agg(F.percentile_approx("d2", 0.5, 2000).alias("m")).collect()}
            if not half:
                break
            limit = F.create_map(*[x for g, m in half.items() for x in (F.lit(g), F.lit(float(m)))])
            core = d.filter(F.col("d2") <= limit[F.col("g")])
            sums = [F.sum(s).alias(f"s_{s}") for s in STATS]
            sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(STATS) for j, b in enumerate(STATS) if j >= i]
            for r in core.groupBy("g").agg(F.count("*").alias("n"), *sums).collect():
                n, prior = r["n"], np.array(PRIOR.get(r["g"], PRIOR[""]))
                m = np.array([r[f"s_{s}"] for s in STATS]) / n
                c = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        c[i, j] = c[j, i] = r[f"p_{i}_{j}"] / n - m[i] * m[j]
                w = n / (n + PRIOR_DOCS)
                self._set(r["g"], w * m + (1 - w) * prior, c)
        for r in ref.withColumn("d2", self.distance(F.col("g"))).groupBy("g").agg(F.percentile_approx("d2", self.outlier, 2000).alias("q")).collect():
            self.usual[r["g"]] = max(float(r["q"]), chi2_quantile(self.outlier, k))
        return self

    def _set(self, g: str, mean: np.ndarray, cov: np.ndarray) -> None:
        self.mean[g], self.inv[g] = mean, np.linalg.inv(cov + np.diag(np.array(TOLERANCE) ** 2))

    def limit(self, g: str) -> float:
        """The distance of a text of which just `mostly` stands in sentences and which else is in the middle of prose,
        and what prose varies besides."""
        i = STATS.index("sentence_share")
        return float((self.mean[g][i] - self.mostly) ** 2 * self.inv[g][i, i]) + chi2_quantile(self.outlier, len(STATS))

    def _score(self) -> Callable:
        mean, inv = dict(self.mean), dict(self.inv)
        limits = {g: self.limit(g) for g in mean}
        usual = {g: self.usual.get(g, chi2_quantile(self.outlier, len(STATS))) for g in mean}

        def run(g: pd.Series, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """d2, contributions, the language's limit and its usual distance; texts of no known language are held
            against the one that they are nearest to."""
            d2, part = np.full(len(g), np.nan), np.full(x.shape, np.nan)
            top, often = np.full(len(g), np.nan), np.full(len(g), np.nan)
            near = np.full(len(g), np.inf)
            known = g.notna().to_numpy()
            for lang in mean:
                rows = known & ((g == lang) | ~g.isin(list(mean))).to_numpy()
                z = x[rows] - mean[lang]
                p = z * (z @ inv[lang])
                share = p.sum(axis=1) / limits[lang]
                at = np.flatnonzero(rows)[share < near[rows]]
                p = p[share < near[rows]]
                near[at] = p.sum(axis=1) / limits[lang]
                part[at], d2[at], top[at], often[at] = p, p.sum(axis=1), limits[lang], usual[lang]
            return d2, part, top, often

        return run

    def distance(self, group: Column) -> Column:
        run = self._score()

        def f(g: pd.Series, *cols: pd.Series) -> pd.Series:
            return pd.Series(run(g, np.column_stack([c.to_numpy(dtype=float) for c in cols]))[0])

        return F.pandas_udf(f, T.DoubleType())(group, *[F.col(s) for s in STATS])

    def verdicts(self) -> Column:
        """d2, contributions, is_outlier and is_prose of each row."""
        run = self._score()
        schema = T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType())), T.StructField("is_outlier", T.BooleanType()), T.StructField("is_prose", T.BooleanType())])

        def f(g: pd.Series, *cols: pd.Series) -> pd.DataFrame:
            d2, part, top, often = run(g, np.column_stack([c.to_numpy(dtype=float) for c in cols]))
            return pd.DataFrame({"d2": d2, "contributions": list(part), "is_outlier": d2 > often, "is_prose": d2 <= top})

        return F.pandas_udf(f, schema)(F.col("lang"), *[F.col(s) for s in STATS])


def text_quality(
    df: DataFrame,
    common_words: DataFrame,
    key: str = "row_id",
    text: str = "story_content",
    outlier: float = 0.99,
    mostly: float = 0.5,
) -> DataFrame:
    """key, lang, the statistics, d2 (squared distance to the language's prose), contributions (one a
    statistic, they add up to d2), is_outlier and is_prose.

    A text is an outlier if it is farther from the language's prose than `outlier` of that prose is; it isn't prose
    if it is farther than a text with just `mostly` of its characters in sentences would be (ProseModel.limit).
    Null and blank texts have null statistics and verdicts.  Texts of no known language are held against the
    language whose prose they are nearest to.  `common_words` is a fixed table (175 rows).
    """
    by: dict[str, set] = {}
    for r in common_words.select("lang", "word").collect():
        by.setdefault(r["lang"], set()).add(r["word"].lower())
    common = {k: frozenset(v) for k, v in sorted(by.items())}
    x = df.select(key, F.col(text).alias("_text")).withColumn("_s", stats_of(F.col("_text"), common)).select(key, "_s.*")
    x = saved(x)  # the texts are read once; the model takes several passes over the numbers
    model = ProseModel(mostly=mostly, outlier=outlier).fit(x)
    x = x.withColumn("_d", model.verdicts())
    known = F.col("lang").isNotNull()
    return x.select(key, "lang", *STATS, *[F.when(known, F.col("_d")[c]).alias(c) for c in ("d2", "contributions", "is_outlier", "is_prose")])
