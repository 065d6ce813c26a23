"""Reading level of each document.

Every sentence gets a distribution over the levels from regularised models over its words and their
characters; the sentences' distributions, weighted by length, are gathered by document and calibrated
against the raters' levels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import ENDS, is_sentence, sentences, units, weight, words_of

LEVELS = 5
BITS = 14
WORDS_KEPT = 200_000  # scored words kept in a worker


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its length, and its runs of three and four characters."""
    w = f"^{word}$"
    grams = {f"w{word}", f"l{min(len(word), 16)}", f"v{min(len([c for c in word if c in 'aeiouy']), 9)}"}
    grams |= {w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8")) & ((1 << BITS) - 1) for g in sorted(grams)]


class SentenceModel:
    """Softmax over the mean of the words' hashed features, with a ridge penalty.

    As the model is linear, a word's share in a sentence's score is a row of LEVELS numbers, kept by word.
    Bound: 2^BITS x LEVELS weights.
    """

    def __init__(self, weights: np.ndarray | None = None, bias: np.ndarray | None = None) -> None:
        self.weights = np.zeros((1 << BITS, LEVELS), dtype=np.float32) if weights is None else weights
        self.bias = np.zeros(LEVELS, dtype=np.float32) if bias is None else bias
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, LEVELS), dtype=np.float32)

    def rows(self, words: list[str]) -> list[int]:
        """The words' rows in the table of scores; new words are scored and added."""
        get = self.index.get
        out = list(map(get, words))
        if None in out:
            for w in words:
                if get(w) is None:
                    i = self.index[w] = len(self.index)
                    if i == len(self.table):
                        self.table = np.vstack([self.table, np.zeros_like(self.table)])
                    f = word_features(w)
                    self.table[i] = self.weights[f].sum(axis=0) / np.float32(np.sqrt(len(f)))
            out = list(map(get, words))
        return out

    def levels(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A distribution and the number of words of each sentence."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        n = np.array([len(x) for x in sents])
        flat = np.array(self.rows(list(chain.from_iterable(sents))))
        z = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None] + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), n

    def fit(self, sents: list[list[str]], target: np.ndarray, ridge: float = 1e-4, epochs: int = 30, rate: float = 2.0, seen: dict[str, list[int]] | None = None) -> "SentenceModel":
        """Full-batch gradient steps with AdaGrad scaling; `target` has a row of level shares a sentence, `seen` keeps
        words' features from fit to fit."""
        words = list(chain.from_iterable(sents))
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        n = np.array([len(s) for s in sents], dtype=np.int64)
        rows, vals = np.repeat(np.arange(len(sents)), n), np.repeat(1.0 / np.maximum(n, 1), n).astype(np.float32)
        cols = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        seen = {} if seen is None else seen
        for w in index:
            if w not in seen:
                seen[w] = word_features(w)
        wf = [seen[w] for w in index]
        fr = np.repeat(np.arange(len(wf)), [len(f) for f in wf])
        fc = np.concatenate([np.array(f) for f in wf]) if wf else np.zeros(0, int)
        fv = np.repeat([1 / np.sqrt(len(f)) for f in wf], [len(f) for f in wf]).astype(np.float32)
        grad2, bias2 = np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6)
        for _ in range(epochs):
            word_z = np.zeros((len(wf), LEVELS), dtype=np.float32)
            z = np.zeros((len(sents), LEVELS), dtype=np.float32)
            for k in range(LEVELS):
                word_z[:, k] = np.bincount(fr, weights=fv * self.weights[fc, k], minlength=len(wf))
                z[:, k] = np.bincount(rows, weights=vals * word_z[cols, k], minlength=len(sents))
            z += self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = (p - target) / max(1, len(sents))
            for k in range(LEVELS):
                gw = np.bincount(cols, weights=vals * err[rows, k], minlength=len(wf))
                g = np.bincount(fc, weights=fv * gw[fr], minlength=1 << BITS) + ridge * self.weights[:, k]
                grad2[:, k] += g**2
                self.weights[:, k] -= (rate * g / np.sqrt(grad2[:, k]) * 0.2).astype(np.float32)
            gb = err.sum(axis=0)
            bias2 += gb**2
            self.bias -= (0.2 * rate * gb / np.sqrt(bias2)).astype(np.float32)
        self.forget()
        return self


class Calibration:
    """Softmax from a document's gathered distribution to its level, with a ridge penalty."""

    def __init__(self) -> None:
        self.w = np.zeros((2 * LEVELS + 1, LEVELS))

    def features(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.column_stack([mean, top, np.ones(len(mean))])

    def probabilities(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        z = self.features(mean, top) @ self.w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, mean: np.ndarray, top: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 1500, rate: float = 1.0) -> "Calibration":
        x = self.features(mean, top)
        for _ in range(steps):
            p = self.probabilities(mean, top)
            self.w -= rate * (x.T @ (p - target) / max(1, len(x)) + ridge * self.w)
        return self


def _clause(s: str, words: list[str], every: frozenset[str]) -> bool:
    """An unfinished sentence of learned words, of which few are common."""
    plain = sum(1 for c in s if c.islower() or c.isspace()) >= 0.85 * len(s) or s.isupper()
    return len(words) >= 8 and plain and len(set(words)) >= 0.7 * len(words) and any(w in every for w in words)


def english_sentences(text: str, common: dict[str, frozenset[str]], every: frozenset[str]) -> tuple[list[list[str]], float, bool]:
    """The words of each sentence, the share of the text in sentences, and whether the text is English."""
    out, inside, total, letters = [], 0, 0, 0
    known: list[str] = []
    for u, _ in units(text):
        total += weight(u)
        for s in sentences(u):
            own = words_of(s)
            if not own:
                continue
            words = " ".join(own).lower().split(" ")  # words hold no blanks
            letters += len(words)
            shared = [w for w in words if w in every]
            known += shared
            if is_sentence(s, every, own, len(shared)) or ENDS.search(s) and sum(map(len, words)) > 0.5 * len(s) or _clause(s, words, every):
                out.append(words)
                inside += weight(s)
    counts = Counter(known)
    hits = {k: sum([n for w, n in counts.items() if w in v]) for k, v in common.items()}
    best = max(hits, key=lambda k: (hits[k], k == "en")) if hits else "en"
    return out, inside / max(1, total), best == "en" and hits.get("en", 0) > 0.05 * letters


def gather(docs: list[list[list[str]]], model: SentenceModel) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the mean distribution and the shares of the likeliest level, over the words of all its
    sentences; zeros where it has none."""
    mean, top = np.zeros((len(docs), LEVELS)), np.zeros((len(docs), LEVELS))
    at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    if len(at):
        p, n = model.levels([s for d in docs for s in d])
        total = np.bincount(at, weights=n, minlength=len(docs))
        best = p.argmax(axis=1)
        for k in range(LEVELS):
            mean[:, k] = np.bincount(at, weights=n * p[:, k], minlength=len(docs))
            top[:, k] = np.bincount(at, weights=n * (best == k), minlength=len(docs))
        mean, top = mean / np.maximum(total, 1)[:, None], top / np.maximum(total, 1)[:, None]
    return mean, top


def train(labelled: list[tuple[str, np.ndarray]], common: dict[str, frozenset[str]], folds: int = 4) -> tuple[SentenceModel, Calibration]:
    """The calibration learns from distributions of sentence models that haven't seen the document."""
    every = frozenset().union(*common.values()) if common else frozenset()
    docs = [(english_sentences(t, common, every)[0], y) for t, y in labelled]
    docs = [(s, y) for s, y in docs if s]

    seen: dict[str, list[int]] = {}

    def model(part: list) -> SentenceModel:
        sents = [x for s, _ in part for x in s]
        target = np.array([y for s, y in part for _ in s]).reshape(-1, LEVELS)
        return SentenceModel().fit(sents, target, seen=seen) if sents else SentenceModel()

    means, tops, ys = [], [], []
    for f in range(folds):
        held = docs[f::folds]
        if held:
            a, b = gather([s for s, _ in held], model([d for i, d in enumerate(docs) if i % folds != f]))
            means.append(a), tops.append(b), ys.extend(y for _, y in held)
    cal = Calibration()
    if ys:
        cal.fit(np.vstack(means), np.vstack(tops), np.array(ys))
    return model(docs), cal


def reading_levels(
    df: DataFrame,
    labels: DataFrame,
    common_words: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_labelled: int = 3000,
    prose: float = 0.5,
) -> DataFrame:
    """key, is_english, prose_share, level (1..5, the likeliest), difficulty (mean level), probabilities.

    The models are fitted on at most `max_labelled` labelled documents (chosen by a hash of the id, all
    rater's levels of a document as shares); every document is then scored over all of its sentences.
    Null, blank and non-English texts and texts of less than `prose` sentences have a null level.  Raters'
    null levels don't count; without labels the level is null.  Each row of df gives one row.
    `common_words` is a fixed table.
    """
    by: dict[str, set] = {}
    for r in common_words.select("lang", "word").collect():
        by.setdefault(r["lang"], set()).add(r["word"].lower())
    common = {k: frozenset(v) for k, v in sorted(by.items())}
    every = frozenset().union(*common.values()) if common else frozenset()
    shares = (
        labels.filter(F.col("reading_level").between(1, LEVELS))
        .groupBy(F.col(key).alias("_k"))
        .agg(*[F.avg((F.col("reading_level") == i).cast("double")).alias(f"y{i}") for i in range(1, LEVELS + 1)])
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(max_labelled)
    )
    # at most max_labelled rows: the bound of the training sample
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(shares), "_k").filter(F.col("_t").isNotNull()).dropDuplicates(["_k"]).orderBy("_k").limit(max_labelled).collect()
    fitted = bool(rows)
    model, cal = train([(r["_t"], np.array([r[f"y{i}"] for i in range(1, LEVELS + 1)])) for r in rows], common)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, cal.w))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = SentenceModel(shared.value[0], shared.value[1]), Calibration()
        c.w = shared.value[2]
        for batch in batches:
            english, share, docs, scored = [], [], [], []
            for t in batch.column(1).to_pylist():
                sents, part, en = english_sentences(t, common, every) if t and not t.isspace() else ([], None, None)
                ok = bool(fitted and en and sents and part >= prose)
                english.append(en), share.append(part), scored.append(ok), docs.append(sents if ok else [])
            if not english:
                continue
            p = c.probabilities(*gather(docs, m))
            level = [int(x.argmax()) + 1 if ok else None for x, ok in zip(p, scored)]
            diff = [float(x @ np.arange(1, LEVELS + 1)) if ok else None for x, ok in zip(p, scored)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(english, pa.bool_()), pa.array(share, pa.float64()), pa.array(level, pa.int32()), pa.array(diff, pa.float64()),
                    pa.array([x.tolist() if ok else None for x, ok in zip(p, scored)], pa.list_(pa.float64())),
                ],
                ["key", "is_english", "prose_share", "level", "difficulty", "probabilities"],
            )

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, is_english boolean, prose_share double, level int, difficulty double, probabilities array<double>"
    )
    return out.withColumnRenamed("key", key)
