"""Scores of texts by lexicons and by injected models; calibration of a classifier's logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, alpha_tokens, sentences
from ..session import saved


SMALL_LEXICON = 200_000  # words that are looked up in the row; a larger lexicon is joined


def _lexicon(lexicon: DataFrame, word: str, score: str) -> dict[str, tuple[float, int]] | None:
    """Sum and number of each word's scores, or None if there are more than SMALL_LEXICON words."""
    g = lexicon.groupBy(F.lower(word).alias("w")).agg(F.sum(F.col(score).cast("double")).alias("s"), F.count(F.col(score).cast("double")).alias("n")).filter("w is not null and n > 0")
    rows = g.limit(SMALL_LEXICON + 1).collect()
    return None if len(rows) > SMALL_LEXICON else {r["w"]: (r["s"], r["n"]) for r in rows}


def _looked_up(df: DataFrame, text: str, lexicon: DataFrame, word: str, score: str, out: str) -> DataFrame:
    """Adds `out`: s and h (sum and number of scores), p and q (sums of 1 + |score| of the good and the bad) and u (tokens
    that are neither) over a row's tokens.  Rows keep apart, whatever their keys."""
    small = _lexicon(lexicon, word, score)
    schema = "s double, h bigint, p double, q double, u bigint"
    if small is not None:
        shared = df.sparkSession.sparkContext.broadcast(small)  # its size is checked

        def run(tokens: pd.Series) -> pd.DataFrame:
            get, rows = shared.value.get, []
            for t in tokens:
                s, h, p, q, u = 0.0, 0, 0.0, 0.0, 0
                for w in t if t is not None else ():
                    v, n = get(w, (0.0, 0))
                    s, h = s + v, h + n
                    p, q = (p + v + n, q) if v > 0 else (p, q + n - v) if v < 0 else (p, q)
                    u += (n or 1) if v == 0 else 0
                rows.append((s, h, p, q, u))
            return pd.DataFrame(rows, columns=["s", "h", "p", "q", "u"])

        return df.withColumn(out, F.pandas_udf(run, schema)(alpha_tokens(F.col(text))))
    lex = lexicon.groupBy(F.lower(word).alias("_w")).agg(F.sum(F.col(score).cast("double")).alias("_v"), F.count(F.col(score).cast("double")).alias("_m"))
    x = saved(df.withColumn("_row", F.monotonically_increasing_id()))  # rows must keep their number
    t = x.select("_row", F.explode(alpha_tokens(F.col(text))).alias("_w")).groupBy("_row", "_w").agg(F.count("*").alias("_k")).join(lex, "_w", "left")
    v, m, k = F.coalesce("_v", F.lit(0.0)), F.coalesce("_m", F.lit(0)), F.col("_k")
    g = t.groupBy("_row").agg(F.struct(
        F.sum(v * k).alias("s"), F.sum(m * k).alias("h"), F.sum(F.when(v > 0, (v + m) * k).otherwise(0.0)).alias("p"), F.sum(F.when(v < 0, (m - v) * k).otherwise(0.0)).alias("q"),
        F.sum(F.when(v == 0, F.greatest(m, F.lit(1)) * k).otherwise(0)).alias("u")).alias(out))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("h"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0).cast("bigint").alias("u"))
    return x.join(g, "_row", "left").withColumn(out, F.coalesce(out, none)).drop("_row")


def lexicon_mean(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str, score: str) -> DataFrame:
    """Mean score of the tokens found in the lexicon, null if none is, and hits (E1); one row a row of df.

    A word that is twice in the lexicon counts twice.  A lexicon of up to SMALL_LEXICON words is looked up where the
    text is; a larger one is joined by Spark's own choice of strategy.
    """
    x = _looked_up(df.select(key, text), text, lexicon, word, score, "_l")
    hits = F.nullif(F.col("_l.h"), F.lit(0))
    return x.select(key, (F.col("_l.s") / hits).alias("mean_score"), hits.alias("hits"))


def sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str, score: str) -> DataFrame:
    """neg, neu, pos (shares of the tokens' weight) and compound = s / sqrt(s^2 + 15) (E2); blank texts give zeros; one
    row a row of df."""
    x = _looked_up(df.select(key, text), text, lexicon, word, score, "_l")
    p, q, u, s = (F.col(f"_l.{c}") for c in "pqus")
    total = p + q + u
    share = lambda c: F.round(F.when(total > 0, c / total).otherwise(0.0), 6)
    return x.select(key, share(q).alias("neg"), share(u).alias("neu"), share(p).alias("pos"), F.round(s / F.sqrt(s * s + 15), 6).alias("compound"))


# The published rules of the rule-based sentiment score.
NEGATIONS = ["aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing", "nowhere", "shant", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom", "despite"]
BOOSTERS = ["absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously", "entirely", "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "unusually", "utterly", "very"]
DAMPERS = ["almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta"]
BOOST, SHOUT, FLIP, EXCLAIM, ALPHA = 0.293, 0.733, -0.74, 0.292, 15.0


def rule_sentiment(text: str | None, words: dict[str, float]) -> tuple[float, float, float, float]:
    """neg, neu, pos, compound of one text by the published rules: boosters and dampers up to three words before, negation
    there, words in capitals among others, `but`, exclamation and question marks."""
    raw = [w.strip(".,!?;:()[]\"“”…") for w in (text or "").split()]
    raw = [w for w in raw if w]
    low = [w.lower().replace("'", "").replace("’", "") for w in raw]
    shouts = [w.isupper() and len(w) > 1 for w in raw]
    mixed = any(shouts) and not all(shouts)
    values = []
    for i, w in enumerate(low):
        v = words.get(raw[i].lower(), words.get(w, 0.0))
        if w in BOOSTERS or w in DAMPERS:
            v = 0.0
        if v:
            v += (SHOUT if v > 0 else -SHOUT) if mixed and shouts[i] else 0.0
            for back, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i >= back and low[i - back] not in words:
                    b = low[i - back]
                    size = BOOST if b in BOOSTERS else -BOOST if b in DAMPERS else 0.0
                    size += SHOUT * (1 if size > 0 else -1) if size and mixed and shouts[i - back] else 0.0
                    v += (size if v > 0 else -size) * damp
            if any(low[i - back] in NEGATIONS for back in (1, 2, 3) if i >= back):
                v *= FLIP
        values.append(v)
    if "but" in low:
        at = low.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(values)]
    if not values:
        return 0.0, 0.0, 0.0, 0.0
    marks = min((text or "").count("!"), 4) * EXCLAIM
    asks = (text or "").count("?")
    marks += 0.0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96
    s = sum(values)
    s += marks if s > 0 else -marks if s < 0 else 0.0
    pos, neg, neu = sum(v + 1 for v in values if v > 0), -sum(v - 1 for v in values if v < 0), sum(1 for v in values if v == 0)
    pos, neg = (pos + marks, neg) if pos > neg else (pos, neg + marks) if neg > pos else (pos, neg)
    total = pos + neg + neu
    return neg / total, neu / total, pos / total, max(-1.0, min(1.0, s / (s * s + ALPHA) ** 0.5))


def sentiment_rules(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str, score: str) -> DataFrame:
    """neg, neu, pos and compound by the published rules over a lexicon (E2); null and blank texts give zeros; one row a
    row of df.  A lexicon of more than SMALL_LEXICON words is refused."""
    small = _lexicon(lexicon, word, score)
    if small is None:
        raise ValueError(f"the lexicon has more than {SMALL_LEXICON} words")
    shared = df.sparkSession.sparkContext.broadcast({w: s / n for w, (s, n) in small.items()})  # its size is checked

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[round(x, 6) for x in rule_sentiment(t, shared.value)] for t in texts], columns=["neg", "neu", "pos", "compound"])

    return df.select(key, F.pandas_udf(run, "neg double, neu double, pos double, compound double")(F.col(text)).alias("_r")).select(key, "_r.*")


def score_texts(text: Column, make: Callable[[], Callable[[list[str]], list[float]]], batch: int = 32) -> Column:
    """A model's scores, made once a worker and called on batches (E6, E7); blank and null texts have 0."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            out = np.zeros(len(s))
            keep = [i for i, t in enumerate(s) if t is not None and t.strip()]
            for a in range(0, len(keep), batch):
                at = keep[a : a + batch]
                out[at] = model([s.iloc[i] for i in at])
            yield pd.Series(out)

    return F.pandas_udf(run, T.DoubleType())(text)


def kept_sentences(text: Column, shortest: int = 6) -> Column:
    """Trimmed sentences of at least `shortest` characters."""
    return F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: F.length(s) >= shortest)


def _summary(scores: Column) -> list[Column]:
    """mean, median and largest of an array, 0 where it is empty."""
    n, total = F.size(scores), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    s = F.array_sort(scores)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return [zero(total / n).alias("mean"), zero(middle).alias("median"), zero(F.array_max(scores)).alias("largest")]


def sentence_scores(df: DataFrame, key: str, text: str, scorer: Callable[[Column], Column], shortest: int = 6) -> DataFrame:
    """Scores of the sentences in order, and their mean, median and largest (E8); none give [] and 0.

    The scorer is an expression of built-in functions, applied where the text is: nothing is moved, and rows keep
    apart whatever their keys.
    """
    scores = F.coalesce(F.transform(kept_sentences(F.col(text), shortest), lambda s: scorer(s).cast("double")), F.array().cast("array<double>"))
    return df.select(key, scores.alias("scores")).select(key, "scores", *_summary(F.col("scores")))


def sentence_model_scores(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], list[float]]], batch: int = 32, shortest: int = 6) -> DataFrame:
    """The same by a model, made once a worker: the sentences of all texts of a batch are put together before they are
    cut into the model's batches (E8, E9)."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            flat = [x for t in s if t is not None for x in t]
            got = [float(v) for a in range(0, len(flat), batch) for v in model(flat[a : a + batch])]
            out, at = [], 0
            for t in s:
                n = 0 if t is None else len(t)
                out.append(got[at : at + n])
                at += n
            yield pd.Series(out)

    scores = F.pandas_udf(run, T.ArrayType(T.DoubleType()))(kept_sentences(F.col(text), shortest))
    return df.select(key, scores.alias("scores")).select(key, "scores", *_summary(F.col("scores")))


def calibrated(z0: Column, z1: Column, temperature: float) -> Column:
    """Probability of the second class at a temperature."""
    return 1.0 / (1.0 + F.exp(-(z1 - z0) / F.lit(float(temperature))))


def fit_temperature(df: DataFrame, z0: str, z1: str, label: str, low: float = 0.05, high: float = 20.0, points: int = 33, rounds: int = 5) -> float:
    """The temperature of least cross entropy (E10): the losses of all points of a grid (even in the logarithm) come from
    one aggregation; each round puts a finer grid between the neighbours of the best point."""
    d = F.col(z1) - F.col(z0)
    a, b = np.log(low), np.log(high)
    for _ in range(rounds):
        grid = np.linspace(a, b, points)
        m = [F.when(F.col(label) == 1, -d).otherwise(d) / F.lit(float(np.exp(t))) for t in grid]
        loss = df.agg(*[F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias(f"l{i}") for i, x in enumerate(m)]).first()
        if loss[0] is None:
            raise ValueError("no labelled rows")
        best = int(np.argmin(loss[:]))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return float(np.exp((a + b) / 2))


def subjectivity_model(train: DataFrame, text: str, label: str, top: int = 1000, smoothing: float = 0.5):  # noqa: ANN201
    """Bernoulli naive Bayes over the presence of the commonest words (E3; of equally common ones the first by the
    alphabet), as a fitted pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer

    train = train.na.drop(subset=[text, label])
    words = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}']+", toLowercase=True)
    counts = words.transform(train).select(F.explode("_tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    vocabulary = [r["w"] for r in counts.orderBy(F.col("n").desc(), "w").limit(top).collect()]  # at most `top`
    present = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="_tokens", outputCol="_features").setBinary(True)
    bayes = NaiveBayes(featuresCol="_features", labelCol=label, modelType="bernoulli", smoothing=smoothing)
    return PipelineModel([words, present, bayes.fit(present.transform(words.transform(train)))])


def subjectivity(model, texts: DataFrame) -> DataFrame:  # noqa: ANN001
    """texts with subjectivity_label (`subjective` for label 1) and subjectivity_prob, the label's probability."""
    from pyspark.ml.functions import vector_to_array

    x = model.transform(texts)
    p = F.array_max(vector_to_array("probability"))
    return x.select(*texts.columns, F.when(F.col("prediction") == 1, "subjective").otherwise("objective").alias("subjectivity_label"), p.alias("subjectivity_prob"))


def noise(df: DataFrame, key: str, text: str, level: float = 0.1, seed: int = 42) -> DataFrame:
    """int(n x level) random words of 3 to 8 letters put between the words, told by a hash of key, seed and number (D22);
    null stays null."""
    df = df.withColumn("_w", F.filter(F.split(F.col(text), WS), lambda x: x != "")).withColumn("_size", F.size("_w"))
    w, n, k = F.col("_w"), F.col("_size"), F.floor(F.col("_size") * F.lit(level)).cast("int")

    def extra(i: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), i.cast("string")))
        at = F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), (n + 1).cast("bigint"))
        letters = F.pmod(F.conv(F.substring(h, 13, 4), 16, 10).cast("bigint"), F.lit(6)) + 3
        return F.struct((at + F.lit(0.5)).cast("double").alias("pos"), F.translate(F.substring(h, F.lit(17), letters.cast("int")), "0123456789abcdef", "abcdefghijklmnop").alias("w"))

    added = F.transform(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), extra)
    own = F.transform(w, lambda x, i: F.struct((i + 1).cast("double").alias("pos"), x.alias("w")))
    out = df.withColumn("_both", F.array_sort(F.concat(own, added)))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(F.transform("_both", lambda s: s["w"]), " "))).drop("_w", "_size", "_both")
