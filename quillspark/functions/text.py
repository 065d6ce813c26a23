"""Text measures as column expressions.

Regular expressions are written so that Java and RE2 read them alike: white space is Python's, word
characters are letters, digits and the underscore of any script.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
WS_CHARS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]+"
PLAIN_WS = r"[\s\x{0B}\x{1C}-\x{1F}]+"  # the same for ASCII
TOKEN = rf"[\p{{L}}\p{{N}}_]+(?:[-'’][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_{WS_CHARS}]"
WORD = r"[\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*"
ALPHA = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = rf"[.!?]+[{WS_CHARS}]+"
FORMAL = ["furthermore", "moreover", "therefore", "consequently", "additionally", "specifically", "particularly", "essentially", "ultimately", "overall", "comprehensive", "innovative", "cutting-edge", "state-of-the-art"]
PHRASES = ["i am excited to", "we are thrilled to", "cutting-edge technology", "state-of-the-art", "innovative solution", "game-changing", "revolutionary approach", "seamless experience", "user-friendly interface", "leverage the power of", "harness the potential", "transform the way", "bridge the gap", "take it to the next level", "paradigm shift"]
PATENT = r"(?i)\b(patent|patents|patent pending|patented|patenting)\b"
CHALLENGE = ["Just a moment...", "challenge-platform/h/g/orchestrate/chl_page", "cf-browser-verification", "Verify you are human by completing the action below"]
# Rules of a plain grammar check: doubled word, blank before a mark, no blank after one, small "i", doubled mark.
GRAMMAR_RULES = [r"(?i)\b(?:the the|a a|and and|of of|to to|in in|is is)\b", r" [,;:!?]", r"[,;][a-z]", r"(?:^| )i(?: |$)", r"[,;:]{2,}|!{2,}|\?{2,}"]


def holds_text(text: Column) -> Column:
    """Whether there is anything but white space: the search ends at the first such character."""
    return text.rlike(f"[^{WS_CHARS}]")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """White-space tokens (D1); null text gives null.  Most texts are ASCII, where few characters are white space."""
    plain = F.octet_length(text) == F.length(text)
    return F.filter(F.when(plain, F.split(text, PLAIN_WS)).otherwise(F.split(text, WS)), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of white-space tokens; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between ends of sentences that aren't blank."""
    return F.filter(F.split(text, SENTENCE_BREAK), holds_text)


def tokens(text: Column) -> Column:
    """Words (hyphens and apostrophes kept) and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def alpha_tokens(text: Column) -> Column:
    """Lower-case words of the letters a to z only."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(ALPHA), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def simple_quality(text: Column) -> Column:
    """Word length times sentence length, each scaled, in 0..1; blank and null give 0."""
    stops = F.greatest(F.size(F.filter(F.split(text, r"\."), holds_text)), F.lit(1))

    def score(w: Column) -> Column:
        n = F.size(w).cast("double")
        chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(F.btrim(x, F.lit(".,!?"))))
        return F.when(F.coalesce(F.size(w), F.lit(0)) > 0, F.least(F.lit(1.0), chars / n / 10.0 * (F.least(n / stops, F.lit(20.0)) / 20.0))).otherwise(0.0)

    return once(words(text), score)


def issue_count(text: Column, rules: list[str] = GRAMMAR_RULES) -> Column:
    """Matches of all grammar rules."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(r)) for r in rules])


def grammar_quality(text: Column, issues: Column | None = None) -> Column:
    """1 - issues per token (D3); null without tokens.  `issues` may be another checker's count."""
    n = F.size(words(text))
    return F.when(n > 0, 1.0 - (issue_count(text) if issues is None else issues) / n)


def text_quality(text: Column, issues: Column | None = None, use_simple: bool = False) -> Column:
    """Grammar quality where a checker's count of issues is at hand, else (or if asked) the simple quality."""
    return simple_quality(text) if use_simple or issues is None else grammar_quality(text, issues)


def vowel_groups(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[aeiouy]+")), F.lit(1))


def readability(w: Column, n_sentences: Column) -> dict[str, Column]:
    """Flesch ease, Flesch-Kincaid grade, Gunning fog and ARI over words, sentences and vowel groups."""
    n, s = F.size(w).cast("double"), F.greatest(n_sentences, F.lit(1)).cast("double")
    groups = F.transform(w, vowel_groups)
    syl = F.aggregate(groups, F.lit(0), lambda a, x: a + x).cast("double")
    hard = F.size(F.filter(groups, lambda x: x >= 3)).cast("double")
    chars = F.length(F.array_join(w, "")).cast("double")
    ok = lambda c: F.when(n > 0, c).otherwise(0.0)
    return {
        "flesch_reading_ease": ok(206.835 - 1.015 * (n / s) - 84.6 * (syl / n)),
        "flesch_kincaid_grade": ok(0.39 * (n / s) + 11.8 * (syl / n) - 15.59),
        "gunning_fog": ok(0.4 * (n / s + 100.0 * (hard / n))),
        "automated_readability_index": ok(4.71 * (chars / n) + 0.5 * (n / s) - 21.43),
    }


def count_of(text: Column, mark: str) -> Column:
    """Share of a single character."""
    return F.when(F.length(text) > 0, (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.length(text)).otherwise(0.0)


def _like_pairs(texts: pd.Series) -> pd.Series:
    import regex

    ws = "".join(chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
    token = regex.compile(rf"[\p{{L}}\p{{N}}_]+(?:[-'’][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_{ws}]")
    stop = regex.compile(rf"[.!?]+[{ws}]+")

    def one(t: str | None) -> float | None:
        if t is None:
            return None
        n, counts = 0, {}
        for s in stop.split(t):
            if s.strip(ws):
                n += 1
                k = frozenset(token.findall(s.lower()))
                counts[k] = counts.get(k, 0) + 1
        if n < 2:
            return 0.0
        pairs = sum(c * (c - 1) // 2 for k, c in counts.items() if k)
        # a pair that shares over half has a word in common among the rarer half of the smaller set: only pairs
        # that meet there are compared, by rising size
        rare: dict[str, int] = {}
        for k in counts:
            for w in k:
                rare[w] = rare.get(w, 0) + 1
        holds: dict[str, list[int]] = {}
        sets = sorted((k for k in counts if k), key=len, reverse=True)
        for i, a in enumerate(sets):  # larger ones first, so those that are met are at least as large
            some = sorted(a, key=lambda w: (rare[w], w))[: (len(a) + 1) // 2]
            for j in {j for w in some for j in holds.get(w, ())}:
                both = len(a & sets[j])
                if both * 3 > len(a) + len(sets[j]):
                    pairs += counts[a] * counts[sets[j]]
            for w in a:
                holds.setdefault(w, []).append(i)
        return pairs / n

    seen: dict[str | None, float | None] = {}  # repeated crawls bring the same text; within a batch it is read once
    for t in texts:
        if t not in seen:
            seen[t] = one(t)
    return pd.Series([seen[t] for t in texts], dtype="float64")


def repetition(text: Column) -> Column:
    """Pairs of sentences that share over half of their words, by sentence (D11); below two sentences 0.

    Equal sets are counted by their number; of the different ones only pairs that share a word of the rarer half are
    compared.  Pairs are counted where the text is and never written out.
    """
    return F.pandas_udf(_like_pairs, T.DoubleType())(text)


def text_arrays(df: DataFrame, text: Column) -> DataFrame:
    """Adds the arrays that the features share, each made once: _tok, _low, _sents, _words."""
    return df.withColumns({
        "_tok": tokens(text), "_low": tokens(F.lower(text)), "_sents": sentences(text), "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_rep": repetition(text),
    })


def linguistic_features(text: Column, stop_words: list[str]) -> dict[str, Column]:
    """The seventeen features of D5-D13 over a table with `text_arrays`; null and blank texts give zeros."""
    blank = F.coalesce(~holds_text(text), F.lit(True))
    n, s, c, total = F.size("_tok"), F.size("_sents"), F.length(text), F.size("_low")
    share = lambda names: F.when(total > 0, F.size(F.filter("_low", lambda w: w.isin(*names))) / total).otherwise(0.0)
    out = {
        "word_count": n, "sentence_count": s, "char_count": c,
        "avg_sentence_length": F.when(s > 0, n / s).otherwise(0.0), "avg_word_length": F.when(n > 0, c / n).otherwise(0.0),
        **readability(F.col("_words"), s),
        "lexical_diversity": F.when(total > 0, F.size(F.array_distinct("_low")) / total).otherwise(0.0),
        "stop_word_ratio": share(stop_words),
        "exclamation_ratio": count_of(text, "!"), "question_ratio": count_of(text, "?"), "comma_ratio": count_of(text, ","),
        "repetition_score": F.col("_rep"),
        "formality_score": share(FORMAL),
        "ai_phrases_count": phrase_count(text),
    }
    return {k: F.when(blank, 0 if k in ("word_count", "sentence_count", "char_count", "ai_phrases_count") else 0.0).otherwise(v) for k, v in out.items()}


def phrase_count(text: Column, phrases: list[str] = PHRASES) -> Column:
    """How many different phrases occur, whatever their case."""
    return once(F.lower(text), lambda low: reduce(lambda a, b: a + b, [F.coalesce(low.contains(p), F.lit(False)).cast("int") for p in phrases]))


def ai_score(f: dict[str, Column]) -> Column:
    """The additive score over columns of `linguistic_features`, in 0..1 (D14); a blank text has 0.1."""
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        add(f["flesch_reading_ease"].between(30, 70), 0.1) + add(f["lexical_diversity"].between(0.3, 0.7), 0.1)
        + add(f["avg_sentence_length"].between(15, 25), 0.1) + add(f["formality_score"] > 0.02, 0.2) + add(f["ai_phrases_count"] > 0, 0.3)
        + add(f["repetition_score"] < 0.1, 0.1) + add((f["exclamation_ratio"] + f["question_ratio"]).between(0.01, 0.05), 0.1)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def score_bucket(score: Column) -> Column:
    """high (> 0.7), medium (0.4..0.7), low."""
    return F.when(score > 0.7, "high").when(score >= 0.4, "medium").when(score < 0.4, "low")


def stars(p: Column) -> Column:
    """*** below .001, ** below .01, * below .05, . below .1."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def has_patent_terms(text: Column) -> Column:
    """C6; null is false."""
    return F.coalesce(text.rlike(PATENT), F.lit(False))


def challenge_present(html: Column, indicators: list[str] = CHALLENGE, at_least: int = 2) -> Column:
    """Whether at least two indicators occur (C10); null and empty are false."""
    return reduce(lambda a, b: a + b, [F.coalesce(html.contains(i), F.lit(False)).cast("int") for i in indicators]) >= at_least


def slug(url: Column, marker: str = "/projects/") -> Column:
    """What follows the marker, without query and fragment; '' where it is missing."""
    bare = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.coalesce(F.when(bare.contains(marker), F.btrim(F.split_part(bare, F.lit(marker), F.lit(2)), F.lit("/"))).otherwise(""), F.lit(""))


def strip_zone(text: Column) -> Column:
    """A numeric zone at the end is cut off, the wall clock stays."""
    return F.regexp_replace(text, r"[+-]\d{2}:\d{2}$", "")


def clean_nbsp(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit(" "), F.lit(" ")))


def normalise_lines(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, joined by a blank line."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n\n")


def first_text(*cols: Column) -> Column:
    """The first text that isn't null or empty, else '' (D24)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def clean_body(html: Column) -> Column:
    """Images and frames become marks, tags line ends, entities characters (O3)."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    x = F.regexp_replace(x, r"(?i)<img\b[^>]*>", " [IMAGE] ")
    x = F.regexp_replace(x, r"(?is)<iframe\b[^>]*>(.*?</iframe>)?", " [EMBED] ")
    x = F.regexp_replace(x, r"<[^>]+>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(lines, "\n")


def story_text(html: Column, css_class: str = "story-content") -> Column:
    """The text of the story's div, lines normalised (O2); null where there is none.  Divs inside the story are
    kept up to the outermost end that the expression finds."""
    inner = F.regexp_extract(html, rf"(?is)<div[^>]*class=\"[^\"]*\b{css_class}\b[^\"]*\"[^>]*>(.*)</div>", 1)
    bare = F.regexp_replace(inner, r"(?is)<(script|style|iframe)\b.*?</(script|style|iframe)>", "")
    return F.when(inner != "", normalise_lines(F.regexp_replace(bare, r"<[^>]+>", "\n")))
