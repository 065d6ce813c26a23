"""Amounts recorded in different units made comparable.

A unit expression (`USD`, `thousands of US dollars`, `kEUR`, `GBP pence`, `in 1,000 SEK`) is parsed by a
small grammar:  expression := factor { ("*" | "per" | <space>) factor };  factor := scale | currency |
minor-currency.  Every atom is a unit: exponents over base dimensions, a factor and an offset.  An
expression is an amount of money if its exponents are exactly one of one currency and nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of currencies, of their hundredths, and of scales.
CURRENCIES = {
    "USD": ["usd", "usd$", "us$", "u.s.$", "us dollar", "us dollars", "u.s. dollar", "u.s. dollars", "dollar us", "dollars us", "dollar (us)", "dollars (us)", "american dollar", "american dollars"],
    "EUR": ["eur", "eur.", "euro", "euros", "€", "eur €", "euro €"],
    "GBP": ["gbp", "£", "gbp£", "gbp £", "pound sterling", "pounds sterling", "british pound", "british pounds", "uk pound", "uk pounds"],
    "CAD": ["cad", "c$", "ca$", "cad$", "cdn$", "canadian dollar", "canadian dollars"],
    "AUD": ["aud", "a$", "au$", "aud$", "australian dollar", "australian dollars"],
    "JPY": ["jpy", "jp¥", "¥", "円", "yen", "japanese yen"],
    "SEK": ["sek", "sek kr", "swedish krona", "swedish kronor", "svenska kronor", "svensk krona"],
    "CHF": ["chf", "sfr", "sfr.", "fr. ch", "fr. (ch)", "swiss franc", "swiss francs", "schweizer franken"],
    "MXN": ["mxn", "mx$", "mxn$", "mexican peso", "mexican pesos", "peso mexicano", "pesos mexicanos"],
}
MINOR_NAMES = {
    "USD": ["us cent", "us cents"], "EUR": ["eurocent", "eurocents", "euro cent", "euro cents"],
    "GBP": ["pence", "penny"], "CAD": ["canadian cent", "canadian cents"], "AUD": ["australian cent", "australian cents"],
    "SEK": ["öre"], "CHF": ["rappen"],
}
MINOR_MARKS = ["cent", "cents", "ct", "¢", "minor unit", "minor units", "pence", "penny", "p", "öre", "rappen", "centavo", "centavos", "x 0.01", "x0.01", "hundredth of one", "hundredths of one", "hundredths of a", "hundredths of"]
THOUSAND_MARKS = ["k", "t", "'000", "x1000", "x 1000", "x 1,000", "in 1,000", "in 1000", "thousand", "thousands", "thousand of", "thousands of", "tsd.", "tsd"]
MILLION_MARKS = ["m", "mn", "mio", "mio.", "million", "millions", "millions of", "x1000000", "in 1,000,000"]
CASED = {"GBp": ("GBP", 0.01), "GBX": ("GBP", 0.01)}  # here the case of a letter tells the scale
NO_VALUE_TEXT = ["", "n/a", "na", "none", "null", "nan", "-", "unknown", "tbd", "?"]


@dataclass(frozen=True)
class Unit:
    """Exponents over base dimensions; canonical = value * factor + offset."""

    dims: tuple[tuple[str, int], ...] = ()
    factor: float = 1.0
    offset: float = 0.0

    def times(self, other: "Unit", power: int = 1) -> "Unit":
        total: dict[str, int] = dict(self.dims)
        for d, e in other.dims:
            total[d] = total.get(d, 0) + power * e
        return Unit(tuple(sorted((d, e) for d, e in total.items() if e)), self.factor * other.factor**power, self.offset + power * other.offset)

    def money(self) -> str | None:
        """The currency, if this is an amount of one currency."""
        return self.dims[0][0] if len(self.dims) == 1 and self.dims[0][1] == 1 else None


@dataclass
class Lexicon:
    atoms: dict[str, Unit] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for code, names in CURRENCIES.items():
            for n in names:
                self.atoms[n] = Unit(((code, 1),))
        for code, names in MINOR_NAMES.items():
            for n in names:
                self.atoms[n] = Unit(((code, 1),), 0.01)
        for marks, factor in ((MINOR_MARKS, 0.01), (THOUSAND_MARKS, 1e3), (MILLION_MARKS, 1e6)):
            for n in marks:
                self.atoms.setdefault(n, Unit((), factor))
        self.longest = sorted(self.atoms, key=len, reverse=True)


_LEX = Lexicon()
_GLUE = re.compile(r"(?:\s+|[()\[\]*]|\bin\b|\bof\b)+")


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> tuple[str, float] | None:
    """(currency, factor) of a unit expression, or None if it isn't an amount of money."""
    u = money_unit(text)
    return (u.money(), u.factor) if u else None


@lru_cache(maxsize=65536)
def money_unit(text: str | None) -> Unit | None:
    """The unit of a unit expression, or None if it isn't an amount of money.

    Every character must be used.  A minor mark beside its own currency's minor name counts once.
    """
    if text is None:
        return None
    bare = text.replace(" ", " ").strip()
    if bare in CASED:
        return Unit(((CASED[bare][0], 1),), CASED[bare][1])
    s, unit, power, scaled, minor = bare.lower(), Unit(), 1, 0, False
    s = s.replace("’", "'")
    while s:
        if m := _GLUE.match(s):
            if s.startswith("in 1"):
                m = None
            else:
                s = s[m.end() :]
                continue
        if m := re.match(r"per\b|/", s):
            power, s = -1, s[m.end() :]
            continue
        hit = _next_atom(s)
        if hit is None:
            return None
        atom = _LEX.atoms[hit]
        s = s[len(hit) :]
        if atom.dims and unit.dims == atom.dims and power == 1:  # `GBP pence`, `USD US$`: said twice
            unit = Unit(unit.dims, min(unit.factor, atom.factor) if 0.01 in (unit.factor, atom.factor) else unit.factor)
            minor |= atom.factor == 0.01
            continue
        if not atom.dims:
            if minor and atom.factor == 0.01:
                continue
            scaled += 1
        minor |= atom.factor == 0.01
        unit, power = unit.times(atom, power), 1
    return unit if unit.money() and scaled <= 1 else None


def _next_atom(s: str) -> str | None:
    for a in _LEX.longest:
        if not s.startswith(a):
            continue
        rest = s[len(a) :]
        if a[-1].isalpha() and rest[:1].isalpha():
            # `kusd`, `teur`, `mio`: a one-letter scale may touch the code that it scales
            if len(a) == 1 and a in "ktm" and rest[:3].upper() in CURRENCIES and not rest[3:4].isalpha():
                return a
            continue
        return a
    return None


def _phrase() -> str:
    """A regular expression of unit expressions in running text (longest first)."""
    esc = lambda names: "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    words = [n for code in CURRENCIES for n in CURRENCIES[code] if " " in n or n in ("euro", "euros", "yen")]
    codes = [c.lower() for c in CURRENCIES]
    minors = [n for v in MINOR_NAMES.values() for n in v if n not in ("pence", "penny")]
    pre = r"(?:(?:hundredths?|thousands?|millions?) of (?:one |a |an )?|(?:thousand|million|mio\.) )?"
    post = r"(?: (?:thousands?|millions?|minor units?|cents?|pence|öre|rappen|centavos?))?"
    return rf"(?i)(?<![\p{{L}}\p{{N}}.,$€£¥])(?<!\d )({pre}(?:{esc(minors + words)}|{esc(codes)}){post})(?![\p{{L}}\p{{N}}])"


UNIT_PHRASE = _phrase()
# Fixed value: words that come before a unit that is stated for the numbers of the whole record.
STATED = r"(?i)(?:\b(?:in|as|counted|given|shown|sums are|amounts?:|figures:|currency:|totals:) ?|[\[*(] ?)$"


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType())]))
def _parse_units(s: pd.Series) -> pd.DataFrame:
    got = [money_unit(x) for x in s]
    return pd.DataFrame({"code": [g.money() if g else None for g in got], "factor": [g.factor if g else None for g in got], "offset": [g.offset if g else None for g in got]})


def canonical(value: Column, factor: Column, offset: Column) -> Column:
    """A value in the canonical unit of its dimension: scale, then offset."""
    return value * factor + offset


def stated_units(text: Column) -> Column:
    """The different unit expressions of a text that have no number before them."""
    clean = F.regexp_replace(text, r"[\s ]+", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(UNIT_PHRASE), F.lit(1)), lambda p: F.lower(p)))


def missing_value(col: Column, zero_is_real: bool) -> Column:
    """Null, NaN, negative, all nines (nine or more of them), or zero where zero isn't real."""
    x = col.cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | ((x >= 999999999) & F.format_string("%.0f", x).rlike(r"^9{9,}$"))
    return F.coalesce(bad if zero_is_real else bad | (x == 0), F.lit(True))


def amounts_in_common_unit(
    df: DataFrame,
    units: DataFrame,
    rates: DataFrame,
    fields: tuple[str, ...] = ("goal", "pledged"),
    text_fields: tuple[str, ...] = ("name", "blurb", "story_content"),
    key: str = "row_id",
) -> DataFrame:
    """key, field_name, value, currency_code, scale_factor, unit_id, told_by, usd for each present value.

    The unit is told by the currency field, else (where that is missing) by a unit stated in the text
    without a number before it, if the text states just one; and for an exact ISO code by the share of
    the goal: pledged/goal a power of ten off it means that one of the two is in another scale.
    told_by: `plain` (major units of the exact ISO code), `currency`, `text`, `share`, or `nothing`
    (unit_id and usd null).  `units` and `rates` are fixed tables (35 and 972 rows).  Rows repeat as
    they do in `df`; missing values (see `missing_value`) give no row.
    """
    cur = F.regexp_replace(F.col("currency"), r"^[\s ]+|[\s ]+$", "")
    blank = F.coalesce(F.lower(cur).isin(*NO_VALUE_TEXT), F.lit(True))
    exact = F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False))
    share = F.coalesce(F.nanvl(F.col("percent_funded"), F.lit(None)), F.nanvl(F.col("funds_raised_percent"), F.lit(None)))
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(stated_units(F.col(c)), F.array().cast("array<string>")) for c in text_fields])))
    x = df.select(
        key,
        *[F.when(~missing_value(F.col(f), f != "goal"), F.col(f).cast("double")).alias(f) for f in fields],
        share.alias("_share"),
        exact.alias("_exact"),
        F.col("currency").alias("_cur"),
        F.date_format("crawled_at", "yyyy-MM").alias("_month"),
        F.when(blank, found).alias("_found"),
        blank.alias("_blank"),
    )
    # One expression goes to the grammar: the currency field's, or the text's if there is just one.
    said = F.when(F.col("_exact"), None).when(~F.col("_blank"), F.col("_cur")).when(F.size("_found") == 1, F.col("_found")[0])
    x = x.withColumn("_u", _parse_units(said))
    goal, pledged = F.col("goal"), F.col("pledged")
    off = F.when(F.col("_exact") & (goal > 0) & (pledged > 0) & (F.col("_share") > 0), F.log10(pledged / goal * 100 / F.col("_share")))
    near = lambda k: F.coalesce(F.abs(off - k) < 0.25, F.lit(False))
    scale = {
        "goal": F.when(near(-2), 0.01).when(near(3), 1e3).when(near(6), 1e6),
        "pledged": F.when(near(2), 0.01).when(near(-3), 1e3).when(near(-6), 1e6),
    }
    parts = [
        F.struct(
            F.lit(f).alias("field_name"),
            F.col(f).alias("value"),
            F.when(F.col("_exact"), F.coalesce(scale[f], F.lit(1.0)) if f in scale else F.lit(1.0)).otherwise(F.col("_u.factor")).alias("scale_factor"),
            F.when(F.col("_exact"), F.lit(0.0)).otherwise(F.col("_u.offset")).alias("_offset"),
            F.when(F.col("_exact"), F.when(scale[f].isNotNull(), "share").otherwise("plain") if f in scale else F.lit("plain"))
            .when(F.col("_u.code").isNull(), "nothing")
            .when(F.col("_blank"), "text")
            .otherwise("currency")
            .alias("told_by"),
        )
        for f in fields
    ]
    code = F.when(F.col("_exact"), F.col("_cur")).otherwise(F.col("_u.code"))
    x = x.select(key, "_month", code.alias("currency_code"), F.explode(F.array(*parts)).alias("v")).select(key, "_month", "currency_code", "v.*").filter("value is not null")
    u = units.select(F.col("currency_code").alias("_uc"), F.col("major_per_unit").alias("_uf"), "unit_id")
    x = x.join(F.broadcast(u), (F.col("currency_code") == F.col("_uc")) & (F.abs(F.col("scale_factor") / F.col("_uf") - 1) < 1e-6), "left")
    r = rates.select(F.col("currency_code").alias("_rc"), F.col("fx_month").alias("_rm"), "usd_per_major")
    x = x.join(F.broadcast(r), (F.col("currency_code") == F.col("_rc")) & (F.col("_month") == F.col("_rm")), "left")
    return x.select(
        key, "field_name", "value", "currency_code", "scale_factor", "unit_id",
        F.when(F.col("unit_id").isNull(), "nothing").otherwise(F.col("told_by")).alias("told_by"),
        (canonical(F.col("value"), F.col("scale_factor"), F.col("_offset")) * F.col("usd_per_major")).alias("usd"),
    )
