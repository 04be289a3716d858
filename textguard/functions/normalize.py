"""Anti-obfuscation normalization of text before phrase matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.text import evaluate, is_ascii, let, listed_class, range_class
from textguard.rules import INVISIBLE_RANGES

# Characters for which NFKC is provably the identity, alone or next to each
# other (the tests check this for every code point and every composing pair).
# Text made of these only never leaves the JVM.
NFKC_STABLE_RANGES: tuple[tuple[int, int], ...] = (
    (0x0000, 0x007F),  # ASCII
    (0x00A1, 0x00A7),  # Latin-1 punctuation and letters
    (0x00A9, 0x00A9),
    (0x00AB, 0x00AE),
    (0x00B0, 0x00B1),
    (0x00B6, 0x00B7),
    (0x00BB, 0x00BB),
    (0x00BF, 0x00FF),
    (0x0100, 0x0131),  # Latin Extended-A without ligatures and apostrophes
    (0x0134, 0x013E),
    (0x0141, 0x0148),
    (0x014A, 0x017E),
    (0x0400, 0x045F),  # Cyrillic
    (0x2012, 0x2015),  # dashes, quotes, bullet
    (0x2018, 0x2022),
    (0x3041, 0x3096),  # kana
    (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF),  # unified ideographs
)
_LATIN1_STABLE = [r for r in NFKC_STABLE_RANGES if r[1] <= 0xFF]
_INVISIBLE_LATIN1 = [r for r in INVISIBLE_RANGES if r[1] <= 0xFF]
_INVISIBLE_WIDE = [r for r in INVISIBLE_RANGES if r[1] > 0xFF]

INVISIBLE = f"[{range_class(INVISIBLE_RANGES)}]"
HAS_INVISIBLE_LATIN1 = f"[{listed_class(_INVISIBLE_LATIN1)}]"
HAS_INVISIBLE_WIDE = f"[{range_class(_INVISIBLE_WIDE)}]"
NOT_LATIN1_STABLE = f"[^{listed_class(_LATIN1_STABLE)}]"
NOT_STABLE = f"[^{range_class(NFKC_STABLE_RANGES)}]"
ODD_SPACE_LATIN1 = r"[\t\x0B\f\r\x85\xA0]"
# anything but plain Latin-1 text: printable, stable, spaces and line feeds only
_PLAIN = [(0x0A, 0x0A), (0x20, 0x7E), *(r for r in _LATIN1_STABLE if r[0] > 0x7F)]
_PLAIN = [(lo, hi) for lo, hi in _PLAIN if (lo, hi) != (0x00AB, 0x00AE)]
_PLAIN += [(0x00AB, 0x00AC), (0x00AE, 0x00AE)]  # without the soft hyphen
NOT_PLAIN = f"[^{listed_class(_PLAIN)}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    def fold(text: str | None) -> str | None:
        return None if text is None else unicodedata.normalize("NFKC", text)

    return lists.map(lambda texts: None if texts is None else [fold(t) for t in texts])


def strip_invisible(text: Column) -> Column:
    """Remove zero-width, bidirectional and non-printable control characters.
    Two cheap tests spare clean text the replacement."""

    def strip(t: Column) -> Column:
        dirty = t.rlike(HAS_INVISIBLE_LATIN1) | (~is_ascii(t) & t.rlike(HAS_INVISIBLE_WIDE))
        return F.when(dirty, F.regexp_replace(t, INVISIBLE, "")).otherwise(t)

    return let(text, strip)


def needs_nfkc(text: Column) -> Column:
    """False only for text that NFKC cannot change."""
    return ~is_ascii(text) & text.rlike(NOT_LATIN1_STABLE) & text.rlike(NOT_STABLE)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, and a Python function runs
    for every row whatever condition surrounds it, so rows that cannot change
    are handed over as null: no text crosses to Python for them."""
    return F.coalesce(_nfkc(F.when(needs_nfkc(text), text)), text)


def lower(text: Column) -> Column:
    """Lowercase character by character, so without the final-sigma rule."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def collapse_whitespace(text: Column) -> Column:
    """One space for every run of Unicode white space, none at the ends."""

    def collapse(t: Column) -> Column:
        runs = (
            F.contains(t, F.lit("  "))
            | t.rlike(ODD_SPACE_LATIN1)
            | (~is_ascii(t) & t.rlike(r"(?U)[\s&&[^ ]]"))
        )
        return F.when(runs, F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)

    return F.trim(let(F.replace(text, F.lit("\n"), F.lit(" ")), collapse))


def is_plain(text: Column) -> Column:
    """Text whose only normalization is case, line feeds and runs of spaces."""
    return ~text.rlike(NOT_PLAIN)


def _normalize_plain(text: Column) -> Column:
    def squeeze(t: Column) -> Column:
        doubled = F.contains(t, F.lit("  "))
        return F.when(doubled, F.regexp_replace(t, " {2,}", " ")).otherwise(t)

    return F.trim(let(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), squeeze))


def with_normalized(
    df: DataFrame, text: str = "text", output: str = "normalized", compatibility: bool = True
) -> DataFrame:
    """Strip invisible characters, NFKC, lowercase, collapse whitespace.

    One test tells plain text apart, which skips all but the last two steps.
    ``compatibility=False`` leaves NFKC out and keeps the plan free of Python;
    use it only for text that is known to be NFKC-stable.
    """
    source = F.col(text)
    special = F.when(~is_plain(source), strip_invisible(source))
    df = evaluate(df, "_special", special)
    folded = nfkc(F.col("_special")) if compatibility else F.col("_special")
    done = F.when(F.col("_special").isNull(), _normalize_plain(source)).otherwise(
        collapse_whitespace(lower(folded))
    )
    return df.withColumn(output, done).drop("_special")


def with_normalized_each(df: DataFrame, texts: str, output: str) -> DataFrame:
    """:func:`with_normalized` for every element of an array of texts, in
    place: a row with all its messages is neither exploded nor regrouped."""
    special = lambda t: F.when(~is_plain(t), strip_invisible(t))
    df = evaluate(df, "_special", F.transform(texts, special))
    dirty = F.exists("_special", lambda t: F.coalesce(needs_nfkc(t), F.lit(False)))
    folded = F.coalesce(_nfkc_each(F.when(dirty, F.col("_special"))), F.col("_special"))
    pairs = F.arrays_zip(F.col(texts).alias("t"), folded.alias("s"))

    def finish(pair: Column) -> Column:
        return F.when(pair["s"].isNull(), _normalize_plain(pair["t"])).otherwise(
            collapse_whitespace(lower(pair["s"]))
        )

    return df.withColumn(output, F.transform(pairs, finish)).drop("_special")
