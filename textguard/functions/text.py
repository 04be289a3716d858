"""Small helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column expression that is mentioned twice is evaluated twice inside a
    conditional; a lambda variable is evaluated once, however often it is read.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def evaluate(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed exactly once per row.

    The optimizer copies the definition of a plain column into every filter
    that it pushes below it, and again into the columns derived from it. It
    does neither across a generator.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def fill(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)


def range_class(ranges: Iterable[tuple[int, int]]) -> str:
    """Body of a regex character class from code point ranges."""
    return "".join(rf"\u{lo:04X}-\u{hi:04X}" for lo, hi in ranges)


def listed_class(ranges: Iterable[tuple[int, int]]) -> str:
    """The same, every character listed. Java looks listed Latin-1 characters
    up in one table, where ranges are tested one after the other."""
    return "".join(rf"\u{c:04X}" for lo, hi in ranges for c in range(lo, hi + 1))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)
