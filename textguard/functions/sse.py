"""Server-sent-event chunks of streamed chat responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# the 25 characters with the Unicode White_Space property
WHITE_SPACE = "".join(
    chr(c)
    for lo, hi in (
        (0x09, 0x0D),
        (0x20, 0x20),
        (0x85, 0x85),
        (0xA0, 0xA0),
        (0x1680, 0x1680),
        (0x2000, 0x200A),
        (0x2028, 0x2029),
        (0x202F, 0x202F),
        (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for c in range(lo, hi + 1)
)


def trim_unicode(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def json_string(variant: Column, path: str) -> Column:
    """The value at ``path`` if it is a JSON string, else null."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, path, "string")
    )


def delta_of_line(line: Column) -> Column:
    """Content delta of one ``data:`` line, null for every other line."""
    payload = trim_unicode(F.substring(trim_unicode(line), 6, 1 << 30))
    relevant = (
        F.startswith(trim_unicode(line), F.lit("data:")) & (payload != "") & (payload != "[DONE]")
    )
    return F.when(
        relevant, json_string(F.try_parse_json(payload), "$.choices[0].delta.content")
    )


def deltas(chunk: Column) -> Column:
    """Content deltas of a chunk in order; a chunk may hold several lines."""
    lines = F.filter(F.split(chunk, "\n", -1), lambda l: F.contains(l, F.lit("data:")))
    return F.filter(F.transform(lines, delta_of_line), lambda d: d.isNotNull())
