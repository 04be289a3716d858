"""Regular-expression match spans, overlap merging and masking, all in Spark
expressions. Offsets are 0-based character positions, end exclusive.

A fold over an array copies what it has gathered at every step. Arrays of many
elements are therefore folded in blocks, and then the few blocks, so that the
work of a text grows with its matches and not with their square."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.text import is_ascii, let

MATCH_TYPE = "array<struct<start:int,ord:int,end:int,kind:string>>"
SPAN_TYPE = "array<struct<start:int,end:int,kind:string>>"
#: Elements that are folded at once.
BLOCK = 64


def in_blocks(values: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` every block of an array that is not empty."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))
    return F.transform(starts, lambda at: of(F.slice(values, at, F.lit(BLOCK))))


def running_sums(values: Column) -> Column:
    """Sums of an array of whole numbers up to each element, itself included."""

    def sums(some: Column, start: Column) -> Column:
        grown = F.aggregate(
            some, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        )
        return F.slice(grown, F.lit(2), F.size(some))

    def blocks(cut: Column, level: int) -> Column:
        totals = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
        starts = F.concat(F.array(F.lit(0)), of(totals, level - 1))
        return let(starts, lambda at: F.flatten(F.transform(cut, lambda b, i: sums(b, F.get(at, i)))))

    def of(array: Column, level: int) -> Column:
        if level == 0:
            return sums(array, F.lit(0))
        cut = lambda all_: let(in_blocks(all_, lambda b: b), lambda c: blocks(c, level))
        return let(array, lambda all_: F.when(F.size(all_) <= BLOCK, sums(all_, F.lit(0))).otherwise(cut(all_)))

    return of(values, 2)


def match_spans(
    text: Column,
    pattern: str,
    ord: int,
    kind: str | Callable[[Column], Column],
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """Span of every non-overlapping match.

    ``regexp_extract_all`` gives the matches and ``split`` the gaps between
    them, so running lengths of the two give the positions. ``kind`` may be
    derived from the matched text; ``keep`` drops matches after the fact.
    """
    kind_of = kind if callable(kind) else (lambda _m: F.lit(kind))

    def spans(matches: Column) -> Column:
        # the last gap has no match after it
        pairs = F.slice(F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("g")), F.lit(1), F.size(matches))

        def placed(pair: Column, end: Column) -> Column:
            return F.struct(
                (end - F.length(pair["m"])).alias("start"),
                F.lit(ord).alias("ord"),
                end.alias("end"),
                kind_of(pair["m"]).alias("kind"),
            )

        def found(both: Column) -> Column:
            ends = running_sums(F.transform(both, lambda p: F.length(p["g"]) + F.length(p["m"])))
            zipped = F.arrays_zip(both.alias("p"), ends.alias("e"))
            if keep is not None:
                zipped = F.filter(zipped, lambda z: keep(z["p"]["m"]))
            return F.transform(zipped, lambda z: placed(z["p"], z["e"]))

        return F.when(F.size(matches) > 0, let(pairs, found))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(let(found, spans), F.array().cast(MATCH_TYPE))


def _span(start: Column, end: Column, kind: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))


def _merged(ordered: Column) -> Column:
    """Overlaps merged in an array in order, one step for each element."""

    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        widened = _span(last["start"], F.greatest(last["end"], m["end"]), last["kind"])
        return F.when(
            (F.size(acc) > 0) & (m["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(widened)),
        ).otherwise(F.concat(acc, F.array(_span(m["start"], m["end"], m["kind"]))))

    return F.aggregate(ordered, F.array().cast(SPAN_TYPE), step)


def _merged_blocks(blocks: Column) -> Column:
    """Blocks that are merged in themselves, put together: the last span so far
    takes in what overlaps it, and everything before it is done."""

    def step(acc: Column, block: Column) -> Column:
        last = acc["last"]
        inside = F.array_max(F.transform(F.filter(block, lambda s: s["start"] < last["end"]), lambda s: s["end"]))
        wide = _span(last["start"], F.greatest(last["end"], inside), last["kind"])
        rest = F.filter(block, lambda s: s["start"] >= last["end"])

        def grown(left: Column) -> Column:
            more = F.struct(
                F.element_at(left, -1).alias("last"),
                F.concat(F.array(wide), F.slice(left, F.lit(1), F.size(left) - 1)).alias("done"),
            )
            none = F.struct(wide.alias("last"), F.array().cast(SPAN_TYPE).alias("done"))
            return F.when(F.size(left) > 0, more).otherwise(none)

        # a value that is bound is copied: what is done so far has to stay outside
        new = let(rest, grown)
        return F.struct(new["last"].alias("last"), F.concat(acc["done"], F.array(new["done"])).alias("done"))

    first = F.element_at(blocks, 1)
    start = F.struct(
        F.element_at(first, -1).alias("last"), F.array(F.slice(first, F.lit(1), F.size(first) - 1)).alias("done")
    )
    return F.aggregate(
        F.slice(blocks, F.lit(2), F.size(blocks) - 1),
        start,
        step,
        lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["last"])),
    )


def _merged_levels(ordered: Column) -> Column:
    """Blocks, blocks of blocks, and those together."""
    return let(in_blocks(ordered, _merged), lambda b: let(in_blocks(b, _merged_blocks), _merged_blocks))


def merge_spans(matches: Column) -> Column:
    """Sort by start (detector order breaks ties) and merge overlaps. The
    earlier span keeps its kind; touching spans stay apart."""
    return let(
        F.array_sort(matches),
        lambda m: F.when(F.size(m) <= BLOCK, _merged(m)).otherwise(_merged_levels(m)),
    )


def mask_spans(text: Column, spans: Column, masks: Mapping[str, str]) -> Column:
    """Replace every merged span by the mask of its kind. Characters are counted
    from the start of a text: one of many spans is cut as bytes if all are ASCII,
    and otherwise first into stretches of about as many spans as there are stretches."""
    mask_of = F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])

    def masked(source: Column, base: Column, some: Column) -> Column:
        """``source``, the text from ``base`` to the end of the last of ``some``."""

        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, base).otherwise(F.get(some, i - 1)["end"])
            gap = F.substring(source, before - base + 1, span["start"] - before).cast("string")
            return F.concat(gap, mask_of[span["kind"]])

        return F.array_join(F.transform(some, piece), "")

    def stretch(at: Column, step: Column) -> Column:
        some = F.slice(spans, at, step)
        base = F.when(at == 1, F.lit(0)).otherwise(F.get(spans, at - 2)["end"])
        cut = F.substring(text, base + 1, F.element_at(some, -1)["end"] - base)
        bound = F.struct(cut.alias("text"), base.alias("base"), some.alias("some"))
        return let(bound, lambda s: masked(s["text"], s["base"], s["some"]))

    def stretches(step: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(spans), step)
        return F.array_join(F.transform(starts, lambda at: stretch(at, step)), "")

    few = F.size(spans) <= BLOCK
    raw = let(text.cast("binary"), lambda b: masked(b, F.lit(0), spans))
    front = (
        F.when(few, masked(text, F.lit(0), spans))
        .when(is_ascii(text), raw)
        .otherwise(let(F.ceil(F.sqrt(F.size(spans))).cast("int"), stretches))
    )
    tail = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(front, tail)).otherwise(text)


def byte_offset(text: Column, offset: Column) -> Column:
    """Character offset to UTF-8 byte offset."""
    return F.octet_length(F.substring(text, F.lit(1), offset))
