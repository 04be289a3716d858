"""Sensitive-data detection and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.spans import MATCH_TYPE, in_blocks, mask_spans, match_spans, merge_spans, running_sums
from textguard.functions.text import is_ascii, let

VERDICT_TYPE = (
    "struct<action:string,reason:string,category:string,redacted_text:string,redactions_count:int>"
)
FINDING_TYPE = "array<struct<category:string,rule_name:string,start:int,end:int,space:string>>"


def luhn_check(candidate: Column) -> Column:
    """Mod-10 check over the ASCII digits of ``candidate``, 13 to 19 of them."""
    return let(
        F.regexp_replace(candidate, "[^0-9]", ""),
        lambda d: F.length(d).between(rules.LUHN_MIN_DIGITS, rules.LUHN_MAX_DIGITS) & F.call_function("luhn_check", d),
    )


def _may_match(text: Column, ord: int) -> Column:
    """A cheap condition that holds for every text the detector matches."""
    if ord == 1:
        return F.contains(text, F.lit("@"))
    if ord in (2, 3):
        return text.rlike(r"(?U)\d{4}")
    if ord == 4:
        return text.rlike(r"(?U)\d(?:[ -]*\d){12}")
    if ord == 5:
        return F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("sk_"))
    if ord == 6:
        return F.contains(text, F.lit("AKIA"))
    if ord == 7:
        return F.contains(text, F.lit("ghp_"))
    return F.contains(text, F.lit("PRIVATE KEY-----"))


def detector_spans(text: Column, ord: int, kind: str, pattern: str) -> Column:
    """Spans of one detector; digits, words and spaces are Unicode-aware."""
    keep = luhn_check if kind == rules.LUHN_KIND else None
    spans = match_spans(text, "(?U)" + pattern, ord, kind, keep)
    if ord == 1:
        long = text.rlike(rf"(?<!{_NAME}){_NAME}{{{LONG_NAME}}}")
        spans = F.when(long, email_spans_by_sign(text, ord, kind)).otherwise(spans)
    return F.when(_may_match(text, ord), spans).otherwise(F.array().cast(MATCH_TYPE))


#: Characters of the name in front of the sign; the pattern tries every one of
#: them as a start, so its work grows with the square of such a run.
_NAME = "[A-Za-z0-9._%+-]"
LONG_NAME = 256


def _email_ends(parts: Column) -> Column:
    """For every sign between two parts, (start, end) of its match counted from the
    sign, or nulls. ``parts`` is a text cut at the signs.

    The match starts at the first word boundary of the run of name characters
    before the sign. If that run reaches back to the sign before, it begins where
    the match of that sign ended, if there is one.
    """
    # the run, with the character before it if there is one
    run = rf"(?s)(?:\A|[^{_NAME[1:-1]}])({_NAME}++)\z"
    domain = r"(?U)\A[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

    def first_boundary(name: Column, after_word: Column) -> Column:
        skipped = F.when(after_word, F.regexp_extract(name, r"\A\w*+", 0)).otherwise(
            F.regexp_extract(name, r"\A[.%+-]*+", 0)
        )
        return F.when(F.length(skipped) < F.length(name), F.length(name) - F.length(skipped))

    def facts(i: Column) -> Column:
        left, right = F.get(parts, i - 1), F.get(parts, i)
        shown = F.struct(F.regexp_extract(left, run, 0).alias("all"), F.regexp_extract(left, run, 1).alias("name"))

        def of(r: Column) -> Column:
            bare = F.length(r["all"]) == F.length(r["name"])  # nothing before it in this part
            reaches_back = bare & (F.length(r["name"]) == F.length(left)) & (i > 1)
            after_word = ~bare & F.rlike(F.substring(r["all"], 1, 1), F.lit(r"(?U)\w"))
            return F.struct(
                F.length(F.regexp_extract(right, domain, 0)).alias("domain"),
                first_boundary(r["name"], after_word).alias("free"),
                r["name"].alias("name"),
                reaches_back.alias("back"),
            )

        return let(shown, of)

    def step(acc: Column, f: Column) -> Column:
        """``acc``: where the last match ends behind its sign, or 0 without one."""
        rest = F.substring(f["name"], acc["end"] + 1, F.length(f["name"]))
        # the last character of a domain is a letter
        cut = first_boundary(rest, F.lit(True))
        before = F.when(f["back"] & (acc["end"] > 0), cut).otherwise(f["free"])

        def next_(b: Column) -> Column:
            found = b.isNotNull() & (f["domain"] > 0)
            end = F.when(found, f["domain"]).otherwise(0)
            return F.struct(
                end.alias("end"),
                F.concat(acc["out"], F.array(F.struct(F.when(found, b).alias("before"), F.when(found, end).alias("after")))).alias("out"),
            )

        return let(before, next_)

    empty = F.array().cast("array<struct<before:int,after:int>>")
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<struct<before:int,after:int>>>").alias("done"))

    def block(acc: Column, some: Column) -> Column:
        walked = F.aggregate(
            F.transform(some, facts), F.struct(acc["end"].alias("end"), empty.alias("out")), step
        )
        # a value that is bound is copied: what is done so far has to stay outside
        return F.struct(walked["end"].alias("end"), F.concat(acc["done"], F.array(walked["out"])).alias("done"))

    signs = F.sequence(F.lit(1), F.size(parts) - 1)
    cut = let(signs, lambda s: in_blocks(s, lambda b: b))
    return F.aggregate(cut, start, block, lambda acc: F.flatten(acc["done"]))


def email_spans_by_sign(text: Column, ord: int, kind: str) -> Column:
    """The same spans as those of the pattern, looking only around each sign."""

    def spans(parts: Column) -> Column:
        # where each part ends, signs before it included
        ends = running_sums(F.transform(parts, lambda p, i: F.length(p) + F.when(i > 0, 1).otherwise(0)))
        both = F.arrays_zip(F.slice(ends, F.lit(1), F.size(parts) - 1).alias("at"), _email_ends(parts).alias("m"))
        return F.transform(
            F.filter(both, lambda b: b["m"]["before"].isNotNull()),
            lambda b: F.struct(
                (b["at"] - b["m"]["before"]).alias("start"),
                F.lit(ord).alias("ord"),
                (b["at"] + 1 + b["m"]["after"]).alias("end"),
                F.lit(kind).alias("kind"),
            ),
        )

    return let(F.split(text, "@", -1), spans)


DIGIT_DETECTORS = (2, 3, 4)


def has_digit(text: Column) -> Column:
    ascii_digit = text.rlike("[0123456789]")
    return ascii_digit | (~is_ascii(text) & text.rlike(r"(?U)\d"))


def pii_matches(text: Column) -> Column:
    """Spans of all detectors, before overlaps are merged."""
    found = {o: detector_spans(text, o, k, p) for o, k, p in rules.DETECTORS}
    numbers = F.concat(*[found.pop(o) for o in DIGIT_DETECTORS])
    numbers = F.when(has_digit(text), numbers).otherwise(F.array().cast(MATCH_TYPE))
    # the merge orders matches by start and detector, so their order here is free
    return F.concat(numbers, *found.values())


def pii_spans(text: Column) -> Column:
    """Merged spans. Materialize this once (``withColumn``) and derive the rest."""
    return merge_spans(pii_matches(text))


def redact(text: Column, spans: Column) -> Column:
    return mask_spans(text, spans, rules.MASKS)


def kind_category(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.KIND_CATEGORY.items() for x in kv])
    return table[kind]


def pii_findings(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            kind_category(s["kind"]).alias("category"),
            s["kind"].alias("rule_name"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit("raw").alias("space"),
        ),
    )


def has_secret(spans: Column) -> Column:
    return F.exists(spans, lambda s: kind_category(s["kind"]) == rules.SECRET_LEAK)


def verdict(
    action: str,
    reason: Column | None = None,
    category: Column | None = None,
    redacted_text: Column | None = None,
    redactions_count: Column | None = None,
) -> Column:
    null = F.lit(None)

    def typed(c: Column | None, t: str) -> Column:
        return (null if c is None else c).cast(t)

    return F.struct(
        F.lit(action).alias("action"),
        typed(reason, "string").alias("reason"),
        typed(category, "string").alias("category"),
        typed(redacted_text, "string").alias("redacted_text"),
        typed(redactions_count, "int").alias("redactions_count"),
    )


def pii_verdict(text: Column, spans: Column, block_secrets: bool | Column = True) -> Column:
    secret = has_secret(spans) & (
        block_secrets if isinstance(block_secrets, Column) else F.lit(block_secrets)
    )
    return (
        F.when(F.size(spans) == 0, verdict("Allow"))
        .when(secret, verdict("Block", F.lit(rules.REASON_SECRET), F.lit(rules.SECRET_LEAK)))
        .otherwise(
            verdict("Redact", redacted_text=redact(text, spans), redactions_count=F.size(spans))
        )
    )
