"""Prompt-injection and jailbreak detection."""

from __future__ import annotations

import re
from functools import reduce
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.pii import FINDING_TYPE, verdict
from textguard.functions.spans import match_spans
from textguard.functions.text import fill, let, listed_class


MIN_ANCHOR = 5


def check_phrases(phrases: Sequence[str]) -> tuple[str, ...]:
    """Raise if one alternation could not reproduce earliest-end matching.

    Hits are reported at the earliest end and do not overlap. A length-ordered
    alternation does the same as long as no phrase lies strictly inside
    another one other than as its prefix.
    """
    if any(not p for p in phrases):
        raise ValueError("empty phrase")
    for inner in phrases:
        for outer in phrases:
            if inner != outer and outer.find(inner, 1) > 0:
                raise ValueError(f"phrase {inner!r} lies inside {outer!r}")
    return tuple(phrases)


def phrase_pattern(phrases: Sequence[str]) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(phrases, key=len))


def anchor_tokens(phrases: Sequence[str], words: int) -> list[str]:
    """A few sequences of ``words`` words such that every phrase contains at
    least one, so text without any of them cannot contain a phrase."""

    def sequences(phrase: str) -> set[str]:
        parts = phrase.split(" ")
        runs = {" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}
        # short ones ("no", "an") are in every text
        return {r for r in runs if len(r) >= MIN_ANCHOR} or {phrase}

    left = {p: sequences(p) for p in phrases}
    chosen: list[str] = []
    while left:
        options = sorted({t for ts in left.values() for t in ts})
        best = max(options, key=lambda t: (sum(t in p for p in left), len(t)))
        chosen.append(best)
        left = {p: ts for p, ts in left.items() if best not in p}
    return chosen


def may_contain_phrase(normalized: Column, phrases: Sequence[str]) -> Column:
    """``contains`` is far cheaper than trying a long alternation at every
    character: single words first, word pairs for what is left."""

    def any_of(tokens: Sequence[str]) -> Column:
        hits = [F.contains(normalized, F.lit(t)) for t in tokens]
        return reduce(lambda a, b: a | b, hits)

    return any_of(anchor_tokens(phrases, 1)) & any_of(anchor_tokens(phrases, 2))


def keyword_findings(normalized: Column, phrases: Sequence[str] | None = None) -> Column:
    """Every phrase hit in normalized text, left to right."""
    phrases = check_phrases(phrases or rules.all_phrases())
    spans = match_spans(normalized, phrase_pattern(phrases), 0, lambda m: m)
    found = F.transform(
        spans,
        lambda s: F.struct(
            F.lit(rules.PROMPT_INJECTION).alias("category"),
            F.concat(F.lit(rules.KEYWORD_PREFIX), s["kind"]).alias("rule_name"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit("normalized").alias("space"),
        ),
    )
    return F.when(may_contain_phrase(normalized, phrases), found).otherwise(
        F.array().cast(FINDING_TYPE)
    )


def _first_match(text: Column, pattern: str, guard: Column, category: str, rule: str) -> Column:
    def finding(start: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(category).alias("category"),
                F.lit(rule).alias("rule_name"),
                start.alias("start"),
                (start + F.length(F.regexp_extract(text, pattern, 0))).alias("end"),
                F.lit("raw").alias("space"),
            )
        )

    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    return F.when(guard & text.rlike(pattern), let(start, finding)).otherwise(
        F.array().cast(FINDING_TYPE)
    )


def base64_finding(text: Column) -> Column:
    # a run of 64 covers a whole block of 32 that starts at a multiple of 32:
    # look at the blocks only, most of them fail at their first few characters
    letters = listed_class(((0x2B, 0x2B), (0x2F, 0x39), (0x41, 0x5A), (0x61, 0x7A)))
    long_run = text.rlike(rf"(?s)\A(?:.{{32}})*?[{letters}]{{32}}")
    return _first_match(
        text,
        rules.BASE64_PATTERN,
        (F.length(text) >= 64) & long_run,
        rules.MALICIOUS_PAYLOAD,
        rules.BASE64_RULE,
    )


def fake_turn_finding(text: Column) -> Column:
    return _first_match(
        text,
        "(?Ui)" + rules.FAKE_TURN_PATTERN,
        F.contains(text, F.lit("\n")),
        rules.JAILBREAK,
        rules.FAKE_TURN_RULE,
    )


def injection_findings(
    text: Column, normalized: Column, phrases: Sequence[str] | None = None
) -> Column:
    """Phrase hits, then the base64 blob, then the fake turn."""
    return F.concat(
        keyword_findings(normalized, phrases), base64_finding(text), fake_turn_finding(text)
    )


def block_reason(category: Column, rule_name: Column) -> Column:
    return (
        F.when(category == rules.PROMPT_INJECTION, fill(rules.REASON_INJECTION, rule_name))
        .when(category == rules.JAILBREAK, fill(rules.REASON_JAILBREAK, rule_name))
        .when(category == rules.MALICIOUS_PAYLOAD, F.lit(rules.REASON_PAYLOAD))
        .otherwise(F.lit(rules.REASON_DEFAULT))
    )


def injection_verdict(findings: Column) -> Column:
    """Block on the first finding, else allow."""
    first = F.get(findings, F.lit(0))
    return F.when(
        F.size(findings) > 0,
        verdict("Block", block_reason(first["category"], first["rule_name"]), first["category"]),
    ).otherwise(verdict("Allow"))


def family_of(rule_name: Column, families: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Attack family of a keyword rule; the structural rules are their own."""
    families = families or rules.PHRASES
    table = F.create_map(
        *[F.lit(x) for f, ps in families.items() for p in ps for x in (rules.KEYWORD_PREFIX + p, f)]
    )
    return F.coalesce(F.try_element_at(table, rule_name), F.regexp_replace(rule_name, "^structural:", ""))
