"""Scans over tables of text: findings, redaction, verdicts and counts.

All of these are one pass without a shuffle up to the final aggregation, and
that one combines on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import injection, pii
from textguard.functions.normalize import with_normalized
from textguard.functions.spans import byte_offset
from textguard.functions.text import evaluate


def with_pii(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the merged sensitive spans. They are a column of their own so that
    redaction, findings and verdict do not repeat the regular expressions."""
    return evaluate(df, spans, pii.pii_spans(F.col(text)))


def with_injection(
    df: DataFrame,
    text: str = "text",
    findings: str = "injection",
    phrases: Sequence[str] | None = None,
    compatibility: bool = True,
) -> DataFrame:
    """Add the injection findings of every row."""
    scan = with_normalized(df, text, "_normalized", compatibility)
    found = injection.injection_findings(F.col(text), F.col("_normalized"), phrases)
    return evaluate(scan, findings, found).drop("_normalized")


def redact_table(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``redacted`` and ``redactions`` to every row."""
    return (
        with_pii(df, text, "_spans")
        .withColumn("redacted", pii.redact(F.col(text), F.col("_spans")))
        .withColumn("redactions", F.size("_spans"))
        .drop("_spans")
    )


def pii_findings_table(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per finding with character and UTF-8 byte offsets."""
    found = with_pii(df, text, "_spans").where(F.size("_spans") > 0)
    rows = found.select(
        *keys, text, F.posexplode(pii.pii_findings(F.col("_spans"))).alias("idx", "f")
    )
    start, end = F.col("f.start"), F.col("f.end")
    return rows.select(
        *keys,
        "idx",
        F.col("f.category").alias("category"),
        F.col("f.rule_name").alias("rule_name"),
        start.alias("start"),
        end.alias("end"),
        byte_offset(F.col(text), start).alias("start_byte"),
        byte_offset(F.col(text), end).alias("end_byte"),
    )


def injection_findings_table(
    df: DataFrame, keys: Sequence[str], text: str = "text", phrases: Sequence[str] | None = None
) -> DataFrame:
    """One row per injection finding; offsets refer to the text named in ``space``."""
    found = with_injection(df, text, "_found", phrases)
    return found.select(*keys, F.posexplode("_found").alias("idx", "f")).select(
        *keys, "idx", "f.category", "f.rule_name", "f.start", "f.end", "f.space"
    )


def rule_hit_counts(findings: DataFrame) -> DataFrame:
    """Hits per category and rule, with subtotals (null = all)."""
    return findings.rollup("category", "rule_name").agg(F.count("*").alias("hits"))


def pii_summary(df: DataFrame, dims: Sequence[str], text: str = "text") -> DataFrame:
    """Findings per kind and dimension with all subtotals (null = all)."""
    kinds = with_pii(df.select(*dims, text), text, "_spans").select(
        *dims, F.explode("_spans.kind").alias("kind")
    )
    return kinds.cube(*dims, "kind").agg(F.count("*").alias("findings"))


def verdict_mix(df: DataFrame, text: str = "text", dims: Sequence[str] = ()) -> DataFrame:
    """How many texts are clean, blocked and redacted."""
    # one narrow row per text: the sensitive-data scan only runs on texts that
    # were not blocked, because CASE does not evaluate the other branch
    scan = with_injection(df.select(*dims, text), text, "_found")
    blocked = F.size("_found") > 0
    outcome = (
        F.when(blocked, "blocked")
        .when(F.size(pii.pii_spans(F.col(text))) > 0, "redacted")
        .otherwise("clean")
    )
    return (
        scan.withColumn("verdict", outcome).groupBy(*dims, "verdict").agg(F.count("*").alias("n"))
    )


def prompt_guard(df: DataFrame, text: str = "text", block_secrets: bool = True) -> DataFrame:
    """Injection verdict first, then the sensitive-data verdict."""
    scan = with_injection(df, text, "_found")
    scan = with_pii(scan, text, "_spans")
    attack = injection.injection_verdict(F.col("_found"))
    sensitive = pii.pii_verdict(F.col(text), F.col("_spans"), block_secrets)
    decided = F.when(F.size("_found") > 0, attack).otherwise(sensitive)
    return scan.withColumn("verdict", decided).drop("_found", "_spans")


def sanitized_text(text: Column, verdict: Column) -> Column:
    """What may be passed on: null when blocked."""
    return (
        F.when(verdict["action"] == "Redact", verdict["redacted_text"])
        .when(verdict["action"] == "Allow", text)
        .otherwise(F.lit(None).cast("string"))
    )


def is_blocked(verdict: Column) -> Column:
    return verdict["action"] == "Block"


def is_allowed(verdict: Column) -> Column:
    """Redacted text counts as allowed."""
    return verdict["action"] != "Block"
