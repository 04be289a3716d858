"""Audit records, counters and their text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.errors import audit_text

AUDIT_COLUMNS = (
    "timestamp",
    "request_id",
    "endpoint",
    "model",
    "streaming",
    "injection_detected",
    "pii_redacted",
    "pii_findings_count",
    "stream_killed",
    "rag_retrieval_performed",
    "upstream_latency_us",
    "scan_latency_us",
    "outcome",
    "block_reason",
)


def utc_clock(ts: Column) -> Column:
    """UTC date and time to the second, whatever the session time zone is."""
    since = F.make_dt_interval(secs=F.unix_seconds(ts).cast("decimal(18,6)"))
    return (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + since).cast("string")


def utc_text(ts: Column) -> Column:
    """The same as ``YYYY-MM-DDThh:mm:ssZ``."""
    return F.concat(F.replace(utc_clock(ts), F.lit(" "), F.lit("T")), F.lit("Z"))


def request_id_or(request_id: Column, key: Column) -> Column:
    """The given id, else one made from a stable key of the row."""
    return F.coalesce(request_id, F.format_string("req-%010d", key.cast("bigint")))


def audit_records(decided: DataFrame) -> DataFrame:
    """One audit row per decided request. Expects the columns of
    :func:`textguard.plans.chat.decide_chat`; requests that are no valid chat
    request at all (code 400) leave no record."""
    err = F.col("error")
    blocked_tool = err["category"] == rules.CAT_TOOL
    reached = F.col("reached_upstream")
    outcome = (
        F.when(F.col("injection_detected"), "blocked_security")
        .when(err["kind"] == "security_blocked", "blocked_policy")
        .when(F.col("upstream_error").isNotNull(), "upstream_error")
        .when(F.col("stream_killed"), "stream_killed")
        .otherwise("allowed")
    )
    tool_text = F.regexp_replace(err["message"], r" in the allowed tools list$", " allowed")
    reason = (
        F.when(F.col("injection_detected"), err["message"])
        .when(blocked_tool, tool_text)
        .when(err.isNotNull(), audit_text(err))
        .otherwise(F.col("upstream_error"))
    )
    return decided.where(err.isNull() | (err["code"] != 400)).select(
        utc_text(F.col("ts")).alias("timestamp"),
        "request_id",
        "endpoint",
        F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("streaming", F.lit(False)).alias("streaming"),
        "injection_detected",
        (F.col("response_findings") > 0).alias("pii_redacted"),
        F.col("response_findings").cast("bigint").alias("pii_findings_count"),
        "stream_killed",
        F.col("rag_retrieval_performed"),
        F.when(reached, F.col("upstream_latency_us")).otherwise(0).cast("bigint").alias("upstream_latency_us"),
        F.lit(0).cast("bigint").alias("scan_latency_us"),
        outcome.alias("outcome"),
        reason.alias("block_reason"),
    )


def counters(decided: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """The ten gateway counters, optionally per ``dims``. One partial
    aggregation per task, one row per group out."""
    err = F.col("error")
    policy = (err["kind"] == "security_blocked") & ~F.col("injection_detected")
    # a failed connection has a latency in its audit record but is no sample
    sampled = F.col("reached_upstream") & F.col("upstream_error").isNull()
    latency = F.coalesce(F.sum(F.when(sampled, F.col("upstream_latency_us"))), F.lit(0))
    samples = F.count_if(sampled)

    columns = [
        F.count_if(F.col("readable")).alias("requests"),
        F.count_if(F.col("injection_detected")).alias("injection_blocks"),
        F.count_if(policy).alias("policy_blocks"),
        F.coalesce(F.sum("redacted_choices"), F.lit(0)).cast("bigint").alias("pii_redactions"),
        F.coalesce(F.sum("inbound_redactions"), F.lit(0)).cast("bigint").alias("inbound_pii_redactions"),
        F.count_if(F.col("stream_killed")).alias("stream_kills"),
        F.count_if(F.col("rag_retrieval_performed")).alias("rag_retrievals"),
        latency.cast("bigint").alias("upstream_latency_us"),
        samples.alias("upstream_latency_samples"),
    ]
    return (
        decided.groupBy(*dims)
        .agg(*columns)
        .withColumn(
            "upstream_latency_mean_us",
            F.when(
                F.col("upstream_latency_samples") > 0,
                F.expr("upstream_latency_us div upstream_latency_samples"),
            )
            .otherwise(0)
            .cast("bigint"),
        )
    )


def prometheus_lines(counts: DataFrame) -> DataFrame:
    """(pos, line) of the text exposition of one row of counters."""
    rows = []
    for column, name, kind, help_ in rules.METRICS:
        value = F.format_string(f"{name} %d", F.col(column))
        rows += [F.lit(f"# HELP {name} {help_}"), F.lit(f"# TYPE {name} {kind}"), value]
    return counts.select(F.posexplode(F.array(*rows)).alias("pos", "line"))


def outcome_breakdown(audit: DataFrame) -> DataFrame:
    """Records per outcome, endpoint and model, with subtotals per outcome and
    over all (null = all)."""
    return audit.rollup("outcome", "endpoint", "model").agg(F.count("*").alias("requests"))
