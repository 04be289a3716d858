"""Validation and policy decisions over request tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import policy
from textguard.functions.errors import error
from textguard.functions.sse import json_string
from textguard.functions.text import evaluate, fill


def parse_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload`` (variant); null for bodies that are not JSON."""
    return evaluate(requests, "payload", F.try_parse_json(body))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) rows; nothing is dropped and no job fails."""
    return parsed.where(F.col("payload").isNotNull()), parsed.where(F.col("payload").isNull())


def requested_tools(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per tool with a name."""
    tools = F.posexplode(policy.members(F.col("payload"), "$.tools")).alias("idx", "tool")
    return (
        parsed.select(*keys, tools)
        .select(*keys, "idx", json_string(F.col("tool"), "$.function.name").alias("name"))
        .where(F.col("name").isNotNull())
    )


def denied_tools(tools: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tools that are not in ``allowed(name)``; an empty list denies all. The
    list is joined without a hint: broadcast when it is small, else shuffled."""
    denied = tools.join(allowed.select("name").distinct(), "name", "left_anti")
    return denied.withColumn("reason", fill(rules.MSG_TOOL_DENIED, F.col("name")))


def governed_targets(
    targets: DataFrame, allowlist: DataFrame, category: str, default_deny: bool = True
) -> DataFrame:
    """Add ``error`` to every row of ``targets(target, ...)``: null if allowed."""
    if not default_deny:
        return targets.withColumn("error", F.lit(None).cast("string"))
    listed = allowlist.select("target").distinct().withColumn("listed", F.lit(True))
    reason = fill(rules.MSG_GOVERNANCE, F.lit(category), F.col("target"))
    return (
        targets.join(listed, "target", "left")
        .withColumn("error", F.when(F.col("listed").isNull(), reason))
        .drop("listed")
    )


def decide(
    parsed: DataFrame,
    base_url: str,
    allowlist: Sequence[str] = (),
    default_deny: bool = True,
    allowed_tools: Sequence[str] = (),
) -> DataFrame:
    """Add ``error``: the first rule that a request breaks before its text is
    looked at (readable body, auth, governance, tools, messages)."""
    payload = F.col("payload")
    unreadable = F.when(payload.isNull(), error("bad_request", "Request body must be valid JSON"))
    return evaluate(
        parsed,
        "error",
        F.coalesce(
            unreadable,
            policy.auth_error(F.col("auth_ok")),
            policy.governance_error(rules.CAT_NETWORK, base_url, allowlist, default_deny),
            policy.tools_error(payload, allowed_tools),
            policy.messages_error(payload),
        ),
    )
