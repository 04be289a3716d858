"""Inspection of chat requests and responses, one row each.

A request carries its messages in one JSON body, so everything up to the
verdict happens inside the row: no explode, no regrouping, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import injection, pii, policy
from textguard.functions.errors import ERROR_TYPE, error
from textguard.functions.normalize import with_normalized_each
from textguard.functions.spans import SPAN_TYPE
from textguard.functions.sse import json_string
from textguard.functions.text import evaluate



def replace_member(variant: Column, name: str, value: Column) -> Column:
    """The JSON object with one member replaced; null if it is no object."""
    members = F.try_variant_get(variant, "$", policy.OBJECT)
    return F.to_variant_object(
        F.transform_values(members, lambda k, v: F.when(k == name, value).otherwise(v))
    )


def _spans_of(text: Column) -> Column:
    return F.when(text.isNotNull(), pii.pii_spans(text)).otherwise(F.array().cast(SPAN_TYPE))


def _first_finding(text: Column, normalized: Column) -> Column:
    found = F.when(text.isNotNull(), injection.injection_findings(text, normalized))
    return F.get(found, F.lit(0))


def inspect_messages(parsed: DataFrame) -> DataFrame:
    """Add what the message scan sees, for rows with a ``payload``:

    - ``contents``: text of every message, null where it is not a string
    - ``blocked_index``, ``block_category``, ``block_rule``: first attack, if any
    - ``inbound_redactions``: messages with sensitive data up to that one
    - ``sanitized``: the texts with sensitive data masked
    - ``unscanned``: messages without a text to scan
    """
    messages = policy.members(F.col("payload"), "$.messages")
    texts = F.transform(messages, lambda m: json_string(m, "$.content"))
    df = with_normalized_each(evaluate(parsed, "contents", texts), "contents", "_normalized")
    both = F.arrays_zip(F.col("contents").alias("t"), F.col("_normalized").alias("n"))
    attacks = F.transform(both, lambda b: _first_finding(b["t"], b["n"]))
    df = evaluate(df, "_attacks", attacks)
    df = evaluate(df, "_spans", F.transform("contents", _spans_of))
    first = F.array_position(F.transform("_attacks", lambda a: a.isNotNull()), True)
    df = df.withColumn("blocked_index", (F.nullif(first, F.lit(0)) - 1).cast("int"))
    attack = F.get("_attacks", F.col("blocked_index"))
    reached = F.when(
        F.col("blocked_index").isNotNull(), F.slice("_spans", F.lit(1), F.col("blocked_index") + 1)
    ).otherwise(F.col("_spans"))
    masked = F.transform(
        F.arrays_zip(F.col("contents").alias("t"), F.col("_spans").alias("s")),
        lambda z: pii.redact(z["t"], z["s"]),
    )
    return (
        evaluate(df, "sanitized", masked)
        .withColumn("block_category", attack["category"])
        .withColumn("block_rule", attack["rule_name"])
        .withColumn("inbound_redactions", F.size(F.filter(reached, lambda s: F.size(s) > 0)))
        .withColumn("unscanned", F.size(F.filter("contents", lambda t: t.isNull())))
        .drop("_normalized", "_attacks", "_spans")
    )


def attack_error(category: Column, rule_name: Column) -> Column:
    """Security error of an attack; its category is spelled in camel case."""
    camel = F.regexp_replace(F.initcap(F.replace(category, F.lit("_"), F.lit(" "))), " ", "")
    reason = injection.block_reason(category, rule_name)
    return F.when(category.isNotNull(), error("security_blocked", reason, camel))


def with_model(body: Column, default_model: str) -> Column:
    """The JSON object with the default model where none or an empty one is named."""
    members = F.try_variant_get(body, "$", policy.OBJECT)
    named = F.map_contains_key(members, "model") & (F.coalesce(json_string(body, "$.model"), F.lit("-")) != "")
    others = F.map_filter(members, lambda k, _: k != "model")
    model = F.create_map(F.lit("model"), F.lit(default_model).cast("variant"))
    return F.when(named, body).otherwise(F.to_variant_object(F.map_concat(others, model)))


def sanitized_body(
    payload: Column,
    sanitized: Column,
    system: Column | None = None,
    default_model: str = rules.DEFAULT_MODEL,
) -> Column:
    """JSON body with the sanitized texts (null = leave the message alone),
    ``system``, if any, as a system message in front, and a model."""
    messages = policy.members(payload, "$.messages")
    pairs = F.arrays_zip(messages.alias("m"), sanitized.alias("t"))

    def rewrite(pair: Column) -> Column:
        changed = replace_member(pair["m"], "content", pair["t"].cast("variant"))
        return F.when(pair["t"].isNotNull(), changed).otherwise(pair["m"])

    rewritten = F.transform(pairs, rewrite)
    if system is not None:
        front = F.to_variant_object(
            F.struct(F.lit("system").alias("role"), system.alias("content"))
        )
        rewritten = F.when(system.isNotNull(), F.concat(F.array(front), rewritten)).otherwise(rewritten)
    body = replace_member(payload, "messages", F.to_variant_object(rewritten))
    return F.to_json(with_model(body, default_model))


def last_user_text(payload: Column, texts: Column) -> Column:
    """Text of the last message of role user that has one."""
    messages = policy.members(payload, "$.messages")
    pairs = F.arrays_zip(messages.alias("m"), texts.alias("t"))
    mine = F.filter(pairs, lambda p: (json_string(p["m"], "$.role") == "user") & p["t"].isNotNull())
    return F.try_element_at(mine, F.lit(-1))["t"]


def redact_responses(responses: DataFrame) -> DataFrame:
    """Mask sensitive data in every ``choices[].message.content`` string of
    successful JSON responses; other bodies pass unchanged. Adds ``out_body``,
    ``redacted_choices`` and ``response_findings``."""
    readable = (F.col("status").between(200, 299)) & F.contains("content_type", F.lit("application/json"))
    payload = F.when(readable, F.try_parse_json("body"))
    df = evaluate(responses, "_payload", payload)
    choices = policy.members(F.col("_payload"), "$.choices")
    texts = F.transform(choices, lambda c: json_string(c, "$.message.content"))
    df = evaluate(df, "_texts", texts)
    df = evaluate(df, "_spans", F.transform("_texts", _spans_of))

    def rewrite(z: Column) -> Column:
        text = pii.redact(z["t"], z["s"]).cast("variant")
        message = replace_member(policy.member(z["c"], "$.message"), "content", text)
        return F.when(F.size(z["s"]) > 0, replace_member(z["c"], "message", message)).otherwise(z["c"])

    zipped = F.arrays_zip(choices.alias("c"), F.col("_texts").alias("t"), F.col("_spans").alias("s"))
    hits = F.coalesce(F.size(F.filter("_spans", lambda s: F.size(s) > 0)), F.lit(0))
    count = F.aggregate("_spans", F.lit(0), lambda n, s: n + F.size(s))
    df = df.withColumn("redacted_choices", F.greatest(hits, F.lit(0)))
    body = F.to_json(
        replace_member(F.col("_payload"), "choices", F.to_variant_object(F.transform(zipped, rewrite)))
    )
    return (
        df.withColumn("response_findings", F.coalesce(count, F.lit(0)).cast("bigint"))
        .withColumn("out_body", F.when(F.col("redacted_choices") > 0, body).otherwise(F.col("body")))
        .drop("_payload", "_texts", "_spans")
    )


def response_text(body: Column) -> Column:
    """Text of the first choice, empty if there is none."""
    return F.coalesce(
        json_string(F.try_parse_json(body), "$.choices[0].message.content"), F.lit("")
    )


def retrieval_error(
    enabled: bool, allowlist: Sequence[str], default_deny: bool = True
) -> Column:
    """Retrieval has to be on the allowlist too, if it is switched on."""
    if not enabled:
        return F.lit(None).cast(ERROR_TYPE)
    return policy.governance_error(rules.CAT_RAG, rules.RAG_TARGET, allowlist, default_deny)


