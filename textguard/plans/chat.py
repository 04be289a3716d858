"""End-to-end chat jobs over tables of requests and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import policy
from textguard.functions.errors import error
from textguard.functions.sse import json_string
from textguard.functions.text import evaluate
from textguard.operators import chat, retrieval, scanning
from textguard.operators.policy import decide, parse_bodies


def decide_requests(
    requests: DataFrame,
    base_url: str,
    allowlist: Sequence[str] = (),
    default_deny: bool = True,
    allowed_tools: Sequence[str] = (),
    rag_enabled: bool = False,
    default_model: str = rules.DEFAULT_MODEL,
) -> DataFrame:
    """requests(request_id, ts, endpoint, auth_ok, body) with the first error in
    the order auth, governance, tools, messages, attack, retrieval governance.

    The message scan only counts where the rules before it passed. All in one
    pass without a shuffle.
    """
    parsed = parse_bodies(requests)
    ruled = decide(parsed, base_url, allowlist, default_deny, allowed_tools)
    ruled = ruled.withColumnRenamed("error", "_ruled")
    # rows that already failed are not scanned
    scannable = F.when(F.col("_ruled").isNull(), F.col("payload"))
    scanned = chat.inspect_messages(
        ruled.withColumn("readable", F.col("payload").isNotNull()).withColumn("payload", scannable)
    )
    attack = chat.attack_error(F.col("block_category"), F.col("block_rule"))
    rag = chat.retrieval_error(rag_enabled, allowlist, default_deny)
    passed_rules = F.col("_ruled").isNull()
    return (
        evaluate(scanned, "error", F.coalesce("_ruled", attack, rag))
        .withColumn("injection_detected", F.col("block_category").isNotNull())
        .withColumn("inbound_redactions", F.greatest("inbound_redactions", F.lit(0)))
        .withColumn("unscanned", F.greatest("unscanned", F.lit(0)))
        .withColumn("model", F.when(passed_rules, policy.model_name(F.col("payload"), default_model)))
        .withColumn("streaming", F.when(passed_rules, policy.is_streaming(F.col("payload"))))
        .drop("_ruled")
    )


def decide_chat(
    decided: DataFrame, responses: DataFrame, stream_ends: DataFrame | None = None
) -> DataFrame:
    """Join decided requests to their upstream responses (one each) and inspect
    the replies. ``stream_ends(request_id, status)`` names cut streams.

    A request without a response failed upstream: ``failure`` of its response
    row, where there is one without a status, says how (``timeout``, or the text
    of a failed connection). ``upstream_failure`` is the error the client gets.
    """
    asked = decided.withColumn("reached_upstream", F.col("error").isNull())
    if "failure" not in responses.columns:
        responses = responses.withColumn("failure", F.lit(None).cast("string"))
    inspected = chat.redact_responses(responses).select(
        "request_id",
        F.col("status").alias("upstream_status"),
        "out_body",
        "redacted_choices",
        "response_findings",
        F.col("upstream_latency_us").alias("_latency"),
        F.col("failure").alias("_failure"),
    )
    joined = asked.join(inspected, "request_id", "left")
    if stream_ends is not None:
        killed = stream_ends.where("status = 'killed'").select("request_id", F.lit(True).alias("_killed"))
        joined = joined.join(killed, "request_id", "left")
    else:
        joined = joined.withColumn("_killed", F.lit(False))
    reached, whole = F.col("reached_upstream"), ~F.coalesce("streaming", F.lit(False))
    no_answer = reached & F.col("upstream_status").isNull()
    answered = F.coalesce(F.col("upstream_status").between(200, 299), F.lit(False))
    failure = F.coalesce("_failure", F.lit(rules.MSG_NO_RESPONSE))
    timed_out = F.col("upstream_error") == rules.TIMEOUT
    return (
        joined.withColumn("upstream_error", F.when(no_answer, failure))
        .withColumn(
            "upstream_failure",
            F.when(timed_out, error("upstream_timeout", rules.MSG_TIMEOUT)).when(
                F.col("upstream_error").isNotNull(),
                error("upstream_connection_failed", F.concat(F.lit(rules.MSG_CONNECTION), F.col("upstream_error"))),
            ),
        )
        .withColumn("upstream_latency_us", F.when(reached, F.coalesce("_latency", F.lit(0))).otherwise(0))
        .withColumn("out_body", F.when(reached & whole, F.col("out_body")))
        .withColumn(
            "redacted_choices", F.when(reached & whole, F.coalesce("redacted_choices", F.lit(0))).otherwise(0)
        )
        .withColumn(
            "response_findings", F.when(reached & whole, F.coalesce("response_findings", F.lit(0))).otherwise(0)
        )
        # only a successful answer is streamed
        .withColumn("stream_killed", reached & ~whole & answered & F.coalesce("_killed", F.lit(False)))
        .withColumn("rag_retrieval_performed", F.coalesce("rag_retrieval_performed", F.lit(False)))
        .drop("_latency", "_killed", "_failure")
    )


def _last_user(decided: DataFrame) -> DataFrame:
    """``_user``: the text that a request which goes upstream retrieves by."""
    user = chat.last_user_text(F.col("payload"), F.col("sanitized"))
    return decided.withColumn("_user", F.when(F.col("error").isNull(), user))


def _asking(asked: DataFrame) -> DataFrame:
    return asked.where(F.col("_user").isNotNull()).select(
        F.col("request_id").alias("query_id"), F.col("_user").alias("text")
    )


def enrich_requests(
    decided: DataFrame, corpus: DataFrame, k: int = rules.TOP_K, dim: int = rules.VECTOR_DIM
) -> DataFrame:
    """Add ``upstream_body`` (sanitized, retrieved context in front) and
    ``rag_retrieval_performed`` to the requests that go upstream."""
    asked = _last_user(decided)
    found = retrieval.contexts(retrieval.search_text(_asking(asked), corpus, k, dim))
    joined = asked.join(found.withColumnRenamed("query_id", "request_id"), "request_id", "left")
    system = retrieval.chat_context(F.col("context"))
    body = chat.sanitized_body(F.col("payload"), F.col("sanitized"), system)
    return (
        evaluate(joined, "upstream_body", F.when(F.col("error").isNull(), body))
        .withColumn("rag_retrieval_performed", F.col("error").isNull() & F.col("context").isNotNull())
        .drop("_user", "context")
    )


def with_retrieval(
    decided: DataFrame, corpus: DataFrame, k: int = rules.TOP_K, dim: int = rules.VECTOR_DIM
) -> DataFrame:
    """Only the ``rag_retrieval_performed`` of :func:`enrich_requests`, for records and
    counters, which don't show what was found.

    Every text has a vector, so a request that goes upstream with a user's text finds
    something if there is any document. Only rows without an id, which no text is
    attached to, could fill all ``k`` places; where there are such, the search is made.
    """
    texts = corpus.where(F.col("text").isNotNull())
    named, nameless = texts.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).head()
    if nameless:
        return enrich_requests(decided, corpus, k, dim).drop("upstream_body")
    asked = _last_user(decided)
    found = F.max(F.col("_user").isNotNull()).over(Window.partitionBy("request_id"))
    # requests of one id search together: a text of one of them is enough
    some = F.col("request_id").isNotNull() & F.lit(named > 0 and k > 0)
    performed = F.col("error").isNull() & some & found
    return asked.withColumn("rag_retrieval_performed", performed).drop("_user")


def sanitize_requests(decided: DataFrame) -> DataFrame:
    """Add ``upstream_body`` without retrieval."""
    body = chat.sanitized_body(F.col("payload"), F.col("sanitized"))
    return evaluate(
        decided, "upstream_body", F.when(F.col("error").isNull(), body)
    ).withColumn("rag_retrieval_performed", F.lit(False))


def simple_chat(
    prompts: DataFrame,
    base_url: str,
    allowlist: Sequence[str] = (),
    default_deny: bool = True,
    block_secrets: bool = True,
    default_model: str = rules.DEFAULT_MODEL,
    rag_enabled: bool = False,
) -> DataFrame:
    """prompts(prompt, model, auth_ok, ...) of the simple endpoint: empty
    prompt, auth, governance, attack, secrets and, if retrieval is on, its place on
    the allowlist, in this order. Adds ``error``, ``final_prompt`` and ``model``."""
    guarded = scanning.prompt_guard(prompts, "prompt", block_secrets)
    v = F.col("verdict")
    camel = F.regexp_replace(F.initcap(F.replace(v["category"], F.lit("_"), F.lit(" "))), " ", "")
    blocked = F.when(scanning.is_blocked(v), error("security_blocked", v["reason"], camel))
    err = F.coalesce(
        policy.empty_prompt_error(F.col("prompt")),
        policy.auth_error(F.col("auth_ok")),
        policy.governance_error(rules.CAT_NETWORK, base_url, allowlist, default_deny),
        blocked,
        chat.retrieval_error(rag_enabled, allowlist, default_deny),
    )
    return (
        guarded.withColumn("error", err)
        .withColumn("model", F.coalesce("model", F.lit(default_model)))
        .withColumn(
            "final_prompt",
            F.when(F.col("error").isNull(), scanning.sanitized_text(F.col("prompt"), v)),
        )
    )


def simple_upstream(
    decided: DataFrame, key: str, corpus: DataFrame | None = None, k: int = rules.TOP_K, dim: int = rules.VECTOR_DIM
) -> DataFrame:
    """Add ``upstream_body`` to the rows of :func:`simple_chat` that go upstream;
    with a corpus, the nearest texts to the sanitized prompt stand before it."""
    prompt, context = F.col("final_prompt"), F.lit(None).cast("string")
    out = decided
    if corpus is not None:
        out = decided = evaluate(decided, "final_prompt", prompt)
        asked = decided.where(prompt.isNotNull()).select(F.col(key).alias("query_id"), prompt.alias("text"))
        found = retrieval.contexts(retrieval.search_text(asked, corpus, k, dim)).withColumnRenamed("query_id", key)
        out, context = decided.join(found.withColumnRenamed("context", "_context"), key, "left"), F.col("_context")
    body = simple_request_body(F.col("model"), retrieval.simple_context(context, prompt))
    return evaluate(out, "upstream_body", F.when(F.col("error").isNull(), body)).drop("_context")


def simple_request_body(model: Column, final_prompt: Column) -> Column:
    """Upstream body of the simple endpoint."""
    message = F.struct(F.lit("user").alias("role"), final_prompt.alias("content"))
    return F.to_json(
        F.struct(model.alias("model"), F.array(message).alias("messages"), F.lit(False).alias("stream"))
    )


def simple_replies(responses: DataFrame) -> DataFrame:
    """Replies of the simple endpoint: adds ``error``, ``response`` (text of the
    first choice, masked), ``raw`` (the body with that text) and ``redactions``."""
    df = evaluate(responses, "_payload", F.try_parse_json("body"))
    payload, path = F.col("_payload"), "$.choices[0].message.content"
    failed = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    message = F.concat(F.lit("Upstream returned error: "), F.coalesce("body", F.lit("")))
    err = F.when(failed, error("upstream_connection_failed", message)).when(
        payload.isNull(), error("internal", "Failed to parse upstream response JSON")
    )
    text = F.when(err.isNull(), F.coalesce(json_string(payload, path), F.lit("")))
    df = scanning.redact_table(df.withColumn("error", err).withColumn("_text", text), "_text")

    def rewrite(choice: Column, i: Column) -> Column:
        message = policy.member(choice, "$.message")
        masked = chat.replace_member(message, "content", F.col("redacted").cast("variant"))
        return F.when(i == 0, chat.replace_member(choice, "message", masked)).otherwise(choice)

    choices = F.transform(policy.members(payload, "$.choices"), rewrite)
    raw = chat.replace_member(payload, "choices", F.to_variant_object(choices))
    has_content = policy.member(payload, path).isNotNull()
    body = F.when(has_content, F.to_json(raw)).otherwise(F.to_json(payload))
    return (
        df.withColumn("raw", F.when(F.col("error").isNull(), body))
        .withColumnRenamed("redacted", "response")
        .withColumn("redactions", F.when(F.col("error").isNull(), F.col("redactions")).otherwise(0))
        .drop("_text", "_payload")
    )
