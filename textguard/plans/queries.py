"""The registered queries: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import injection, normalize, pii, policy
from textguard.functions.embed import embed_text
from textguard.functions.errors import classify, envelope
from textguard.functions.sse import json_string
from textguard.operators import audit, chat, profile, retrieval, scanning, streams
from textguard.operators import policy as policy_ops
from textguard.operators.rate_limit import rate_limit
from textguard.operators.skew import join_hot_left
from textguard.plans import chat as jobs
from textguard.plans import inputs
from textguard.plans.inputs import chunks, prompts, requests, responses, table
from textguard.streaming.chat import counted
from textguard.streaming.ingest import ingest_stream as ingested
from textguard.streaming.jobs import job_folder, run_available, run_updates
from textguard.streaming.rate_limit import rate_limit_stream
from textguard.streaming.scan import late_counts, scan_states, scan_stream

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- normalization ---------------------------------------------------------------
@query
def strip_invisible(spark, sf):
    text = normalize.strip_invisible(F.col("text"))
    return prompts(spark, sf).select("prompt_id", text.alias("stripped"))


@query
def lower_text(spark, sf):
    return _documents(spark, sf).select("doc_id", normalize.lower(F.col("text")).alias("lowered"))


@query
def collapse_whitespace(spark, sf):
    text = normalize.collapse_whitespace(F.col("text"))
    return _documents(spark, sf).select("doc_id", text.alias("collapsed"))


@query
def normalize_text(spark, sf):
    return normalize.with_normalized(prompts(spark, sf)).select("prompt_id", "normalized")


@query
def normalize_documents(spark, sf):
    return normalize.with_normalized(_documents(spark, sf)).select("doc_id", "normalized")


# --- injection -------------------------------------------------------------------
@query
def injection_findings(spark, sf):
    return scanning.injection_findings_table(prompts(spark, sf), ["prompt_id"])


@query
def keyword_findings(spark, sf):
    text = normalize.with_normalized(prompts(spark, sf))
    found = F.posexplode(injection.keyword_findings(F.col("normalized"))).alias("idx", "f")
    return text.select("prompt_id", found).select(
        "prompt_id", "idx", "f.rule_name", "f.start", "f.end"
    )


@query
def base64_blobs(spark, sf):
    found = F.explode(injection.base64_finding(F.col("text"))).alias("f")
    return prompts(spark, sf).select("prompt_id", found).select("prompt_id", "f.start", "f.end")


@query
def fake_turns(spark, sf):
    found = F.explode(injection.fake_turn_finding(F.col("text"))).alias("f")
    return prompts(spark, sf).select("prompt_id", found).select("prompt_id", "f.start", "f.end")


@query
def injection_verdict(spark, sf):
    scan = scanning.with_injection(prompts(spark, sf))
    v = F.col("v")
    return scan.select(
        "prompt_id", injection.injection_verdict(F.col("injection")).alias("v")
    ).select(
        "prompt_id", "v.action", "v.reason", "v.category", scanning.is_allowed(v).alias("is_allowed")
    )


@query
def attack_families(spark, sf):
    found = injection_findings(spark, sf)
    family = injection.family_of(F.col("rule_name")).alias("family")
    # findings of one prompt are combined before the distinct count of prompts
    return (
        found.groupBy("prompt_id", family)
        .agg(F.count("*").alias("hits"))
        .groupBy("family")
        .agg(F.sum("hits").alias("hits"), F.count("*").alias("prompts"))
    )


@query
def rule_hit_counts(spark, sf):
    return scanning.rule_hit_counts(injection_findings(spark, sf))


@query
def document_injection_scan(spark, sf):
    scan = scanning.with_injection(_documents(spark, sf).select("lang", "text"))
    hits = F.size("injection")
    return scan.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.sum(hits).cast("bigint").alias("findings"),
        F.count_if(hits > 0).alias("flagged"),
    )


# --- sensitive data ----------------------------------------------------------------
def _detector_spans(df: DataFrame, key: str) -> DataFrame:
    m = F.explode(pii.pii_matches(F.col("text"))).alias("m")
    return df.select(key, m).select(key, "m.ord", "m.kind", "m.start", "m.end")


@query
def pii_detector_spans(spark, sf):
    return _detector_spans(prompts(spark, sf), "prompt_id")


@query
def document_detector_spans(spark, sf):
    return _detector_spans(_documents(spark, sf), "doc_id")


@query
def luhn_cards(spark, sf):
    pattern = "(?U)" + rules.DETECTORS[3][2]
    found = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("candidate")
    return (
        _documents(spark, sf)
        .select("doc_id", found)
        .withColumn("valid", pii.luhn_check(F.col("candidate")))
    )


@query
def pii_merged_spans(spark, sf):
    merged = scanning.with_pii(prompts(spark, sf))
    return merged.select("prompt_id", F.posexplode("spans").alias("idx", "s")).select(
        "prompt_id", "idx", "s.start", "s.end", "s.kind"
    )


@query
def pii_redact(spark, sf):
    return scanning.redact_table(_documents(spark, sf)).select("doc_id", "redacted", "redactions")


@query
def pii_redact_prompts(spark, sf):
    return scanning.redact_table(prompts(spark, sf)).select("prompt_id", "redacted", "redactions")


@query
def pii_redact_pages(spark, sf):
    pages = table(spark, sf, "pages")
    pages = pages.select("page_id", F.col("html").alias("text"))
    return scanning.redact_table(pages).select("page_id", "redacted", "redactions")


@query
def pii_findings(spark, sf):
    return scanning.pii_findings_table(_documents(spark, sf), ["doc_id"])


@query
def pii_verdict(spark, sf):
    scan = scanning.with_pii(prompts(spark, sf))
    v = pii.pii_verdict(F.col("text"), F.col("spans"), True).alias("v")
    return scan.select("prompt_id", v).select("prompt_id", "v.*")


@query
def pii_summary(spark, sf):
    return scanning.pii_summary(_documents(spark, sf), ["lang", "source"])


@query
def pii_categories(spark, sf):
    mask = F.create_map(*[F.lit(x) for kv in rules.MASKS.items() for x in kv])
    return (
        pii_merged_spans(spark, sf)
        .groupBy("kind")
        .agg(F.count("*").alias("findings"))
        .withColumn("category", pii.kind_category(F.col("kind")))
        .withColumn("mask", mask[F.col("kind")])
    )


@query
def verdict_mix(spark, sf):
    return scanning.verdict_mix(prompts(spark, sf), dims=["role"])


@query
def simple_prompt_guard(spark, sf):
    guarded = scanning.prompt_guard(prompts(spark, sf))
    v = F.col("verdict")
    return guarded.select(
        "prompt_id",
        "verdict.action",
        "verdict.reason",
        "verdict.category",
        scanning.sanitized_text(F.col("text"), v).alias("sanitized"),
    )


# --- streamed responses -------------------------------------------------------------
@query
def sse_deltas(spark, sf):
    return streams.chunk_deltas(chunks(spark, sf))


@query
def stream_windows(spark, sf):
    return streams.delta_windows(chunks(spark, sf))


@query
def stream_decisions(spark, sf):
    return streams.stream_decisions(chunks(spark, sf))


@query
def stream_output(spark, sf):
    return streams.stream_output(chunks(spark, sf))


@query
def stream_kills(spark, sf):
    return streams.stream_ends(chunks(spark, sf))


@query
def stream_summary(spark, sf):
    return streams.stream_summary(chunks(spark, sf))


# --- requests and policy -----------------------------------------------------------------
ALLOWED = [t.strip() for t in inputs.ALLOWED_TOOLS.split(",") if t.strip()]
ALLOWLIST = [inputs.BASE_URL, rules.RAG_TARGET]


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return policy_ops.parse_bodies(requests(spark, sf))


@query
def chat_requests(spark, sf):
    p = F.col("payload")
    return _parsed(spark, sf).select(
        "request_id",
        p.isNotNull().alias("readable"),
        policy.is_object(p).alias("is_object"),
        json_string(p, "$.model").alias("model"),
        F.size(policy.members(p, "$.messages")).alias("n_messages"),
        F.size(policy.members(p, "$.tools")).alias("n_tools"),
    )


@query
def message_validation(spark, sf):
    err = policy.messages_error(F.col("payload"))
    readable = _parsed(spark, sf).where(F.col("payload").isNotNull())
    return readable.select("request_id", err["code"].alias("code"), err["message"].alias("message"))


@query
def default_model(spark, sf):
    readable = _parsed(spark, sf).where(F.col("payload").isNotNull())
    return readable.select("request_id", policy.model_name(F.col("payload")).alias("model"))


@query
def tool_shape(spark, sf):
    err = policy.tools_error(F.col("payload"), None)
    return _parsed(spark, sf).select("request_id", err["message"].alias("message"))


@query
def tool_allowlist(spark, sf):
    names = F.explode(policy.split_list(F.lit(inputs.ALLOWED_TOOLS))).alias("name")
    allowed = spark.range(1).select(names)
    tools = policy_ops.requested_tools(_parsed(spark, sf), ["request_id"])
    return policy_ops.denied_tools(tools, allowed)


@query
def governance_targets(spark, sf):
    """Sites that are served over https anywhere are on the allowlist."""
    pages = table(spark, sf, "pages")
    site = F.regexp_extract("url", "^(https?)://([^/]+)", 2)
    targets = pages.select("page_id", site.alias("target"))
    secure = pages.where(F.startswith("url", F.lit("https://"))).select(site.alias("target"))
    out = policy_ops.governed_targets(targets, secure, rules.CAT_MCP)
    return out.select("page_id", "target", "error")


@query
def url_policy(spark, sf):
    urls = inputs.urls(spark, sf)
    return urls.select(
        "page_id",
        "planted",
        policy.url_block_reason(F.col("url")).alias("reason"),
        policy.url_block_reason(F.col("url"), allow_localhost=False).alias("strict_reason"),
    )


@query
def rate_limit_by_user(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    limited = rate_limit(events, "user_id", "ts", "event_id", 3, 86400)
    return limited.select("event_id", "user_id", "accepted")


@query
def rate_limit_global(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.lit(0).alias("key"), "ts")
    return rate_limit(events, "key", "ts", "event_id", 20, 3600).select("event_id", "accepted")


@query
def error_envelopes(spark, sf):
    kind = F.expr(inputs.ERROR_KIND)
    message = F.concat(F.lit("event "), F.col("event_id"))
    err = classify(kind, message, F.initcap("event_type"))
    events = table(spark, sf, "events").select("event_id", err.alias("err"))
    return events.where(F.col("err").isNotNull()).select(
        "event_id", "err.code", "err.type", envelope(F.col("err")).alias("body")
    )


@query
def empty_prompts(spark, sf):
    err = policy.empty_prompt_error(F.expr(inputs.BLANK_PROMPT))
    return prompts(spark, sf).select("prompt_id", err["message"].alias("message"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.decide_requests(
        requests(spark, sf), inputs.BASE_URL, ALLOWLIST, True, ALLOWED, rag_enabled=True
    )


@query
def request_decisions(spark, sf):
    return _decided(spark, sf).select(
        "request_id",
        "error.kind",
        "error.code",
        "error.message",
        "error.category",
        "model",
        "streaming",
        "injection_detected",
        F.col("blocked_index").cast("int").alias("blocked_index"),
        "inbound_redactions",
        "unscanned",
    )


@query
def rag_gate(spark, sf):
    """Retrieval is switched on but not on the allowlist."""
    decided = jobs.decide_requests(
        requests(spark, sf), inputs.BASE_URL, [inputs.BASE_URL], True, ALLOWED, rag_enabled=True
    )
    return decided.groupBy("error.category").agg(F.count("*").alias("requests"))


@query
def governance_default_deny(spark, sf):
    """Nothing is on the allowlist: all that gets as far as governance is denied."""
    decided = jobs.decide_requests(requests(spark, sf), inputs.BASE_URL, [], True, ALLOWED)
    return decided.groupBy("error.message").agg(F.count("*").alias("requests"))


@query
def sanitized_requests(spark, sf):
    out = jobs.sanitize_requests(_decided(spark, sf)).where(F.col("upstream_body").isNotNull())
    messages = policy.members(F.try_parse_json("upstream_body"), "$.messages")
    rows = out.select("request_id", F.posexplode(messages).alias("idx", "m"))
    return rows.select(
        "request_id",
        "idx",
        json_string(F.col("m"), "$.role").alias("role"),
        json_string(F.col("m"), "$.content").alias("content"),
    )


@query
def upstream_bodies(spark, sf):
    """The model that the forwarded body names, whether or not the request did."""
    out = jobs.sanitize_requests(_decided(spark, sf)).where(F.col("upstream_body").isNotNull())
    body = F.try_parse_json("upstream_body")
    return out.select(
        "request_id",
        F.try_variant_get(body, "$.model", "string").alias("model"),
        F.size(policy.members(body, "$.messages")).alias("n_messages"),
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).where("failure IS NULL")


@query
def response_redaction(spark, sf):
    out = chat.redact_responses(_answers(spark, sf))
    return out.select(
        "request_id",
        "status",
        "redacted_choices",
        "response_findings",
        chat.response_text(F.col("out_body")).alias("content"),
    )


@query
def simple_chat_requests(spark, sf):
    asked = prompts(spark, sf).select(
        "prompt_id",
        F.expr(inputs.BLANK_PROMPT).alias("prompt"),
        F.when(F.col("prompt_id") % 3 == 0, "m9").alias("model"),
        F.expr(inputs.AUTH_OK).alias("auth_ok"),
    )
    out = jobs.simple_chat(asked, inputs.BASE_URL, ALLOWLIST)
    return out.select(
        "prompt_id", "error.code", "error.message", "error.category", "model", "final_prompt"
    )


@query
def simple_upstream_bodies(spark, sf):
    """What goes upstream from the simple endpoint, with the texts that were found."""
    asked = prompts(spark, sf).select(
        "prompt_id",
        F.col("text").alias("prompt"),
        F.when(F.col("prompt_id") % 3 == 0, "m9").alias("model"),
        F.expr(inputs.AUTH_OK).alias("auth_ok"),
    )
    decided = jobs.simple_chat(asked, inputs.BASE_URL, ALLOWLIST, rag_enabled=True)
    out = jobs.simple_upstream(decided, "prompt_id", _corpus(spark, sf), rules.TOP_K, inputs.EMBED_DIM)
    body = F.try_parse_json("upstream_body")
    content = json_string(body, "$.messages[0].content")
    return out.where(F.col("upstream_body").isNotNull()).select(
        "prompt_id",
        json_string(body, "$.model").alias("model"),
        F.try_variant_get(body, "$.stream", "boolean").alias("stream"),
        json_string(body, "$.messages[0].role").alias("role"),
        F.md5(content).alias("content_md5"),
    )


@query
def simple_rag_gate(spark, sf):
    """Retrieval is on at the simple endpoint, but not on the allowlist."""
    asked = prompts(spark, sf).select("prompt_id", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("model"), F.expr(inputs.AUTH_OK).alias("auth_ok"))
    out = jobs.simple_chat(asked, inputs.BASE_URL, [inputs.BASE_URL], rag_enabled=True)
    return out.groupBy("error.category").agg(F.count("*").alias("prompts"))


@query
def upstream_failures(spark, sf):
    """What clients hear where the upstream model gave no answer."""
    failed = _chat(spark, sf).where(F.col("upstream_failure").isNotNull())
    return failed.select("request_id", "upstream_failure.code", "upstream_failure.type", "upstream_failure.message")


@query
def simple_chat_replies(spark, sf):
    out = jobs.simple_replies(_answers(spark, sf))
    return out.select(
        "request_id",
        "error.code",
        "response",
        chat.response_text(F.col("raw")).alias("raw_content"),
        "redactions",
    )


# --- audit, metrics and latency -------------------------------------------------------------
def _chat(spark: SparkSession, sf: str) -> DataFrame:
    # only replies that were asked for as a stream have chunks to look at
    streaming = _parsed(spark, sf).where(policy.is_streaming(F.col("payload")))
    asked = streaming.select(F.col("prompt_id").alias("stream_id"))
    block = F.expr(f"seq div {streams.BLOCK}")
    sent = join_hot_left(chunks(spark, sf), asked, ["stream_id"], block, how="left_semi")
    ends = streams.stream_ends(sent).select(F.col("stream_id").alias("prompt_id"), "status")
    ends = inputs.with_request_id(ends).select("request_id", "status")
    enriched = jobs.with_retrieval(_decided(spark, sf), _corpus(spark, sf), rules.TOP_K, inputs.EMBED_DIM)
    return jobs.decide_chat(enriched, responses(spark, sf), ends)


@query
def audit_records(spark, sf):
    return audit.audit_records(_chat(spark, sf))


@query
def gateway_counters(spark, sf):
    return audit.counters(_chat(spark, sf))


@query
def prometheus_text(spark, sf):
    return audit.prometheus_lines(audit.counters(_chat(spark, sf)))


@query
def metrics_windows(spark, sf):
    minute = audit.utc_clock(F.window("ts", "1 minute")["start"])
    return audit.counters(_chat(spark, sf).withColumn("window_start", minute), ["window_start"])


@query
def outcome_breakdown(spark, sf):
    return audit.outcome_breakdown(audit.audit_records(_chat(spark, sf)))


@query
def latency_profile(spark, sf):
    events = table(spark, sf, "events")
    samples = events.select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("latency_us"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = (F.max(micros) - F.min(micros)) / 1e6
    durations = events.groupBy("event_type").agg(span.alias("duration_s"))
    out = profile.latency_percentiles(samples, ["event_type"])
    out = profile.with_throughput(out, durations, ["event_type"])
    return out.withColumn("throughput_rps", F.round("throughput_rps", 9)).drop("duration_s")


@query
def latency_sketches(spark, sf):
    """Percentiles per day from sketches of hours, and whether each has about its rank."""
    events = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.substring(audit.utc_clock(ts), 1, 10).alias("day")
    samples = events.select(day, F.date_trunc("hour", ts).alias("hour"), F.round(F.col("value") * 100).cast("bigint").alias("latency_us"))
    hours = profile.latency_sketches(samples, ["day", "hour"])
    days = profile.sketched_percentiles(profile.merged_sketches(hours, ["day"]))
    names = [c for c in days.columns if c.startswith("p")]
    # one pass over the samples, each against the four values of its day
    below = [F.count_if(F.col("latency_us") < F.col(c)).alias(f"{c}_lo") for c in names]
    upto = [F.count_if(F.col("latency_us") <= F.col(c)).alias(f"{c}_hi") for c in names]
    ranks = samples.join(days, "day").groupBy("day").agg(F.first("total").alias("total"), *below, *upto)
    slack = F.greatest(F.lit(1), 0.01 * F.col("total"))
    near = [
        ((F.col(f"{c}_lo") <= p * F.col("total") + slack) & (F.col(f"{c}_hi") >= p * F.col("total") - slack)).alias(f"{c}_near")
        for c, p in zip(names, profile.PERCENTILES)
    ]
    return ranks.select("day", "total", *near)


# --- retrieval --------------------------------------------------------------------------------
def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    return docs.withColumn("embedding", embed_text(F.col("text"), inputs.EMBED_DIM))


def _vectors(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of every label: as many queries as there are labels."""
    parts = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding").alias("i", "x")
    )
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda v: v["x"]).alias("embedding"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


@query
def embed_documents(spark, sf):
    values = F.posexplode("embedding").alias("idx", "x")
    return (
        _corpus(spark, sf)
        .select("doc_id", values)
        .select("doc_id", "idx", F.round("x", 6).alias("x"))
    )


@query
def ingest_documents(spark, sf):
    """Documents as files, ids after those of the pages that are there already."""
    files = _documents(spark, sf).select(
        F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text"
    )
    store = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )
    new = retrieval.ingest(files, store, inputs.EMBED_DIM)
    return new.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.size("embedding").alias("dim"),
    )


@query
def ingest_stream(spark, sf):
    """Documents as a log of files that is ingested in several micro-batches."""
    docs = _documents(spark, sf).select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    folder = job_folder(spark, "ingest")
    for n in range(inputs.LOG_PARTS):
        part = docs.where(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(inputs.LOG_PARTS)) == n)
        part.repartition(inputs.LOG_FILES, "path").write.mode("append").parquet(f"{folder}/files")
    live = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", inputs.LOG_FILES).parquet(f"{folder}/files")
    first = table(spark, sf, "pages").agg(F.coalesce(F.max("page_id") + 1, F.lit(0))).scalar()
    out = ingested(live, f"{folder}/out", inputs.EMBED_DIM, spark.range(1).select(first).head()[0])
    # which ids there are, and that every text is there once with a vector
    return out.select(
        F.count("*").alias("documents"),
        F.count_distinct("doc_id").alias("ids"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
        F.sum(F.size("embedding")).alias("numbers"),
    )


@query
def vector_topk(spark, sf):
    hits = retrieval.vector_topk_few(_centroids(spark, sf), _vectors(spark, sf, "doc_id"), 10)
    return _rounded(hits)


@query
def vector_topk_all(spark, sf):
    vectors = _vectors(spark, sf, "query_id")
    return _rounded(retrieval.vector_topk(vectors, _vectors(spark, sf, "doc_id"), 5))


@query
def vector_topk_lsh(spark, sf):
    vectors = _vectors(spark, sf, "query_id")
    return _rounded(retrieval.vector_topk_lsh(vectors, _vectors(spark, sf, "doc_id"), 64, 5))


@query
def doc_lookup(spark, sf):
    hits = retrieval.vector_topk_few(_centroids(spark, sf), _vectors(spark, sf, "doc_id"), 10)
    found = retrieval.with_texts(hits, _documents(spark, sf))
    return found.select("query_id", "rank", "doc_id", F.md5("text").alias("text_md5"))


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    asked = prompts(spark, sf).select(F.col("prompt_id").alias("query_id"), "text")
    return retrieval.search_text(asked, _corpus(spark, sf), rules.TOP_K, inputs.EMBED_DIM)


@query
def search_text(spark, sf):
    return _rounded(_searched(spark, sf)).drop("text")


@query
def simple_context(spark, sf):
    found = retrieval.contexts(_searched(spark, sf)).withColumnRenamed("query_id", "prompt_id")
    final = retrieval.simple_context(F.col("context"), F.col("text"))
    return (
        prompts(spark, sf)
        .join(found, "prompt_id", "left")
        .select("prompt_id", F.md5(final).alias("prompt_md5"), F.length(final).alias("n_chars"))
    )


@query
def last_user_message(spark, sf):
    scanned = chat.inspect_messages(_parsed(spark, sf).where(F.col("payload").isNotNull()))
    text = chat.last_user_text(F.col("payload"), F.col("sanitized"))
    return scanned.select("request_id", text.alias("text"))


@query
def last_user_turn(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query
def chat_context(spark, sf):
    out = jobs.enrich_requests(
        _decided(spark, sf), _corpus(spark, sf), rules.TOP_K, inputs.EMBED_DIM
    ).where(F.col("upstream_body").isNotNull())
    body = F.try_parse_json("upstream_body")
    return out.select(
        "request_id",
        "rag_retrieval_performed",
        F.size(policy.members(body, "$.messages")).alias("n_messages"),
        json_string(body, "$.messages[0].role").alias("first_role"),
        F.md5(F.coalesce(json_string(body, "$.messages[0].content"), F.lit(""))).alias("first_md5"),
    )


# --- the stateful streaming jobs, run over everything that is there ----------------------------
def _streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.col("chunk").cast("string"))


@query
def stream_output_stateful(spark, sf):
    return _texts(run_available(scan_stream(inputs.chunk_log(spark, sf)), "scan"))


@query
def stream_late_counts(spark, sf):
    """Some chunks come in the last micro-batch, after later ones of their stream."""
    states = run_available(scan_states(inputs.chunk_log(spark, sf, whole=False)), "late")
    return late_counts(states)


@query
def chat_metrics_stream(spark, sf):
    """Requests and replies as two logs that are read file by file, some rows twice,
    joined and counted per minute as they arrive."""
    enriched = jobs.with_retrieval(_decided(spark, sf), _corpus(spark, sf), rules.TOP_K, inputs.EMBED_DIM)
    asked = enriched.select(
        "request_id", "ts", F.struct("error.kind", "error.code").alias("e"), F.col("error").isNull().alias("fine"), "readable",
        "injection_detected", "streaming", "inbound_redactions", "rag_retrieval_performed",
    )
    ends = streams.stream_ends(chunks(spark, sf)).where("status = 'killed'")
    killed = inputs.with_request_id(ends.select(F.col("stream_id").alias("prompt_id"))).select("request_id", F.lit(True).alias("killed"))
    replied = chat.redact_responses(responses(spark, sf)).select(
        "request_id", F.col("status").alias("upstream_status"), "redacted_choices", "upstream_latency_us"
    )
    # a reply comes as long after its request as it took; failures are replies without a status
    came = replied.join(killed, "request_id", "left").join(asked.select("request_id", "ts"), "request_id")
    came = came.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("upstream_latency_us") / 100))
    live, late = inputs.log_of(spark, asked, "requests"), inputs.log_of(spark, came, "replies")
    live = live.withColumn("error", F.when(~F.col("fine"), F.col("e"))).drop("e", "fine")
    done = run_available(counted(live, late), "chat-metrics", empty_batches=True)
    return done.select(audit.utc_clock(F.col("window.start")).alias("window_start"), *[c for c in done.columns if c != "window"])


@query
def rate_limit_stateful(spark, sf):
    events = _streamed(spark, sf, "events").select("event_id", "user_id", "ts")
    limited = rate_limit_stream(events, "user_id", "ts", "event_id", 3, 86400)
    return run_available(limited, "rate").select("event_id", "user_id", "accepted")


@query
def event_metrics_stream(spark, sf):
    """Events as a request log, counted per hour and kind as they arrive."""
    log = _streamed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.window("ts", "1 hour")
    counted = (
        log.withWatermark("ts", "10 minutes")
        .groupBy(hour, "event_type")
        .agg(F.count("*").alias("requests"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("latency_us"))
    )
    start = F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("hour")
    rows = counted.select(start, "event_type", "requests", "latency_us")
    return run_updates(rows, ["hour", "event_type"], "metrics")
