"""Explicit schemas of the tables that jobs read and write."""

from __future__ import annotations

REQUESTS = "request_id string, ts timestamp, endpoint string, auth_ok boolean, body string"
RESPONSES = (
    "request_id string, status int, content_type string, body string, upstream_latency_us bigint"
)
SIMPLE_PROMPT = "prompt string, model string"
CHUNKS = "stream_id bigint, seq bigint, ts timestamp, chunk binary, transport_error boolean"
STORE = "doc_id bigint, text string, embedding array<float>"
AUDIT = (
    "timestamp string, request_id string, endpoint string, model string, streaming boolean, "
    "injection_detected boolean, pii_redacted boolean, pii_findings_count bigint, "
    "stream_killed boolean, rag_retrieval_performed boolean, upstream_latency_us bigint, "
    "scan_latency_us bigint, outcome string, block_reason string"
)
