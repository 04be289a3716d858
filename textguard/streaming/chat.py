"""Chat requests and their replies as two streams, joined as they arrive.

A reply belongs to the request of its id and comes within ``answer`` of it.
Watermarks on both sides bound what waits for its other half; a request that
got no reply in time leaves the join without one, and is then decided like one
whose upstream failed. Requests and replies that are delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.audit import counters

#: How long a reply may take, and how far both streams may be out of order.
ANSWER, LATENESS = "10 minutes", "1 minute"


def paired(
    decided: DataFrame, replies: DataFrame, answer: str = ANSWER, lateness: str = LATENESS
) -> DataFrame:
    """decided(request_id, ts, ...) with the columns of its reply in
    replies(request_id, ts, ...), null where none came in time. Works on streams
    and on tables. Rows without an id or a time are no part of a stream's join."""
    named = F.col("request_id").isNotNull() & F.col("ts").isNotNull()
    asked = decided.where(named)
    came = replies.where(named).withColumnRenamed("request_id", "_reply_id").withColumnRenamed("ts", "_reply_ts")
    if decided.isStreaming:
        asked = asked.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])
        came = came.withWatermark("_reply_ts", lateness).dropDuplicatesWithinWatermark(["_reply_id"])
    else:
        asked, came = asked.dropDuplicates(["request_id"]), came.dropDuplicates(["_reply_id"])
    wait = F.expr(f"INTERVAL {answer}")
    inside = (F.col("_reply_ts") >= F.col("ts")) & (F.col("_reply_ts") <= F.col("ts") + wait)
    return asked.join(came, (F.col("request_id") == F.col("_reply_id")) & inside, "leftOuter").drop(
        "_reply_id", "_reply_ts"
    )


def outcomes(rows: DataFrame) -> DataFrame:
    """The columns that counters need, from :func:`paired` requests.

    ``decided`` brings error, readable, injection_detected, streaming,
    inbound_redactions and rag_retrieval_performed; the reply upstream_status,
    redacted_choices, upstream_latency_us and killed (of its stream)."""
    reached, whole = F.col("error").isNull(), ~F.coalesce("streaming", F.lit(False))
    answered = F.coalesce(F.col("upstream_status").between(200, 299), F.lit(False))
    silent = reached & F.col("upstream_status").isNull()
    return (
        rows.withColumn("reached_upstream", reached)
        .withColumn("upstream_error", F.when(silent, F.lit("no answer")))
        .withColumn("upstream_latency_us", F.when(reached, F.coalesce("upstream_latency_us", F.lit(0))).otherwise(0))
        .withColumn("redacted_choices", F.when(reached & whole, F.coalesce("redacted_choices", F.lit(0))).otherwise(0))
        .withColumn("stream_killed", reached & ~whole & answered & F.coalesce("killed", F.lit(False)))
    )


def counted(
    decided: DataFrame,
    replies: DataFrame,
    width: str = "1 minute",
    answer: str = ANSWER,
    lateness: str = LATENESS,
) -> DataFrame:
    """Counters per window of the time of requests. On streams, a window comes
    out once: when no reply can change it any more."""
    rows = outcomes(paired(decided, replies, answer, lateness))
    return counters(rows.withColumn("window", F.window("ts", width)), ["window"])
