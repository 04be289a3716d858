"""Continuously updated counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.audit import counters


def windowed_counters(
    decided: DataFrame, width: str = "5 seconds", lateness: str = "10 seconds"
) -> DataFrame:
    """Counters per window of event time ``ts``; works on a streaming table of
    decided requests and on a batch one. State is one row per open window. For
    requests and replies that arrive apart, see :func:`textguard.streaming.chat.counted`."""
    timed = decided.withWatermark("ts", lateness) if decided.isStreaming else decided
    return counters(timed.withColumn("window", F.window("ts", width)), ["window"])
