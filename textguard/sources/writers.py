"""Writers. Files are written by the tasks; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.audit import AUDIT_COLUMNS, prometheus_lines


def audit_log(audit: DataFrame, path: str) -> None:
    """Append JSON lines; a missing block reason is left out of its line."""
    audit.select(*AUDIT_COLUMNS).write.mode("append").option("ignoreNullFields", True).json(path)


def append_store(rows: DataFrame, path: str) -> None:
    """Append new documents with ids, texts and vectors as one table."""
    rows.select("doc_id", "text", "embedding").write.mode("append").parquet(path)


def exposition(counts: DataFrame, path: str) -> None:
    """Text exposition of one row of counters, in its fixed order: 30 lines."""
    lines = prometheus_lines(counts).coalesce(1).sortWithinPartitions("pos")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
