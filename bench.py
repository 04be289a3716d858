"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores, BENCH_RUNS the warm runs (the median counts). Progress goes to
stderr.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from textguard.functions import normalize
from textguard.operators import scanning
from textguard.plans import inputs
from textguard.plans.queries import all_queries
from textguard.session import build_session

HEADLINE = (
    "normalize_documents",
    "document_injection_scan",
    "pii_redact",
    "pii_summary",
    "injection_findings",
    "verdict_mix",
    "simple_prompt_guard",
    "stream_windows",
    "stream_output",
    "request_decisions",
    "rate_limit_by_user",
    "rate_limit_global",
    "vector_topk",
    "vector_topk_all",
    "vector_topk_lsh",
    "embed_documents",
    "audit_records",
    "latency_profile",
)

COPIES = 8


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # regular expressions are bound by the processor, not by bytes
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the given tables are one file each, which one task would read: spread them
    spread = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(x.removesuffix(".parquet") for x in os.listdir(sf) if x.endswith(".parquet")):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{spread}/{name}.parquet")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            run(queries[name](spark, spread))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
        print(f"{name:28s} first {times[0]:.2f}s warm {seconds[name]:.3f}s", file=sys.stderr, flush=True)

    # throughput of the scanners alone: texts in memory, plan built once, every
    # text several times so that the fixed cost of a job does not hide the rate
    docs = inputs.table(spark, spread, "documents").select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
    )
    docs = docs.repartition(4 * int(cpus), "doc_id", "copy").cache()
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).head()
    scans = {
        "normalize_text": normalize.with_normalized(docs),
        "injection_findings": scanning.with_injection(docs),
        "pii_redact": scanning.redact_table(docs),
    }
    throughput = {}
    for name, df in scans.items():
        times = []
        for _ in range(2 + runs):
            start = time.perf_counter()
            run(df)
            times.append(time.perf_counter() - start)
        best = statistics.median(times[2:])
        throughput[name] = {
            "mb_per_s": round(size / 1e6 / best, 1),
            "mb_per_s_per_core": round(size / 1e6 / best / int(cpus), 1),
            "docs_per_s": round(n / best),
        }
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "throughput": throughput,
            }
        )
    )


if __name__ == "__main__":
    main()
