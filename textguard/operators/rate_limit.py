"""Sliding-log rate limiting over event tables.

A request is accepted if fewer than ``limit`` requests of its key were accepted
in the window before it; rejected requests do not count. That is sequential by
nature, but only where traffic is dense: time is cut into cells of one window,
and where a cell and the one before it hold at most ``limit`` requests, all of
them are accepted whatever came earlier. Only runs of dense cells are walked in
order, each on its own, starting from the requests of the sparse cell before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard import rules


def accept_in_order(times: np.ndarray, log: deque, limit: int, window: int) -> np.ndarray:
    """Decisions for sorted ``times``; ``log`` holds the accepted times of the
    last window and is carried from one batch to the next."""
    accepted = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        now = times[i]
        while log and now - log[0] >= window:
            log.popleft()
        if len(log) < limit:
            accepted[i] = True
            log.append(now)
            i += 1
        else:
            # nothing is accepted before the oldest entry leaves the window
            i = int(np.searchsorted(times, log[0] + window, side="left"))
    return accepted


def rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int = rules.RATE_LIMIT,
    window_seconds: int = rules.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Add ``accepted``. ``order`` is unique and breaks ties of ``ts``. A request
    without a time has no place in any window and is not accepted."""
    window = window_seconds * 1_000_000
    # rows without a key share one: a text that is never null takes its place
    named = F.concat(F.lit("k"), F.col(key).cast("string"))
    timed = F.col(ts).cast("timestamp").isNotNull()
    timeless = events.where(~timed).select(*events.columns, F.lit(False).alias("accepted"))
    rows = (
        events.where(timed)
        .withColumn("_key", F.coalesce(named, F.lit("none")))
        .withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("_cell", F.floor(F.col("_t") / F.lit(window)).cast("long"))
    )

    # per key at most one row for each window of the time covered
    per_key = Window.partitionBy("_key").orderBy("_cell")
    cells = (
        rows.groupBy("_key", "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_joined", F.coalesce(F.col("_cell") - F.lag("_cell").over(per_key) == 1, F.lit(False)))
        .withColumn("_before", F.when(F.col("_joined"), F.lag("_n").over(per_key)).otherwise(0))
        .withColumn("_dense", F.col("_n") + F.col("_before") > limit)
        .withColumn(
            "_starts",
            F.col("_dense") & ~(F.col("_joined") & F.coalesce(F.lag("_dense").over(per_key), F.lit(False))),
        )
        .withColumn("_run", F.sum(F.col("_starts").cast("int")).over(per_key))
        .withColumn(
            "_leads",
            ~F.col("_dense")
            & F.coalesce(
                (F.lead("_cell").over(per_key) - F.col("_cell") == 1) & F.lead("_dense").over(per_key),
                F.lit(False),
            ),
        )
        .select(
            "_key",
            "_cell",
            "_dense",
            # a sparse cell right before a run is walked along with it
            F.when(F.col("_dense"), F.col("_run")).when(F.col("_leads"), F.col("_run") + 1).alias("_run"),
        )
    )
    labelled = rows.join(cells, ["_key", "_cell"])
    columns = list(events.columns)
    sparse = labelled.where(F.col("_run").isNull()).select(*columns, F.lit(True).alias("accepted"))

    # of requests of one time the first by ``order`` are accepted, ``limit`` at most: how
    # many is all that has to be found in order, from one short row for each time
    place = Window.partitionBy("_key", "_run", "_t").orderBy(order)
    crowded = labelled.where(F.col("_run").isNotNull()).select(*columns, "_key", "_run", "_t")
    walked = crowded.groupBy("_key", "_run", "_t").agg(F.least(F.count("*"), F.lit(limit)).alias("_n"))
    schema = "_key string, _run bigint, _t bigint, _accepted bigint"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, deque()
        for batch in batches:
            keys, runs, times, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_run", "_t", "_n"))
            at = np.r_[0, np.cumsum(counts)]
            each = np.repeat(times, counts)
            total = np.zeros(len(each) + 1, dtype=np.int64)
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(times)]):
                if hi > lo:
                    if (keys[lo], runs[lo]) != current:
                        current, log = (keys[lo], runs[lo]), deque()
                    accepted = accept_in_order(each[at[lo] : at[hi]], log, limit, window)
                    total[at[lo] + 1 : at[hi] + 1] = accepted
            total = np.cumsum(total)
            accepted = pa.array(total[at[1:]] - total[at[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], accepted], ["_key", "_run", "_t", "_accepted"])

    # batches stream through: a task keeps ``limit`` times, never a whole run
    decided = walked.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_t").mapInArrow(walk, schema)
    dense = (
        crowded.withColumn("_place", F.row_number().over(place))
        .join(decided, ["_key", "_run", "_t"])
        .select(*columns, (F.col("_place") <= F.col("_accepted")).alias("accepted"))
    )
    return sparse.unionByName(dense).unionByName(timeless)
