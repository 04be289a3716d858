"""Sliding-log rate limiting of an event stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textguard import rules
from textguard.operators.rate_limit import accept_in_order

#: How far events may arrive after later ones.
LATENESS = "10 minutes"


class SlidingLog(StatefulProcessor):
    """Keeps the accepted times of the last window of every key, as a list, and a
    timer for when the watermark has left them behind: then the key has no state."""

    def __init__(self, order: str, limit: int, window: int):
        self.order, self.limit, self.window = order, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "accepted bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = deque(t for (t,) in self.log.get())
        frames = list(rows)
        # the order of events, without a copy of all columns
        times = np.concatenate([f["event_us"].to_numpy() for f in frames])
        ties = pd.concat([f[self.order] for f in frames], ignore_index=True).rank(method="first").to_numpy()
        order = np.lexsort((ties, times))
        accepted = np.empty(len(times), dtype=bool)
        accepted[order] = accept_in_order(times[order], log, self.limit, self.window)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if log:
            self.log.put([(int(t),) for t in log])
            # in whole milliseconds, rounded up: from then on none of them counts
            self.handle.registerTimer(-(-(log[-1] + self.window) // 1000))
        else:
            self.log.clear()
        at = 0
        for f in frames:
            yield f.assign(accepted=accepted[at : at + len(f)])
            at += len(f)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int = rules.RATE_LIMIT,
    window_seconds: int = rules.RATE_WINDOW_SECONDS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming form of :func:`textguard.operators.rate_limit.rate_limit`.

    Events of a key arrive in order of time across micro-batches; sources have to
    bound what a micro-batch holds. Time is that of the events: a key keeps at most
    ``limit`` times, and none once the watermark, ``lateness`` behind the latest
    event, has passed its window. Events behind the watermark are left out by
    Spark, which counts them, as are those of 1970 and before. Events without a time
    are not accepted.
    """
    timed = F.col(ts).cast("timestamp").isNotNull()
    timeless = events.where(~timed).select(*events.columns, F.lit(False).alias("accepted"))
    rows = events.where(timed).withColumn("event_time", F.col(ts).cast("timestamp"))
    rows = rows.withColumn("event_us", F.unix_micros("event_time")).withWatermark("event_time", lateness)
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    processor = SlidingLog(order, limit, window_seconds * 1_000_000)
    decided = rows.groupBy(key).transformWithStateInPandas(
        processor, schema, "append", "eventTime", eventTimeColumnName="event_time"
    )
    return decided.drop("event_us", "event_time").unionByName(timeless)
