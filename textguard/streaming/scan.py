"""Incremental inspection of streamed responses.

Small keyed states around the column expressions of the batch job: the first
carries the last characters of every stream from batch to batch, the second
remembers which streams were ended; a third, where lines are cut between
chunks, carries the open line. What decides about a chunk runs in between, as
Spark expressions, the same as in the batch job.

State is kept by stream and handled by bucket of streams: one call for each bucket
of a micro-batch, not for each stream.

Time is event time. A state is given up by a timer when the
watermark has passed the last chunk of its stream by ``idle``; a job that is
restarted after a long pause drops nothing that its events do not ask for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textguard import rules
from textguard.functions import sse
from textguard.functions.text import fill
from textguard.operators.streams import flagged, placeless, with_kill

#: A stream without chunks for so long gives up its last characters.
IDLE_MS = 60 * 60 * 1000
#: How far chunks may arrive after later ones of other streams.
LATENESS = "10 minutes"
#: Streams are dealt into so many buckets; state and timers go by bucket. It must not
#: change while a query goes on from its checkpoint.
BUCKETS, BUCKET = 1024, "bucket"
#: Statuses of chunks that came too late to be forwarded.
AFTER_END, OUT_OF_ORDER = "after_end", "out_of_order"
LATE = (AFTER_END, OUT_OF_ORDER)


class _Streams(StatefulProcessor):
    """State by stream, for the streams of one bucket. A call handles all chunks that a
    micro-batch has of its bucket, so what a call costs is shared by many streams."""

    value: str

    def __init__(self, kind: T.DataType):
        self.key = T.StructType([T.StructField("stream_id", kind)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("last", self.key, self.value)

    def ordered(self, rows) -> tuple[pd.DataFrame, np.ndarray, list]:
        """The chunks of the bucket by stream and number, where each stream begins, and
        which it is; the source bounds their size."""
        frame = pd.concat(rows, ignore_index=True).drop(columns=BUCKET)
        frame = frame.sort_values(["stream_id", "seq"], kind="stable", ignore_index=True)
        ids = frame["stream_id"]
        starts = np.flatnonzero(np.r_[True, (ids[1:].to_numpy() != ids[:-1].to_numpy())])
        return frame, starts, ids.iloc[starts].tolist()

    def close(self) -> None:
        pass


class _Idle(_Streams):
    """One value per stream, given up ``idle_ms`` of event time after its last chunk.
    A bucket has one timer, due no later than the first of its streams."""

    def __init__(self, kind: T.DataType, idle_ms: int | None):
        super().__init__(kind)
        self.idle_ms = idle_ms  # None: kept for good

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("last", self.key, f"{self.value}, seq bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, starts, ids = self.ordered(rows)
        now = max(0, timerValues.getCurrentWatermarkInMs()) if self.idle_ms is not None else 0
        if self.idle_ms is None:
            latest = [None] * len(ids)
        else:  # the least number stands for streams without any time
            times = pd.to_datetime(frame["ts"]).to_numpy(dtype="datetime64[ms]").astype("int64")
            none = np.iinfo(np.int64).min
            latest = [None if t == none else t for t in np.maximum.reduceat(times, starts).tolist()]
        columns = [frame[c].tolist() for c in self.reads]
        out, first = [], None
        for stream, lo, hi, at in zip(ids, starts.tolist(), [*starts[1:].tolist(), len(frame)], latest):
            known = self.state.containsKey((stream,))
            *values, last, due = self.state.getValue((stream,)) if known else (*self.begin, None, None)
            values, last = self.carry(values, last, zip(*(c[lo:hi] for c in columns)), out)
            if at is not None:
                # by the latest chunk, not before the watermark
                wanted = max(at, now) + self.idle_ms
                due = wanted if due is None else max(due, wanted)
                first = due if first is None else min(first, due)
            self.state.updateValue((stream,), (*values, last, due))
        if first is not None:
            self.wake(first)
        yield self.result(frame, out)

    def wake(self, due: int) -> None:
        set_for = list(self.handle.listTimers())
        if any(t <= due for t in set_for):
            return
        for t in set_for:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        gone, first = [], None
        for stream, value in self.state.iterator():
            due = value[-1]
            if due is not None and (due <= fired or due < now):
                gone.append(stream)
            elif due is not None:
                first = due if first is None else min(first, due)
        for stream in gone:
            self.state.removeKey(tuple(stream))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())


class CarryTail(_Idle):
    """Adds the last characters of the stream before each chunk, and whether the
    chunk comes after one with a greater number or the same."""

    value, reads, begin = "tail string", ("seq", "deltas", "transport_error"), ("",)

    def __init__(self, kind: T.DataType, window: int, idle_ms: int | None):
        super().__init__(kind, idle_ms)
        self.window = window

    def carry(self, values, last, chunks, out) -> tuple[tuple, int | None]:
        (before,) = values
        for seq, deltas, broken in chunks:
            late = last is not None and seq <= last
            out.append((before, late))
            if late:
                continue
            last = int(seq)
            if deltas is not None and not broken:
                before = (before + "".join(deltas))[-self.window :]
        return (before,), last

    def result(self, frame: pd.DataFrame, out: list) -> pd.DataFrame:
        return frame.assign(tail=[tail for tail, _ in out], late=[late for _, late in out])


def _readable(line: bytes) -> bool:
    """Whether what has arrived of a line is a ``data:`` line that can be read."""
    line = line.strip()
    if not line.startswith(b"data:") or not line.endswith(b"}"):
        return False
    try:
        json.loads(line[5:])
    except ValueError:
        return False
    return True


class CarryLine(_Idle):
    """Adds ``lines``: the text of each chunk behind the open line that the chunks
    before it left. A line that could be read already isn't given again."""

    value, reads, begin = "open binary, done boolean", ("seq", "chunk", "transport_error"), (b"", False)

    def carry(self, values, last, chunks, out) -> tuple[tuple, int | None]:
        begun, done = bytes(values[0]), values[1]
        for seq, chunk, broken in chunks:
            if (last is not None and seq <= last) or broken or chunk is None:
                out.append("")
                continue
            last = int(seq)
            raw = chunk.encode() if isinstance(chunk, str) else bytes(chunk)
            if done:  # the rest of a line that was read
                _, feed, raw = raw.partition(b"\n")
                done = not feed
            text = begun + raw
            out.append(text.decode("utf-8", "replace"))
            begun = b"" if done else text.rpartition(b"\n")[2]
            if _readable(begun):
                begun, done = b"", True
        return (begun, done), last

    def result(self, frame: pd.DataFrame, out: list) -> pd.DataFrame:
        return frame.assign(lines=out)


class CutAfterKill(_Streams):
    """Passes chunks up to the first that ends the stream and marks all later ones.
    An end is kept for good, one flag for each stream that was ended: whatever
    comes later, after any pause, is not forwarded."""

    value = "ended boolean"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, starts, ids = self.ordered(rows)
        ends = frame["status"].isin(("killed", "upstream_error")).to_numpy()
        after = np.zeros(len(frame), dtype=bool)
        for stream, lo, hi in zip(ids, starts, [*starts[1:], len(frame)]):
            if self.state.containsKey((stream,)):
                after[lo:hi] = True
            elif ends[lo:hi].any():
                self.state.updateValue((stream,), (True,))
                after[lo + 1 + int(ends[lo:hi].argmax()) : hi] = True
        frame.loc[after, "status"] = AFTER_END
        frame.loc[after, "chunk"] = None
        yield frame


def _bucketed(df: DataFrame) -> GroupedData:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS))).groupBy(BUCKET)


def _fields(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *more])


def scan_states(
    chunks: DataFrame,
    window: int = rules.STREAM_WINDOW,
    idle_ms: int = IDLE_MS,
    lateness: str = LATENESS,
    whole_lines: bool = False,
) -> DataFrame:
    """Streaming (stream_id, seq, chunk, transport_error[, ts]) to all chunks with
    what became of them (stream_id, seq, status, chunk).

    ``pass``, ``killed`` and ``upstream_error`` are forwarded; ``unscanned`` (no
    stream or number), ``after_end`` and ``out_of_order`` (a chunk with a greater
    or the same number was there before) have a null chunk. ``ts`` is the time of
    the event: with it the last characters of a stream leave the state ``idle_ms``
    after its last chunk, and chunks more than ``lateness`` behind are left out by
    Spark, which counts them. Without ``ts`` they are kept for good.

    Chunks of a stream have to arrive in order of ``seq`` across micro-batches;
    inside one they are sorted. Sources have to bound what a micro-batch holds
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``): the chunks of one bucket of
    streams (of ``BUCKETS``) in one of them meet in memory. With ``whole_lines``, ``chunk`` may be bytes, and
    lines and characters that are cut between chunks are put together.
    """
    kind, stream = chunks.schema["chunk"].dataType, chunks.schema["stream_id"].dataType
    lost = chunks.where(placeless()).select(
        "stream_id", "seq", F.lit("unscanned").alias("status"), F.lit(None).cast(kind).alias("chunk")
    )
    timed = "ts" in chunks.columns
    idle = idle_ms if timed else None
    mode, clock = ("eventTime", "ts") if timed else ("none", "")
    columns = ["stream_id", "seq", "chunk", "transport_error", *(["ts"] if timed else [])]
    rows = flagged(chunks).where(~placeless()).select(*columns)
    if timed:
        rows = rows.withWatermark("ts", lateness)

    def carry(df: DataFrame, processor: StatefulProcessor, *more: T.StructField) -> DataFrame:
        return _bucketed(df).transformWithStateInPandas(
            processor, _fields(df, *more), "append", mode, eventTimeColumnName=clock
        )

    if whole_lines:
        rows = carry(rows, CarryLine(stream, idle), T.StructField("lines", T.StringType()))
        text = F.col("lines")
    else:
        text = F.col("chunk").cast("string")
    parsed = rows.select(*columns, sse.deltas(text).alias("deltas"))
    tailed = carry(
        parsed,
        CarryTail(stream, window, idle),
        T.StructField("tail", T.StringType()),
        T.StructField("late", T.BooleanType()),
    )
    unread = F.col("transport_error") | F.col("late")
    judged = with_kill(tailed.withColumn("deltas", F.when(~unread, F.col("deltas"))), window)
    killed, broken, late = F.col("kill").isNotNull(), F.col("transport_error"), F.col("late")
    frames = judged.select(
        "stream_id",
        "seq",
        F.when(late, OUT_OF_ORDER).when(broken, "upstream_error").when(killed, "killed").otherwise("pass").alias("status"),
        F.when(late | broken, F.lit(None).cast(kind))
        .when(killed, fill(rules.STREAM_ERROR_FRAME, F.col("kill.reason")).cast(kind))
        .otherwise(F.col("chunk"))
        .alias("chunk"),
    )
    sent = _bucketed(frames).transformWithStateInPandas(CutAfterKill(stream), frames.schema, "append", "none")
    return sent.unionByName(lost)


def scan_stream(chunks: DataFrame, *args, **options) -> DataFrame:
    """What :func:`scan_states` forwards, and the chunks that have no place."""
    return scan_states(chunks, *args, **options).where(~F.col("status").isin(*LATE))


def late_counts(states: DataFrame) -> DataFrame:
    """(status, streams, chunks): chunks that came after the end of their stream or
    after a later chunk, from the written rows of :func:`scan_states`."""
    late = states.where(F.col("status").isin(*LATE))
    per_stream = late.groupBy("status", "stream_id").agg(F.count("*").alias("n"))
    return per_stream.groupBy("status").agg(F.count("*").alias("streams"), F.sum("n").alias("chunks"))
