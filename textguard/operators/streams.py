"""Inspection of streamed responses over chunk tables.

Input rows are (stream_id, seq, chunk, transport_error); ``seq`` is a bigint,
unique within its stream. A phrase or key may straddle chunks, so every delta
is scanned together with the last 200 characters before it.

A stream may hold a large share of all rows. Streams are therefore cut into
blocks of ``BLOCK`` sequence numbers, the unit of every window; only the last
200 characters of each block travel on to the next ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import injection, pii, sse
from textguard.functions.normalize import with_normalized_each
from textguard.functions.text import evaluate, fill, let
from textguard.operators.skew import join_hot_left

BLOCK = 4096


def last_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def _text_before(
    df: DataFrame, keys: Sequence[str], seq: str, text: Column, out: str, window: int
) -> DataFrame:
    """Last ``window`` characters before each row, within ``keys``.

    Each row adds at most ``window`` characters, so every row that matters
    starts within two windows before the current one: a range frame over the
    running length, not over all earlier rows.
    """
    ordered = Window.partitionBy(*keys).orderBy(seq)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy(*keys).orderBy("_pos").rangeBetween(-2 * window, -1)
    return (
        df.withColumn("_piece", last_chars(text, window))
        .withColumn("_pos", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
        .withColumn(out, last_chars(F.array_join(F.collect_list("_piece").over(near), ""), window))
        .drop("_piece", "_pos")
    )


def with_tail(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    text: Column,
    out: str = "tail",
    window: int = rules.STREAM_WINDOW,
    block: int = BLOCK,
    levels: int = 1,
) -> DataFrame:
    """Add the last ``window`` characters of all earlier text of the stream.

    One pass inside blocks; then the block ends (one short row per block) get
    their own tails over whole streams. ``levels`` adds blocks of blocks, for
    streams so long that even one row per block is too much for one task.
    """
    if levels == 0:
        return _text_before(df, keys, seq, text, out, window)
    level, before, end, carry = (f"_{n}{levels}" for n in ("block", "before", "end", "carry"))
    blocked = df.withColumn(level, F.expr(f"{seq} div {block}"))
    # The shuffled rows are used twice, and it is one exchange if both uses need
    # the same rows and columns: so ``text`` is evaluated after the shuffle, and
    # the null filters that the join adds on one side are there on both.
    for key in (*keys, level):
        blocked = blocked.where(F.col(key).isNotNull())
    blocked = blocked.repartition(*keys, level)
    local = _text_before(blocked, [*keys, level], seq, text, before, window)
    ends = local.groupBy(*keys, level).agg(
        F.max_by(last_chars(F.concat(before, text), window), seq).alias(end)
    )
    carried = with_tail(ends, keys, level, F.col(end), carry, window, block, levels - 1).drop(end)
    joined = local.join(carried, [*keys, level])
    return joined.withColumn(out, last_chars(F.concat(carry, before), window)).drop(
        carry, before, level
    )


def flagged(chunks: DataFrame) -> DataFrame:
    """The chunks with ``transport_error`` never null: an unknown flag is no error,
    so such a chunk is scanned like any other."""
    return chunks.withColumn("transport_error", F.coalesce("transport_error", F.lit(False)))


def placeless() -> Column:
    """Chunks without a stream or a number have no place in any window. They can't
    be scanned and are never forwarded."""
    return F.col("stream_id").isNull() | F.col("seq").isNull()


def with_lines_before(df: DataFrame, keys: Sequence[str], seq: str, count: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Add the sum of ``count`` over all earlier rows of ``keys``: inside blocks,
    and over the block sums, which are one short row each."""
    blocked = df.withColumn("_block", F.expr(f"{seq} div {block}")).withColumn("_count", count)
    earlier = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_inside", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(F.sum("_count").alias("_sum"))
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(blocks), F.lit(0))).drop("_sum")
    return (
        local.join(sums, [*keys, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_earlier"))
        .drop("_block", "_count", "_inside", "_earlier")
    )


def whole_line_deltas(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, seq, deltas) where lines are cut between chunks anywhere, also
    inside a character. A line belongs to the last chunk that adds to it: there it
    can be read for the first time.

    Lines inside a chunk stay in their row. Only the two pieces at the borders of
    a chunk are shuffled, by the number of their line within the stream.
    """
    # one character for every byte, so that bytes can be cut and put together as text
    wire = F.decode(F.col("chunk").cast("binary"), "ISO-8859-1")
    rows = flagged(chunks).where(~placeless() & ~F.col("transport_error") & F.col("chunk").isNotNull())
    rows = evaluate(rows.select("stream_id", "seq", wire.alias("wire")), "parts", F.split("wire", "\n", -1)).drop("wire")
    feeds = (F.size("parts") - 1).cast("bigint")
    rows = with_lines_before(rows, ["stream_id"], "seq", feeds, "before", block)
    inner = rows.select(
        "stream_id", "seq", F.posexplode(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))).alias("at", "text")
    )

    def piece(line: Column, text: Column, at: Column) -> Column:
        return F.struct(line.cast("bigint").alias("line"), text.alias("text"), at.cast("int").alias("at"))

    first = F.array(piece(F.col("before"), F.get("parts", F.lit(0)), F.lit(-1)))
    end = F.array(piece(F.col("before") + feeds, F.element_at("parts", -1), feeds))
    pieces = F.when(feeds > 0, F.concat(first, end)).otherwise(first)
    borders = rows.select("stream_id", "seq", F.explode(pieces).alias("p")).where(
        F.regexp_replace("p.text", r"\s", "") != ""
    )
    joined = borders.groupBy("stream_id", "p.line").agg(
        F.array_sort(F.collect_list(F.struct("seq", "p.at", "p.text"))).alias("pieces")
    )
    last = F.element_at("pieces", -1)
    cut = joined.select(
        "stream_id",
        last["seq"].alias("seq"),
        last["at"].alias("at"),
        F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"),
    )
    lines = inner.select("stream_id", "seq", "at", "text").unionByName(cut).where(F.contains("text", F.lit("data:")))
    text = F.make_valid_utf8(F.encode("text", "ISO-8859-1").cast("string"))
    read = evaluate(lines, "delta", sse.delta_of_line(text)).where(F.col("delta").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("at", "delta")))
    return read.groupBy("stream_id", "seq").agg(F.transform(ordered, lambda x: x["delta"]).alias("deltas"))


def parsed_chunks(chunks: DataFrame, whole_lines: bool = False) -> DataFrame:
    """(stream_id, seq, deltas) of the chunks that can be read."""
    if whole_lines:
        return whole_line_deltas(chunks)
    return flagged(chunks).where(~F.col("transport_error")).select(
        "stream_id", "seq", sse.deltas(F.col("chunk")).alias("deltas")
    )


def chunk_deltas(chunks: DataFrame, whole_lines: bool = False) -> DataFrame:
    """(stream_id, seq, line, delta): the content deltas of every chunk."""
    return parsed_chunks(chunks, whole_lines).select(
        "stream_id", "seq", F.posexplode("deltas").alias("line", "delta")
    )


def chunk_tails(
    chunks: DataFrame, window: int = rules.STREAM_WINDOW, whole_lines: bool = False
) -> DataFrame:
    """(stream_id, seq, deltas, tail) of the chunks that have deltas. A chunk is
    judged by itself; with ``whole_lines``, together with the line it goes on."""
    parsed = parsed_chunks(chunks, whole_lines).where(F.size("deltas") > 0)
    text = F.array_join("deltas", "")
    return with_tail(parsed, ["stream_id"], "seq", text, "tail", window)


def delta_windows(chunks: DataFrame, window: int = rules.STREAM_WINDOW) -> DataFrame:
    """(stream_id, seq, line, scan): every delta with its scan text."""
    scans = F.posexplode(scan_windows(F.col("tail"), F.col("deltas"), window)).alias("line", "scan")
    return chunk_tails(chunks, window).select("stream_id", "seq", scans)


def scan_windows(
    tail: Column, deltas: Column, window: int = rules.STREAM_WINDOW
) -> Column:
    """Scan text of every delta of a chunk: the characters before it and itself."""
    def scan(delta: Column, i: Column) -> Column:
        earlier = F.array_join(F.slice(deltas, F.lit(1), i), "")
        return F.concat(last_chars(F.concat(tail, earlier), window), delta)

    return F.transform(deltas, scan)


def with_kill(chunks: DataFrame, window: int = rules.STREAM_WINDOW) -> DataFrame:
    """Add ``kill``, struct<line, reason, category>, to chunk rows with ``tail``
    and ``deltas``: the first delta that must end the stream, else null.

    Secrets come first; other personal data does not stop a stream. A chunk is
    judged inside its row, so the batch and the streaming job share this.
    """
    df = evaluate(chunks, "_scans", scan_windows(F.col("tail"), F.col("deltas"), window))
    df = with_normalized_each(df, "_scans", "_normalized")
    parts = F.arrays_zip(
        F.col("deltas").alias("d"), F.col("_scans").alias("t"), F.col("_normalized").alias("n")
    )

    def judge(part: Column, line: Column) -> Column:
        attack = injection.injection_verdict(injection.injection_findings(part["t"], part["n"]))
        secret = pii.has_secret(pii.pii_spans(part["t"]))

        def kill(reason: Column, category: Column) -> Column:
            return F.struct(line.alias("line"), reason.alias("reason"), category.alias("category"))

        found = let(
            attack,
            lambda a: F.when(a["action"] == "Block", kill(a["reason"], a["category"])),
        )
        leak = kill(F.lit(rules.REASON_SECRET), F.lit(rules.SECRET_LEAK))
        return F.when(part["d"] != "", F.when(secret, leak).otherwise(found))

    kills = F.filter(F.transform(parts, judge), lambda k: k.isNotNull())
    df = evaluate(df, "kill", F.try_element_at(kills, F.lit(1)))
    return df.drop("_scans", "_normalized")


def stream_ends(
    chunks: DataFrame, window: int = rules.STREAM_WINDOW, whole_lines: bool = False
) -> DataFrame:
    """(stream_id, end_seq, end_line, status, reason, category): where a stream
    was cut, by a kill or by a transport error. Complete streams have no row.
    Chunks without a place can't end a stream, nor hide where another one ended it."""
    chunks = flagged(chunks).where(~placeless())
    judged = with_kill(chunk_tails(chunks, window, whole_lines), window).where(F.col("kill").isNotNull())
    kills = judged.select(
        "stream_id",
        F.struct(
            "seq", "kill.line", F.lit("killed").alias("status"), "kill.reason", "kill.category"
        ).alias("end"),
    )
    null = F.lit(None).cast("string")
    errors = chunks.where("transport_error").select(
        "stream_id",
        F.struct(
            "seq",
            F.lit(-1).alias("line"),
            F.lit("upstream_error").alias("status"),
            null.alias("reason"),
            null.alias("category"),
        ).alias("end"),
    )
    first = kills.unionByName(errors).groupBy("stream_id").agg(F.min("end").alias("end"))
    return first.select(
        "stream_id",
        F.col("end.seq").alias("end_seq"),
        F.col("end.line").alias("end_line"),
        "end.status",
        "end.reason",
        "end.category",
    )


def _with_end(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Attach the end of its stream to every row, hot streams spread out."""
    return join_hot_left(rows, ends, ["stream_id"], F.expr(f"seq div {BLOCK}"))


def stream_decisions(chunks: DataFrame, window: int = rules.STREAM_WINDOW) -> DataFrame:
    """Decision for every delta; deltas after a kill count as terminated, and so
    do those of chunks without a stream or a number."""
    ends = stream_ends(chunks, window).where("status = 'killed'")
    rows = _with_end(chunk_deltas(chunks), ends)
    here = F.struct("seq", "line")
    end = F.struct(F.col("end_seq").alias("seq"), F.col("end_line").alias("line"))
    ended = F.col("end_seq").isNotNull()
    at = F.coalesce(ended & (here == end), F.lit(False))
    after = placeless() | (ended & (here > end))
    return rows.select(
        "stream_id",
        "seq",
        "line",
        F.when(at | after, "Kill").otherwise("Pass").alias("decision"),
        F.when(at, F.col("reason")).when(after, rules.REASON_TERMINATED).alias("reason"),
        F.when(at, F.col("category")).when(after, rules.SECRET_LEAK).alias("category"),
    )


def stream_output(
    chunks: DataFrame, window: int = rules.STREAM_WINDOW, whole_lines: bool = False
) -> DataFrame:
    """(stream_id, seq, status, chunk) as forwarded to the client: untouched
    chunks up to the end, one error frame in place of the killing chunk, a null
    chunk for a transport error, nothing after that. Chunks without a stream or a
    number come out with status ``unscanned`` and a null chunk. With ``whole_lines``
    ``chunk`` may be bytes, and lines cut between chunks are read whole."""
    kind = chunks.schema["chunk"].dataType
    lost = chunks.where(placeless()).select(
        "stream_id", "seq", F.lit("unscanned").alias("status"), F.lit(None).cast(kind).alias("chunk")
    )
    rows = _with_end(chunks.where(~placeless()), stream_ends(chunks, window, whole_lines))
    at = F.col("seq") == F.col("end_seq")
    frame = fill(rules.STREAM_ERROR_FRAME, F.col("reason"))
    sent = rows.where(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))).select(
        "stream_id",
        "seq",
        F.when(at, F.col("status")).otherwise("pass").alias("status"),
        F.when(~F.coalesce(at, F.lit(False)), F.col("chunk"))
        .when(F.col("status") == "killed", frame.cast(kind))
        .alias("chunk"),
    )
    return sent.unionByName(lost)


def stream_summary(chunks: DataFrame, window: int = rules.STREAM_WINDOW) -> DataFrame:
    """(status, category, streams): how streams ended. Only ended streams are
    scanned for; the total comes from one map-side combined count."""
    ended = stream_ends(chunks, window).groupBy("status", "category").agg(F.count("*").alias("n"))
    streams = chunks.groupBy("stream_id").agg(F.lit(1).alias("one")).groupBy().count()
    total = streams.select(
        F.lit("completed").alias("status"), F.lit(None).cast("string").alias("category"), "count"
    ).toDF("status", "category", "n")
    both = ended.unionByName(total)
    n_ended = F.sum(F.when(F.col("status") != "completed", F.col("n")).otherwise(0)).over(
        Window.partitionBy()
    )
    return both.select(
        "status",
        "category",
        F.when(F.col("status") == "completed", F.col("n") - n_ended)
        .otherwise(F.col("n"))
        .alias("streams"),
    )
