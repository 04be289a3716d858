"""What several operators share: words, hold-out keys, Arrow columns, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in batches of about this many bytes inside a task.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only one machine may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """The same, dealt out by ``key``, so that joins on it don't move the rows again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"textguard_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{table_name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


def ascii_lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.lower().split()


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = pa.large_binary()
    else:
        kind = pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``size`` bytes of ``column``; one
    longer text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(
    df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch, list[bytes]], dict | None]
) -> DataFrame:
    """``work`` gets a batch and its texts as bytes and returns the result columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text):
            texts = byte_texts(part.column(part.schema.get_field_index(text)))
            out = work(part, texts)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def offsets_of(counts: Iterable[int]) -> np.ndarray:
    if isinstance(counts, np.ndarray):
        return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return np.concatenate([[0], np.cumsum(np.fromiter(counts, dtype=np.int64))]).astype(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows between neighbouring offsets; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    bounds = offsets_of(np.asarray(pc.list_value_length(lists)))
    real = np.asarray(pc.binary_length(words)) > 0  # blanks at an end leave an empty word
    counts = segment_sums(real.astype(np.int64), bounds).astype(np.int64)
    return words.filter(pa.array(real)), offsets_of(counts)


def drawn(key: Column, salt: str, n: int, total: int) -> Column:
    """Whether a row is in a sample of about ``n`` of ``total`` rows, by a hash of
    its key: no order over all rows, so no task or driver gathers candidates."""
    steps = 1 << 30
    share = min(steps, int(steps * n / max(1, total)) + 1)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(steps)) < share
