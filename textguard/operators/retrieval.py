"""Corpus ingestion, nearest-neighbour search and prompt enrichment.

Queries are (query_id, embedding), a corpus is (doc_id, embedding[, text]).
Distances are computed block against block with numpy inside tasks and only
the k nearest of a block leave it, so no table of pairs is ever built.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.embed import (
    NearestRows,
    bucket_codes,
    embed_text,
    hash_planes,
    unit_rows,
)
from textguard.functions.text import fill
from textguard.session import checkpoint_dir

STEP = 4096  # corpus rows per matrix product
BLOCK_ROWS = 1 << 16  # of each side of a bucket that meet in one task
BLOCK_BYTES = 8 << 20  # vectors that are written as one row where all meet all


# --- corpus ---------------------------------------------------------------------
def assign_ids(files: DataFrame) -> DataFrame:
    """Give files(path, ...) consecutive ids in a fixed order without sorting
    them in one task: count per hash bucket, then number inside the bucket."""
    hashed = files.withColumn("_bucket", F.substring(F.md5("path"), 1, 3))
    per_bucket = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # 4096 buckets at most
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(per_bucket), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("path")) - 1
    return (
        hashed.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn("doc_id", F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def embed_corpus(docs: DataFrame, dim: int = rules.VECTOR_DIM) -> DataFrame:
    """(doc_id, text, embedding)."""
    return docs.select(
        "doc_id", "text", embed_text(F.col("text"), dim).cast("array<float>").alias("embedding")
    )


def ingest(
    files: DataFrame, store: DataFrame, dim: int = rules.VECTOR_DIM, dedup: bool = False
) -> DataFrame:
    """New rows for the store from files(path, text). Ids go on after the
    largest one in the store. ``dedup`` leaves texts out that it already has."""
    if dedup:
        known = store.select(F.xxhash64("text").alias("_h"), "text")
        new = files.withColumn("_h", F.xxhash64("text"))
        files = new.join(known, ["_h", "text"], "left_anti").drop("_h")
    next_id = store.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).scalar()
    numbered = assign_ids(files).withColumn("doc_id", F.col("doc_id") + next_id)
    return embed_corpus(numbered.select("doc_id", "text"), dim)


# --- nearest neighbours ---------------------------------------------------------------
def pairs_schema(queries: DataFrame) -> str:
    """Query ids may be of any type, document ids are numbers."""
    id_type = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {id_type}, doc_id bigint, distance double"


def _check_dim(df: DataFrame, dim: int | None) -> DataFrame:
    if dim is None:
        return df
    wrong = F.size("embedding") != dim
    message = F.format_string("embedding has %d numbers, not " + str(dim), F.size("embedding"))
    return df.withColumn(
        "embedding", F.when(wrong, F.raise_error(message)).otherwise(F.col("embedding"))
    )


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False)))


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    """Final k per query from the k of every block."""
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan_topk(
    corpus: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, schema: str
) -> DataFrame:
    """Few queries: every task keeps its k nearest while it streams the corpus."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = NearestRows(queries, k)
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.iloc[lo : lo + STEP]
                best.add(part["doc_id"].to_numpy(), unit_rows(part["embedding"]))
        yield pd.DataFrame({"query_id": ids[best.rows], "doc_id": best.ids, "distance": best.dist})

    return corpus.select("doc_id", "embedding").mapInPandas(scan, schema)


def _grid_topk(queries: DataFrame, corpus: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Many queries: inside every group both sides are cut into blocks of about
    ``BLOCK_ROWS`` rows and every pair of blocks is one small task unit, however
    large the group. Rows are copied once per block of the other side."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name)
        return df.groupBy(*groups).agg(n)

    # one row per group: at most tables x 2^bits of them
    sizes = F.broadcast(blocks(queries, "_nq").join(blocks(corpus, "_nc"), groups))
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    cell = [*groups, "_i", "_j"]
    left = (
        queries.join(sizes, groups)
        .withColumn("_i", own("query_id", "_nq"))
        .withColumn("_j", everyone("_nc"))
        .select(*cell, "query_id", "embedding")
    )
    right = (
        corpus.join(sizes, groups)
        .withColumn("_j", own("doc_id", "_nc"))
        .withColumn("_i", everyone("_nq"))
        .select(*cell, "doc_id", "embedding")
    )

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        out = []
        corpus_rows, doc_ids = unit_rows(c["embedding"]), c["doc_id"].to_numpy()
        for lo in range(0, len(q), STEP):
            part = q.iloc[lo : lo + STEP]
            best = NearestRows(unit_rows(part["embedding"]), k)
            for at in range(0, len(c), STEP):
                best.add(doc_ids[at : at + STEP], corpus_rows[at : at + STEP])
            ids = part["query_id"].to_numpy()[best.rows]
            out.append(pd.DataFrame({"query_id": ids, "doc_id": best.ids, "distance": best.dist}))
        return pd.concat(out)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        nearest, pairs_schema(queries)
    )


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int = rules.TOP_K, dim: int | None = None
) -> DataFrame:
    """Exact (query_id, doc_id, distance, rank): the k nearest by cosine
    distance, ties by doc_id. Fewer than k if the corpus is smaller. Queries meet
    the corpus block by block; the vectors of both are written to the shared folder
    while the plan is built. Rows whose vector is null or holds a null take no part."""
    queries, corpus = _check_dim(queries, dim), _check_dim(corpus, dim)
    if k <= 0:
        return _empty_topk(queries)
    # of equally near rows those without an id are taken last, whatever part they are in
    order = Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("doc_id"))
    pairs = vector_pairs(queries, corpus, k).withColumn("_place", F.row_number().over(order))
    return _rank(pairs.where(F.col("_place") <= k).drop("_place"), k)


def vector_topk_few(
    queries: DataFrame, corpus: DataFrame, k: int = rules.TOP_K, dim: int | None = None
) -> DataFrame:
    """The same for query sets known to be small: they go to the tasks that scan
    the corpus, which is not shuffled. More than ``STEP`` queries are an error."""
    queries, corpus = _usable(_check_dim(queries, dim)), _usable(_check_dim(corpus, dim))
    if k <= 0:
        return _empty_topk(queries)
    few = queries.select("query_id", "embedding").limit(STEP + 1).toPandas()
    if len(few) > STEP:
        raise ValueError(f"more than {STEP} queries: use vector_topk")
    if not len(few):
        return _empty_topk(queries)
    ids, vectors = few["query_id"].to_numpy(), unit_rows(few["embedding"])
    return _rank(_scan_topk(corpus, ids, vectors, k, pairs_schema(queries)), k)


def _blocks(df: DataFrame, key: str) -> DataFrame:
    """(key: array, rows: binary): vectors of length one, about ``BLOCK_BYTES`` of them in
    a row, as a table in the shared folder, so that they are made once. Vectors that are
    null or hold a null stay out; here, as a filter makes Spark compute them again."""
    spark, id_type = df.sparkSession, df.schema[key].dataType.simpleString()

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(batch.column(1).is_valid())
        holes = np.asarray(batch.column(1).flatten().is_null())
        if not holes.any():
            return batch
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(1)), dtype=np.int64))
        until = np.concatenate([[0], np.cumsum(holes)])[ends]
        return batch.filter(pa.array(until == np.concatenate([[0], until[:-1]])))

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        sizes, numbers = pc.list_value_length(block.column(1)).to_numpy(), block.column(1).flatten()
        if (sizes != sizes[0]).any():
            raise ValueError("embeddings differ in their number of numbers")
        matrix = unit_rows(numbers.to_numpy().reshape(len(sizes), sizes[0]))
        ids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), block.column(0))
        return pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()])], [key, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in map(whole, batches):
            while batch.num_rows:
                if not held:
                    room = max(1, BLOCK_BYTES // max(8, 8 * len(batch.column(1)[0])))
                held.append(batch.slice(0, room))
                room -= held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if not room:
                    yield joined(held)
                    held = []
        if held:
            yield joined(held)

    folder = f"{checkpoint_dir(spark)}/textguard-vectors-{uuid.uuid4().hex}"
    made = df.select(key, "embedding").mapInArrow(run, f"{key} array<{id_type}>, rows binary")
    # row groups of one block or few: a reader holds a whole one
    sizes = {"parquet.block.size": BLOCK_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    made.write.options(**sizes).parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def _matrix(rows: pa.Scalar, n: int) -> np.ndarray:
    numbers = np.frombuffer(rows.as_buffer(), dtype=np.float64)
    return numbers.reshape(n, len(numbers) // n)


def vector_pairs(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, distance): the k nearest of each part of the corpus. Parts of
    both tables meet in a cartesian product that reads them where they were written, so
    nothing is copied for each block of the other side. Tables of one block each meet in
    one task."""
    left, right = _blocks(queries, "query_id"), _blocks(corpus, "doc_id")
    size = F.coalesce(F.sum(F.length("rows")), F.lit(0))
    if all(blocks.select(size).head()[0] <= BLOCK_BYTES for blocks in (left, right)):
        one = F.lit(0).alias("_g")
        sides = (_usable(df).select(one, key, "embedding") for df, key in ((queries, "query_id"), (corpus, "doc_id")))
        return _grid_topk(*sides, ["_g"], k)
    left = left.withColumn("block", F.monotonically_increasing_id())
    right = right.withColumnRenamed("rows", "others")
    nameless = np.iinfo(np.int64).max  # the last of equally near ones

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, own, lost = None, None, None, False

        def out() -> pa.RecordBatch:
            found = best.ids.astype(np.int64)
            docs = pa.array(found, mask=(found == nameless) if lost else None)
            columns = [own.take(pa.array(best.rows)), docs, pa.array(best.dist, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "distance"])

        for batch in batches:
            for n in range(batch.num_rows):
                ids, rows, number, docs, others = (column[n] for column in batch.columns)
                if number.as_py() != block:  # all blocks of the corpus come for one of queries
                    if best is not None:
                        yield out()
                    block, own = number.as_py(), ids.values
                    best = NearestRows(_matrix(rows, len(own)), k)
                lost = lost or docs.values.null_count > 0
                doc_ids = pc.fill_null(docs.values.cast(pa.int64()), nameless).to_numpy()
                corpus_rows = _matrix(others, len(doc_ids))
                for at in range(0, len(doc_ids), STEP):
                    best.add(doc_ids[at : at + STEP], corpus_rows[at : at + STEP])
        if best is not None:
            yield out()

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.select("query_id", "rows", "block", "doc_id", "others").mapInArrow(nearest, pairs_schema(queries))


def vector_topk_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    dim: int,
    k: int = rules.TOP_K,
    tables: int = 8,
    bits: int = 4,
) -> DataFrame:
    """Approximate form for large query sets: only rows that share a bucket of
    random hyperplanes in one of the tables are compared. Hot buckets are cut
    into blocks like everything else."""
    if k <= 0:
        return _empty_topk(queries)
    planes = hash_planes(dim, tables, bits)

    def hashed(df: DataFrame, key: str) -> DataFrame:
        coded = df.select(key, "embedding", bucket_codes(F.col("embedding"), planes).alias("_codes"))
        return coded.select(key, "embedding", F.posexplode("_codes").alias("_table", "_bucket"))

    queries, corpus = _usable(queries), _usable(corpus)
    pairs = _grid_topk(hashed(queries, "query_id"), hashed(corpus, "doc_id"), ["_table", "_bucket"], k)
    # the same pair may come out of several tables
    return _rank(pairs.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance")), k)


def _empty_topk(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], pairs_schema(queries) + ", rank int")


# --- texts and prompts ---------------------------------------------------------------------
def with_texts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach the texts; ids without a text are dropped."""
    known = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return hits.join(known, "doc_id")


def search_text(
    queries: DataFrame, corpus: DataFrame, k: int = rules.TOP_K, dim: int = rules.VECTOR_DIM
) -> DataFrame:
    """queries(query_id, text) -> (query_id, rank, doc_id, distance, text)."""
    embedded = queries.select("query_id", embed_text(F.col("text"), dim).alias("embedding"))
    hits = vector_topk(embedded, corpus.select("doc_id", "embedding"), k)
    return with_texts(hits, corpus).select("query_id", "rank", "doc_id", "distance", "text")


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context): the k texts of every query, nearest first."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = F.transform(ranked, lambda r: r["text"])
    return hits.groupBy("query_id").agg(
        F.array_join(texts, rules.CONTEXT_SEPARATOR).alias("context")
    )


def chat_context(context: Column) -> Column:
    """System message put in front of a chat; null without context."""
    return F.concat(F.lit(rules.CHAT_CONTEXT_PREFIX), context)


def simple_context(context: Column, prompt: Column) -> Column:
    """Prompt with its context; the bare prompt without one."""
    return F.when(context.isNotNull(), fill(rules.SIMPLE_CONTEXT, context, prompt)).otherwise(prompt)
