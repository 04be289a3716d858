"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Equal fingerprints are one class. A tree over a bounded sample of fingerprints
splits space: a node holds a vantage point and a radius; what is no farther
than the radius goes inside, the rest outside. Each leaf is a shard. A
fingerprint is stored in one leaf and asked in every leaf that the triangle
bound leaves open: those on both sides of a radius if its distance is within
the link distance of it. Inside a shard a deeper tree is walked in the same way
for all questions at once, and what is left is compared bit by bit. A shard
reports a spanning forest of its links, never all pairs, and components of all
forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import ascii_lower_words, byte_texts, map_texts, offsets_of, segment_sums, sliced, written
from textguard.llm.components import components

#: Fingerprints of the sample that shapes the tree, and the least of them in a leaf.
SAMPLE, SAMPLE_LEAF = 1 << 16, 16
#: Stored fingerprints that a shard should hold; larger leaves are split, and
#: questions for one go in blocks.
SHARD, ASKED = 4096, 1 << 16
#: Fingerprints of a leaf that are compared without a deeper tree.
LOCAL_LEAF = 256
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(words: list[bytes], size: int = 3) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``size`` words, joined by blanks."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if n == 1:
        return np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    ends = (ends - 1)[size - 1 :].tolist()
    cut = map(joined.__getitem__, map(slice, starts, ends))
    return np.fromiter(map(xxh64_intdigest, cut, repeat(42)), dtype=np.uint64, count=n)


def fingerprints_of(texts: list[bytes], size: int = 3) -> np.ndarray:
    """64 bits per text: a bit is set if it is in more than half of the hashes."""
    hashes = [shingle_hashes(ascii_lower_words(t), size) for t in texts]
    at = offsets_of(map(len, hashes))
    out = np.zeros(len(texts), dtype=np.uint64)
    # some documents at a time: each hash becomes 64 numbers
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + 65536, side="right")) - 1)
        counts = np.zeros((stop - start, 64), dtype=np.int64)
        if stop == start + 1:
            for lo in range(0, len(hashes[start]), 65536):
                counts[0] += _bits(hashes[start][lo : lo + 65536]).sum(axis=0, dtype=np.int64)
        else:
            counts[:] = segment_sums(_bits(np.concatenate(hashes[start:stop])).astype(np.int32), at[start : stop + 1] - at[start])
        total = np.diff(at[start : stop + 1])
        out[start:stop] = ((2 * counts > total[:, None]) * BITS).sum(axis=1, dtype=np.uint64)
        start = stop
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


# --- the tree ------------------------------------------------------------------------------------
class Tree:
    """Nodes (vantage, radius, inside, outside); a leaf is a negative number."""

    def __init__(self, sample: np.ndarray, leaves: int, least: int = SAMPLE_LEAF) -> None:
        self.nodes: list[list] = []
        self.leaves = 0
        self.root = self._grow(sample, max(1, leaves), least)

    def _grow(self, points: np.ndarray, leaves: int, least: int) -> int:
        best = None
        if leaves > 1 and len(points) >= 2 * least:
            # of a few vantage points, the one whose radius has the fewest points near it
            for v in points[:: max(1, len(points) // 8)][:8]:
                d = distance(points, v)
                for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside = int((d <= radius).sum())
                    if least <= inside <= len(points) - least:
                        near = int((np.abs(d - radius - 0.5) < 2).sum())
                        key = (max(inside, len(points) - inside) + near, int(v), radius)
                        best = min(best, key) if best else key
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, v, radius = best
        at = len(self.nodes)
        self.nodes.append([np.uint64(v), radius, 0, 0])
        d = distance(points, np.uint64(v))
        share = int((d <= radius).sum()) / len(points)
        left = max(1, min(leaves - 1, round(leaves * share)))
        self.nodes[at][2] = self._grow(points[d <= radius], left, least)
        self.nodes[at][3] = self._grow(points[d > radius], leaves - left, least)
        return at

    def walk(self, points: np.ndarray, slack: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the points that reach it); with slack a point takes
        both ways where a neighbour within that distance could lie on the other side."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            v, radius, inside, outside = self.nodes[node]
            d = distance(points[rows], v)
            todo.append((inside, rows[d <= radius + slack]))
            todo.append((outside, rows[d > radius - slack]))


def near_pairs(stored: np.ndarray, asked: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of pairs (stored, asked) within the distance, block by block."""
    tree = Tree(stored, max(1, len(stored) // LOCAL_LEAF), 8)
    held = dict(tree.walk(stored, 0))
    for leaf, rows in tree.walk(asked, slack):
        own = held.get(leaf)
        if own is None:
            continue
        for lo in range(0, len(own), 1024):
            some = own[lo : lo + 1024]
            step = max(1, (1 << 20) // len(some))
            for b in range(0, len(rows), step):
                block = rows[b : b + step]
                i, j = np.nonzero(np.bitwise_count(stored[some][:, None] ^ asked[block][None, :]) <= slack)
                if len(i):
                    yield some[i], block[j]


class Forest:
    """Sets of numbers, joined pair by pair."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            more = self.up[self.up]
            if (more == self.up).all():
                return self.up
            self.up = more

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            up = self.roots()
            x, y = up[a], up[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, high[apart], low[apart])


def shard_links(stored: np.ndarray, asked: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between stored and asked fingerprints."""
    points, number = np.unique(np.concatenate([stored, asked]), return_inverse=True)
    forest = Forest(len(points))
    for i, j in near_pairs(stored, asked, slack):
        forest.join(number[: len(stored)][i], number[len(stored) :][j])
    root = forest.roots()
    away = np.flatnonzero(root != np.arange(len(points)))
    return points[away], points[root[away]]


# --- the jobs ------------------------------------------------------------------------------------
def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key`` and the fingerprint as a signed number, row by row; no words give 0."""
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"key": batch.column(0), "fp": pa.array(fingerprints_of(texts, size).view(np.int64))}

    return map_texts(columns, "text", f"key {kind}, fp bigint", work)


def links(classes: DataFrame, slack: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect what lies within ``slack`` bits."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    sampled = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in sampled.select("fp").collect()], dtype=np.int64)).view(np.uint64)
    sample = np.random.default_rng(1).permutation(sample)
    tree = spark.sparkContext.broadcast(Tree(sample, -(-n // SHARD)))

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            signed = np.asarray(frame.column(0), dtype=np.int64)
            for asks in (False, True):
                for leaf, rows in tree.value.walk(signed.view(np.uint64), slack if asks else 0):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "leaf": pa.array(np.full(len(rows), leaf, dtype=np.int32)),
                            "asks": pa.array(np.full(len(rows), asks)),
                            "fp": pa.array(signed[rows]),
                        }
                    )

    routed = classes.select("fp").mapInArrow(route, "leaf int, asks boolean, fp bigint")
    # a leaf that holds or is asked much is cut into blocks, each of which meets each
    sizes = routed.groupBy("leaf").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asked"))
    cuts = {
        r["leaf"]: (-(-r["held"] // (4 * SHARD)) or 1, -(-r["asked"] // ASKED) or 1)
        for r in sizes.where((F.col("held") > 4 * SHARD) | (F.col("asked") > ASKED)).collect()
    }
    # rows of usual leaves have the block (0, 0); the list is as short as the tree
    spread = spark.createDataFrame(
        [(leaf, h, a) for leaf, (h, a) in cuts.items()], "leaf int, held_blocks int, asked_blocks int"
    )
    routed = routed.join(F.broadcast(spread), "leaf", "left")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    held = routed.where(~F.col("asks")).select("leaf", "asks", "fp", own(F.col("held_blocks")).alias("h"), every(F.col("asked_blocks")).alias("a"))
    asked = routed.where("asks").select("leaf", "asks", "fp", own(F.col("asked_blocks")).alias("a"), every(F.col("held_blocks")).alias("h"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64)
        asks = frame["asks"].to_numpy()
        a, b = shard_links(fp[~asks], fp[asks], slack)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return held.unionByName(asked).groupBy("leaf", "h", "a").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, slack: int = 2, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, fingerprint (16 hex digits), component_id.

    Null texts count as empty; texts without words have fingerprint 0 and link
    like any other. Documents with equal fingerprints are linked. component_id
    is the smallest key reachable over links, null keys aside (a component of
    null keys alone has null). Repeated rows each get a row, other columns are
    not looked at, an empty table gives no rows.
    """
    made = written(fingerprints(docs, key, text, size), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("key").alias("least"))
    classes = written(classes, "classes")
    roots = components(links(classes, slack)).withColumnsRenamed({"node": "fp"})
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return made.join(named, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, slack: int = 2, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns kept, one for each component: that with the smallest key.

    ``docs`` must be read from files, so that row numbers are the same each time
    it is read. Of rows that repeat the smallest key, the first read stays; of a
    component with null keys alone, too.
    """
    at = "_row_of_one_of_each"
    numbered = docs.withColumn(at, F.monotonically_increasing_id())
    columns = numbered.select(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("key"), F.col(at).alias("row")).alias("k"), F.col(text).alias("text"))
    kept = near_duplicates(columns, slack, size, "k", "text").select("component_id.row").distinct()
    return numbered.join(kept.withColumnRenamed("row", at), at, "left_semi").drop(at)
