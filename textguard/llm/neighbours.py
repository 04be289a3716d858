"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors is joined to its nearest neighbours, and the graph
is cut into parts of equal size so that few neighbours are separated: parts
grow from a balanced start by moving vectors to the part of their neighbours as
long as there is room. A small classifier learns the parts, and a row of the
table belongs to the part that it finds most probable. A query is searched in
as many of its most probable parts as a calibration on the sample asks for, and
whatever it meets there is compared exactly. A part that holds many rows is cut
into blocks; each block returns its best rows for a query, and these meet in a
top-k by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Vectors of the sample that parts and the classifier are learned from.
SAMPLE = 8192
#: Neighbours in the graph, hidden units of the classifier.
DEGREE, HIDDEN = 10, 64
#: Parts grow with the square root of the rows, by this divisor, up to the most:
#: each part that a query is searched in returns its best rows.
ROOT_DIVISOR, MOST_PARTS = 10, 64
#: Share of true neighbours that the calibrated number of parts has to reach on the sample.
RECALL = 0.95
#: Rows of a block of candidates, and of queries.
BLOCK, QUERIES = 8192, 4096


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of y with the largest products, for each row of x."""
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ y.T
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """A part for each vertex, each with about as many, few edges between parts."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    rng = np.random.default_rng(seed)
    # start: split at the median along random differences, part by part
    part = np.zeros(n, dtype=np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        rows, base, k = groups.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = base
            continue
        a, b = rng.choice(rows, 2, replace=False)
        order = rows[np.argsort(x[rows] @ (x[a] - x[b]), kind="stable")]
        half = k // 2
        cut = len(order) * half // k
        groups += [(order[:cut], base, half), (order[cut:], base + half, k - half)]
    source = np.repeat(np.arange(n), graph.shape[1])
    both_a, both_b = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (both_a, part[both_b]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[wish[v]] < room and rng.random() < 0.8:
                size[part[v]] -= 1
                part[v] = wish[v]
                size[wish[v]] += 1
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, m: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :m]


def learn_router(x: np.ndarray, goal: np.ndarray, epochs: int = 16, seed: int = 2) -> Router:
    """``goal``: for each row the distribution of its neighbours over parts."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], goal.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)) * 3, np.zeros(HIDDEN), rng.normal(0, 0.05, (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            t += 1
            a = x[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            e = (s / s.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (e @ p[2].T) * (a > 0)
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                step = 3e-3 / (1 + epoch / 10)
                p[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def learn(x: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """The router, and in how many parts a query must be searched."""
    if parts <= 1 or len(x) <= 4 * parts:
        d = x.shape[1] if x.ndim == 2 and len(x) else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    graph = nearest(x, x, min(DEGREE + 1, len(x)))
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    # every fifth row is left out of the fit and asks for its neighbours
    aside = np.arange(len(x)) % 5 == 0
    router = learn_router(x[~aside], goal[~aside] / graph.shape[1])
    home = router.top(x, 1)[:, 0]
    near = nearest(x[aside], x, min(k + 1, len(x)))
    order = router.top(x[aside], parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    found_at = np.take_along_axis(place, home[near], axis=1)
    share = np.cumsum(np.bincount(found_at.ravel(), minlength=parts)) / found_at.size
    return router, int(np.searchsorted(share, RECALL) + 1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows that take part: a key, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    ok = F.col(key).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda e: e != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def top_k(
    vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose key is divisible by
    ``every`` the ``k`` rows with the largest inner products found, but itself.

    Scores are inner products of the original vectors in double precision; ties
    go to the smaller key. Rows with null keys, and vectors that are null, zero,
    or hold null or non-finite components, take no part. All vectors must have
    as many components as most; others are of another space and left out.
    Repeated keys are candidates each, but never for a query of their key.
    Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == d)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    sampled = rows.where(draw < min(1 << 30, int(1.2 * SAMPLE / n * (1 << 30)) + 1)).limit(SAMPLE).collect()
    sampled.sort(key=lambda r: (r["id"], r["v"]))
    x = np.array([r["v"] for r in sampled]).reshape(-1, d)
    x = np.unique(x, axis=0)  # copies of one vector would fill parts of their own
    x = x[np.random.default_rng(4).permutation(len(x))]
    parts = int(min(MOST_PARTS, max(1, n**0.5 // ROOT_DIVISOR), max(1, len(x) // 32)))
    router, probes = learn(x, parts, k)
    shared = spark.sparkContext.broadcast((router, probes))
    schema = "part int, asks boolean, id bigint, v array<double>"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, probes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)
            top = router.top(matrix(batch.column(1)), probes)
            asking = np.flatnonzero(ids % every == 0)
            where = np.concatenate([np.arange(len(ids)), np.repeat(asking, top.shape[1])])
            part = np.concatenate([top[:, 0], top[asking].ravel()])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array(np.arange(len(where)) >= len(ids)),
                    batch.column(0).take(pa.array(where)),
                    batch.column(1).take(pa.array(where)),
                ],
                ["part", "asks", "id", "v"],
            )

    routed = rows.mapInArrow(route, schema)
    counts = routed.groupBy("part").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asked"))
    # one row a part: blocks of candidates and of queries
    cuts = counts.select(
        "part",
        F.greatest(F.ceil(F.col("held") / BLOCK), F.lit(1)).cast("int").alias("hb"),
        F.greatest(F.ceil(F.col("asked") / QUERIES), F.lit(1)).cast("int").alias("qb"),
    )
    routed = routed.join(F.broadcast(cuts), "part")  # at most MOST_PARTS rows
    own = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = routed.where(~F.col("asks")).select("part", "asks", "id", "v", own(F.col("hb")).alias("h"), all_of("qb").alias("q"))
    asked = routed.where("asks").select("part", "asks", "id", "v", own(F.col("qb")).alias("q"), all_of("hb").alias("h"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids = frame["id"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v = np.stack(frame["v"].to_numpy())
        order = np.argsort(ids[~asks], kind="stable")
        near_ids, near = ids[~asks][order], v[~asks][order]
        query_ids, first = np.unique(ids[asks], return_index=True)
        queries = v[asks][first]
        out = []
        for lo in range(0, len(queries), 256):
            s = queries[lo : lo + 256] @ near.T
            s[query_ids[lo : lo + 256, None] == near_ids[None, :]] = -np.inf
            m = min(k, s.shape[1])
            # everything not below the m-th score, so that ties can be told apart
            least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
            i, j = np.nonzero((s >= least) & (s > -np.inf))
            exact = np.einsum("ij,ij->i", queries[lo + i], near[j])
            by = np.lexsort((near_ids[j], -exact, i))
            i, j, exact = i[by], j[by], exact[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            out.append(pd.DataFrame({"query_id": query_ids[lo + i[keep]], "vec_id": near_ids[j[keep]], "score": exact[keep]}))
        return pd.concat(out)

    found = held.unionByName(asked).groupBy("part", "h", "q").applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
