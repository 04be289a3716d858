"""Deterministic pseudo-embedding of text and vector kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


def embed_text(text: Column, dim: int) -> Column:
    """Unit vector of ``dim`` numbers: byte ``b`` at position ``i`` adds
    ``b / 128 - 1`` to slot ``(31 i + b) mod dim``. No slots for ``dim`` 0."""

    places = np.zeros(0, dtype=np.int64)  # 31 i mod dim

    def embed(value: str | None) -> np.ndarray | None:
        nonlocal places
        if value is None:
            return None
        raw = np.frombuffer(value.encode("utf-8"), dtype=np.uint8)
        if dim == 0 or raw.size == 0:
            return np.zeros(dim)
        if len(places) < raw.size:
            places = 31 * np.arange(2 * raw.size, dtype=np.int64) % dim
        # sums of multiples of 1/128 are exact in any order
        sums = np.bincount(places[: raw.size] + raw, weights=raw / 128.0 - 1.0, minlength=-(-(dim + 255) // dim) * dim)
        vector = sums.reshape(-1, dim).sum(axis=0)
        norm = np.sqrt(np.square(vector).sum())
        return vector / norm if norm > 1e-6 else vector

    @F.pandas_udf(VECTOR)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run(text)


def unit_rows(vectors) -> np.ndarray:
    """Matrix of the vectors, every row scaled to length one (zero rows stay)."""
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosine_distances(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows, never negative; 0 against a zero vector.
    Rounded below any meaning so that equal vectors tie exactly."""
    distance = np.maximum(1.0 - queries @ corpus.T, 0.0)
    distance[~queries.any(axis=1), :] = 0.0
    distance[:, ~corpus.any(axis=1)] = 0.0
    return np.round(distance, 12)


def smallest(rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """The ``k`` nearest (row, id, distance) of every row; ids break ties."""
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if rows.size else np.array([], int)
    rank = np.arange(rows.size) - np.repeat(first, np.diff(np.r_[first, rows.size]))
    keep = rank < k
    return rows[keep], ids[keep], dist[keep]


def few_of_each(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep so that of equal ones the ``k`` with the smallest ids stay:
    equal rows are equally near to everything."""
    order = np.argsort(ids, kind="stable")
    whole = np.ascontiguousarray(rows[order])
    if not whole.size:
        return order[: k if whole.shape[1] == 0 else None]
    bytes_of = whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel()
    _, group, counts = np.unique(bytes_of, return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return order
    by = np.argsort(group, kind="stable")
    place = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[by[place < k]]


def true_places(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, where little is: by rows and by eight at once,
    much quicker than to look at every place."""
    rows = np.flatnonzero(some.any(axis=1))
    flat = (some if len(rows) == len(some) else some[rows]).ravel()
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        eight = np.flatnonzero(flat.view(np.uint64) != 0)
        which, place = np.nonzero(flat.reshape(-1, 8)[eight])
        at = eight[which] * 8 + place
    row, column = np.divmod(at, max(1, some.shape[1]))
    return rows[row], column


class NearestRows:
    """Running k nearest corpus rows for a block of queries.

    Products in single precision leave out what is surely farther than the k
    nearest so far; only the rest is measured, in double precision. Queries go
    in steps, so memory doesn't grow with their number times that of rows.
    """

    STEP, PAIRS, GROUPS = 512, 1 << 16, 64

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.rough, self.zero = queries.astype(np.float32), ~queries.any(axis=1)
        # the k-th nearest distance so far, and what single precision may be off by
        self.bound = np.full(len(queries), np.inf)
        self.slack = (queries.shape[1] + 16) * 2.0**-22
        none = np.array([], dtype=np.int64)
        self.found = [(none, none, np.array([], dtype=np.float64))] * len(range(0, len(queries), self.STEP))
        self.space = np.empty((self.STEP, 0), dtype=np.float32)  # of the products, used again

    rows = property(lambda self: np.concatenate([r for r, _, _ in self.found] or [[]]).astype(np.int64))
    ids = property(lambda self: np.concatenate([i for _, i, _ in self.found] or [[]]))
    dist = property(lambda self: np.concatenate([d for _, _, d in self.found] or [[]]))

    def add(self, ids: np.ndarray, corpus: np.ndarray) -> None:
        keep = few_of_each(corpus, ids, self.k)
        ids, corpus = ids[keep], corpus[keep]
        if not len(ids):
            return
        rough, empty = corpus.astype(np.float32).T, np.flatnonzero(~corpus.any(axis=1))
        for n, lo in enumerate(range(0, len(self.queries), self.STEP)):
            rows, cols = self._near(slice(lo, lo + self.STEP), rough, empty, ids)
            if len(rows):
                rows = rows + lo
                dist = self._distances(rows, cols, corpus)
                old = self.found[n]
                new = smallest(np.r_[old[0], rows], np.r_[old[1], ids[cols]], np.r_[old[2], dist], self.k)
                self.found[n] = new
                last = np.flatnonzero(np.r_[new[0][1:] != new[0][:-1], True])
                full = np.diff(np.r_[-1, last]) == self.k
                self.bound[new[0][last[full]]] = new[2][last[full]]

    def _near(self, part: slice, corpus: np.ndarray, empty: np.ndarray, ids: np.ndarray):
        """Pairs that may be among the k nearest."""
        rough = self.rough[part]
        if self.space.shape[1] < corpus.shape[1]:
            self.space = np.empty((self.STEP, corpus.shape[1]), dtype=np.float32)
        near = np.matmul(rough, corpus, out=self.space.ravel()[: len(rough) * corpus.shape[1]].reshape(len(rough), -1))
        near[:, empty] = 1.0
        zero = np.flatnonzero(self.zero[part])
        if len(zero):  # as near to all: the smallest ids count
            near[zero] = -4.0
            near[np.ix_(zero, np.argsort(ids, kind="stable")[: self.k])] = 1.0
        least = 1.0 - self.bound[part] - self.slack
        new = np.flatnonzero(np.isinf(self.bound[part]))
        if len(new) and near.shape[1] > self.k:
            # the k-th largest of the largest of groups is no larger than that of all
            first = near[new] if len(new) < len(near) else near
            n = max(1, near.shape[1] // max(self.GROUPS, 2 * self.k))
            most = np.maximum.reduceat(first, np.arange(0, near.shape[1], n), axis=1)
            least[new] = np.partition(most, most.shape[1] - self.k, axis=1)[:, most.shape[1] - self.k] - 2 * self.slack
        return true_places(near >= np.nextafter(least.astype(np.float32), np.float32(-8))[:, None])

    def _distances(self, rows: np.ndarray, cols: np.ndarray, corpus: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for lo in range(0, len(rows), self.PAIRS):
            q, c = self.queries[rows[lo : lo + self.PAIRS]], corpus[cols[lo : lo + self.PAIRS]]
            distance = np.maximum(1.0 - np.einsum("ij,ij->i", q, c), 0.0)
            distance[~q.any(axis=1) | ~c.any(axis=1)] = 0.0
            out[lo : lo + self.PAIRS] = np.round(distance, 12)
        return out


def hash_planes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random hyperplanes (tables, bits, dim), the same on every machine."""
    return np.random.RandomState(seed).normal(size=(tables, bits, dim)).round(6)


def bucket_codes(vector: Column, planes: np.ndarray) -> Column:
    """One bucket number per table: the side of every hyperplane as a bit."""
    tables, bits, dim = planes.shape
    flat, powers = planes.reshape(-1, dim), 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return vectors
        matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
        sides = (matrix @ flat.T > 0).reshape(-1, tables, bits)
        return pd.Series(list((sides @ powers).astype(np.int32)))

    return run(vector)
