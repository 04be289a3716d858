"""Runs of repeated words, found by a dictionary of basic factors.

For every power of two the dictionary names the word sequences of that length,
so that two positions have the same name where the sequences are equal. A level
comes from pairs of names of the level before, and holds only positions whose
sequence occurs again in its document: the others can't lie in a repeat. At
each level, occurrences that follow each other by the same step, of at most
twice the length, form an arithmetic progression and propose that step as a
period. A run of period q and four periods or more holds such a progression at
the level whose length lies from q up to 2q - 1, since there the next occurrence
is exactly q words on. Proposals are extended to both sides by jumps along the
names and told apart by where they end.

A batch holds many documents; names never cross from one to another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import let
from textguard.llm.common import offsets_of, segment_sums, sliced, split_words

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
BLANKS = r"[\x20\x09-\x0D]+"


class Factors:
    """The names of all repeated factors of a batch, level by level."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        self.levels: list[np.ndarray] = []
        #: (position, step) of the first of neighbouring positions that propose a step
        self.proposed: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(n)
        pairs = owner.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        while len(at):
            size = 1 << len(self.levels)
            order = np.argsort(pairs, kind="stable")  # by place among equal ones
            sorted_at, equal = at[order], np.diff(pairs[order]) == 0
            again = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            rank = np.cumsum(np.concatenate([[True], ~equal])) - 1
            names = np.full(n, -1, dtype=np.int32)
            names[sorted_at[again]] = rank[again]
            self.levels.append(names)
            self._propose(sorted_at, equal, size, n)
            alive = np.sort(sorted_at[again])
            alive = alive[alive + size < n]
            alive = alive[(names[alive + size] >= 0) & (owner[np.minimum(alive + size, n - 1)] == owner[alive])]
            at, pairs = alive, names[alive].astype(np.int64) * (len(order) + 1) + names[alive + size]

    def _propose(self, at: np.ndarray, equal: np.ndarray, size: int, n: int) -> None:
        first, step = at[:-1][equal], np.diff(at)[equal]
        near = step <= 2 * size
        first, step = first[near], step[near]
        steps = np.zeros(n + 1, dtype=np.int64)
        steps[first] = step
        goes_on = steps[first + step] == step  # three occurrences, evenly spaced
        steps = np.zeros(n + 1, dtype=np.int64)
        steps[first[goes_on]] = step[goes_on]
        start = np.flatnonzero((steps[:-1] > 0) & (steps[:-1] != np.concatenate([[0], steps[:-2]])))
        self.proposed.append((start, steps[start]))

    def _same(self, level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        names = self.levels[level]
        inside = (left >= 0) & (right < len(names))
        a, b = names[np.where(inside, left, 0)], names[np.where(inside, right, 0)]
        return inside & (a >= 0) & (a == b)

    def extended(self, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest stretch of period ``step`` around each position: start, length."""
        start, end = at.copy(), at.copy()
        for level in reversed(range(len(self.levels))):
            size = 1 << level
            end[self._same(level, end, end + step)] += size
            start[self._same(level, start - size, start - size + step)] -= size
        return start, end + step - start


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all maximal runs. ``words`` are numbers,
    equal for equal words; ``owner`` says which document a word belongs to, in order."""
    if periods < 4:
        raise ValueError("progressions are sure to be found for runs of four periods or more")
    factors = Factors(words, owner)
    if not factors.proposed:
        return np.zeros((0, 3), dtype=np.int64)
    at, step = (np.concatenate(x) for x in zip(*factors.proposed))
    start, length = factors.extended(at, step)
    good = length >= np.maximum(least, periods * step)
    rows = np.stack([start, length, step], axis=1)[good].astype(np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that several periods fit has the smallest, of which they are multiples
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_batch(texts: pa.Array, least: int, periods: int) -> dict[str, pa.Array]:
    words, offsets = split_words(texts)
    n, size = len(words), np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    runs = find_runs(words.dictionary_encode().indices.to_numpy(), owner, least, periods)
    start, length, period = runs.T
    first = offsets[:-1][owner[start]] if len(runs) else start
    per_text = np.bincount(owner[start], minlength=len(size)) if len(runs) else np.zeros(len(size), dtype=np.int64)
    fields = {"start": start - first, "length": length, "period": period}
    found = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    kept = np.cumsum(covered[:-1]) == 0
    counts = segment_sums(kept.astype(np.int64), offsets).astype(np.int64)
    left = words if kept.all() else words.filter(pa.array(kept))
    lists = pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), left.cast(pa.string()))
    return {
        "n_words": pa.array(size, pa.int64()),
        "runs": pa.ListArray.from_arrays(pa.array(offsets_of(per_text), pa.int32()), found),
        "collapsed": pc.binary_join(lists, " "),
    }


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> DataFrame:
    """One row per document: ``key``, n_words, runs (start, length and period in
    words, by start and then period), collapsed.

    A run is a stretch of words with smallest period q, at least ``least`` words
    and ``periods`` times q long, which no neighbouring word extends. ``collapsed``
    is the text without the words that a run holds after its first q, words joined
    by one blank.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    Rows are handled one by one, so repeated rows and repeated or null keys stay
    as they are; other columns are not looked at; an empty table gives no rows.
    A document is handled where it is read, without a shuffle; a very long one is
    a batch of its own, whose work grows with n log n.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            found = find_batch(part.column(1), least, periods)
            yield pa.RecordBatch.from_pydict({"key": part.column(0), **found})

    found = columns.mapInArrow(run, f"key {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("key", key)


def best_run(runs: Column) -> Column:
    """The run of most periods, compared exactly; the first of equal ones; null without any."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(more(r, best), r).otherwise(best),
    )


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of which about every tenth, by the crc32 of its key, goes on with a
    stretch of its own words over and over. The others are as they were."""
    number = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    every = F.floor(number / 10)
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        at = every % n
        period = 1 + F.floor((n - at) / (3 + every % 8))
        place = lambda i: F.when(i < at, i).otherwise(at + (i - at) % period)
        return F.when(n > 0, F.array_join(F.transform(w, lambda _, i: F.get(w, place(i).cast("int"))), " "))

    planted = F.when((number % 10 == 0) & F.col(text).isNotNull(), let(words, repeated))
    return docs.withColumn(text, F.coalesce(planted, F.col(text)))
