"""Packing documents into sequences by patterns that fit the histogram of lengths.

Only counts per length decide which lengths share a sequence, so the decision
is as large as the histogram (at most ``capacity`` numbers), whatever the
corpus holds. Lengths are binned, all patterns of at most three bins that fill
a sequence are enumerated, and non-negative least squares finds how often each
pattern should be used so that the histogram is met. Repeat counts are rounded
down and filled with real lengths; what is left goes to the fullest place that
still fits, longest first. The plan says for the n-th piece of a length where
it goes; a piece's number among its length comes from counts per task.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import byte_texts, offsets_of, sliced, split_words, written

#: Words a worker remembers, and the longest that it does (bytes).
CACHE_WORDS, CACHE_LONGEST = 1_200_000, 64
#: Bytes of text whose words become one dictionary.
BATCH_TEXT = 8 << 20
#: Words that go to the tokenizer in one text, and what marks the last token of a word.
GROUP, WORD_END = 64, "</w>"
END_ID = 1
BINS = 256

_CLOSED = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([.,;:!?]+)")
_MARKS = frozenset(b".,;:!?")
_STATE: dict[str, tuple] = {}


def _ids(encoding) -> bytes:
    return struct.pack(f"<{len(encoding)}I", *encoding.ids)


def _encoded(model, last: np.ndarray, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, ids) of each. Words of letters alone go in groups, in a text of their
    own each: there a word is one unit, and its last token is marked as such."""
    texts = [w.decode() for w in words]
    alone, letters = [], []
    for i, t in enumerate(texts):
        (letters if t.isalpha() else alone).append(i)
    groups = [letters[a : a + GROUP] for a in range(0, len(letters), GROUP)]
    joined = model.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
    for group, encoding in zip(groups, joined):
        ids = np.array(encoding.ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) != len(group):  # a letter that the tokenizer takes apart
            alone += group
            continue
        raw = ids.tobytes()
        for i, a, b in zip(group, [0, *ends], ends):
            yield words[i], raw[a:b]
    encodings = model.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)
    yield from zip((words[i] for i in alone), map(_ids, encodings))


def _looked_up(path: str, words: list[bytes]) -> list[bytes]:
    """Token ids of different words as little-endian 32-bit numbers; a word goes to the
    tokenizer when a worker meets it first."""
    if path not in _STATE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        last = np.zeros(model.get_vocab_size(), dtype=bool)
        last[[i for token, i in model.get_vocab().items() if token.endswith(WORD_END)]] = True
        _STATE[path] = (model, last, {})
    model, last, known = _STATE[path]
    if len(known) > CACHE_WORDS:  # the frequent words are among the first met
        for w in list(islice(known, CACHE_WORDS // 2, None)):
            del known[w]
    fresh = set(words).difference(known)
    if fresh:
        # a word with closing marks is two tokens' worth of the same pattern
        closed = {w: m.groups() for w in fresh if w[-1] in _MARKS and (m := _CLOSED.fullmatch(w))}
        whole = {x for pair in closed.values() for x in pair}.union(fresh.difference(closed)).difference(known)
        known.update(_encoded(model, last, list(whole)))
        known.update((w, known[a] + known[b]) for w, (a, b) in closed.items())
    out = list(map(known.__getitem__, words))
    for w in fresh:
        if len(w) > CACHE_LONGEST:
            known.pop(w, None)
    return out


def forget() -> None:
    """A worker lives on after its job: the memory of its words is for what comes next."""
    for _, _, known in _STATE.values():
        known.clear()


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after the other, and where each text's begin.

    The tokenizer splits at white space before it merges, so a text's ids are
    those of its blank-separated words in turn. The words of all texts become one
    dictionary: each different word is looked up once, and its ids are taken for
    every place. ASCII texts are lower-cased beforehand, as the tokenizer would,
    unless they might hold a special token.
    """
    texts = pc.fill_null(texts, "")
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    words, at = split_words(pc.if_else(plain, pc.ascii_lower(texts), texts))
    coded = words.dictionary_encode()
    ids = _looked_up(path, byte_texts(coded.dictionary))
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    lists = pa.ListArray.from_arrays(
        pa.array(offsets_of(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4"))
    )
    every = offsets_of(sizes.take(coded.indices.to_numpy()))
    return np.asarray(lists.take(coded.indices).flatten()), every[at]


def encode_batch(path: str, texts: list[bytes]) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers."""
    ids, at = token_ids(path, pa.array(texts, pa.binary()).cast(pa.string()))
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str, text: str) -> DataFrame:
    """Pieces of all documents with their number among pieces of the same length of a task."""
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in sliced(batches, "text", BATCH_TEXT):
            ids, at = token_ids(tokenizer, batch.column(1))
            # every text gets one id more at its end
            size = np.diff(at) + 1
            first = offsets_of(size)
            whole = np.full(first[-1], END_ID, dtype="<u4")
            inner = np.ones(first[-1], dtype=bool)
            inner[first[1:] - 1] = False
            whole[inner] = ids
            parts = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(row)) - np.repeat(offsets_of(parts)[:-1], parts)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            lo = (first[row] + start) * 4
            buffer = memoryview(whole).cast("B")
            sums = [zlib.crc32(buffer[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist())]
            # the number of a piece among those of its length, in this task so far
            order = np.argsort(length, kind="stable")
            same = length[order]
            nth = np.empty(len(row), dtype=np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(same, same, side="left")
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            made = {"key": batch.column(0).take(pa.array(row))}
            made |= {"piece": pa.array(piece, pa.int32()), "start": start, "length": length}
            made |= {"ids_crc32": pa.array(sums, pa.int64()), "nth": nth, "task": np.full(len(row), task)}
            yield pa.RecordBatch.from_pydict(made)

    return columns.mapInArrow(
        run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task bigint"
    )


# --- the plan: from a histogram to patterns with repeat counts -----------------------------------
def patterns(bins: int) -> np.ndarray:
    """All ways to fill ``bins`` with one, two or three parts, as rows of three parts (0: none)."""
    a = np.arange(1, bins + 1)
    x, y = np.meshgrid(a, np.arange(0, bins + 1), indexing="ij")
    z = bins - x - y
    ok = (x >= y) & (y >= z) & (z >= 0)
    return np.stack([x[ok], y[ok], z[ok]], axis=1)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    atb = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0.0)))
    for _ in range(steps):
        slope = atb - a.T @ (a @ x)
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tiny:
            break
        passive[best] = True
        while True:
            cols = np.flatnonzero(passive)
            gram = a[:, cols].T @ a[:, cols]
            gram[np.diag_indices_from(gram)] += 1e-9
            s = np.linalg.solve(gram, atb[cols])
            if s.min() > 0:
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            held = x[cols]
            move = float(np.min(held[low] / np.maximum(held[low] - s[low], 1e-300)))
            x[cols] = held + move * (s - held)
            gone = cols[(x[cols] <= 1e-12) & low]
            passive[gone], x[gone] = False, 0.0
            if not passive.any():
                break
    return x


class Sequences:
    """Groups of like sequences by free room: (lengths as a linked list, how many)."""

    def __init__(self) -> None:
        self.room: list[int] = []
        self.groups: dict[int, list[tuple]] = {}

    def put(self, room: int, lengths: tuple, count: int) -> None:
        if room not in self.groups:
            insort(self.room, room)
            self.groups[room] = []
        self.groups[room].append((lengths, count))

    def take(self, length: int, count: int) -> tuple[int, tuple, int] | None:
        """Some of the fullest sequences that still have room for ``length``."""
        i = bisect_left(self.room, length)
        if i == len(self.room):
            return None
        room = self.room[i]
        lengths, there = self.groups[room].pop()
        if there > count:
            self.groups[room].append((lengths, there - count))
        if not self.groups[room]:
            del self.groups[room], self.room[i]
        return room, lengths, min(there, count)


def pack_histogram(histogram: dict[int, int], capacity: int, bins: int = BINS) -> list[tuple[list[int], int]]:
    """(lengths, number of sequences) so that every piece of the histogram has a place."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = Sequences()
    if full := left.pop(capacity, 0):
        out.put(0, (capacity, None), full)
    width = -(-capacity // min(bins, capacity))
    cells = capacity // width
    counts = np.zeros(cells + 1)
    for n, c in left.items():
        counts[min(cells, -(-n // width))] += c
    if left and cells >= 2:
        parts = patterns(cells)
        a = np.zeros((cells + 1, len(parts)))
        for j in range(3):
            np.add.at(a, (parts[:, j], np.arange(len(parts))), 1.0)
        a[0] = 0
        # a long piece left over costs more than a short one
        weight = np.sqrt(np.arange(cells + 1) / cells)
        repeats = np.floor(nnls(a * weight[:, None], counts * weight)).astype(np.int64)
        order = sorted(left)
        for i in sorted(np.flatnonzero(repeats), key=lambda i: tuple(-parts[i])):
            wanted = [int(p) for p in parts[i] if p]
            todo = int(repeats[i])
            while todo:
                room, got = capacity, []
                for j, p in enumerate(wanted):
                    # real lengths of the bin; the last part takes the best fit
                    top = room if j == len(wanted) - 1 else min(room, p * width)
                    at = bisect_left(order, top + 1) - 1
                    if at < 0 or order[at] <= (p - 2) * width:
                        break
                    n = order[at]
                    if left[n] - got.count(n) <= 0:
                        break
                    got.append(n)
                    room -= n
                if len(got) < len(wanted):
                    break
                k = min([todo, *(left[n] // got.count(n) for n in set(got))])
                lengths = None
                for n in got:
                    left[n] -= k
                    lengths = (n, lengths)
                for n in set(got):
                    if not left[n]:
                        del left[n], order[bisect_left(order, n)]
                out.put(room, lengths, k)
                todo -= k
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            if found := out.take(n, c):
                room, lengths, k = found
                out.put(room - n, (n, lengths), k)
                c -= k
                continue
            each = capacity // n
            for size, k in ((each, c // each), (c % each, 1)):
                if size and k:
                    lengths = None
                    for _ in range(size):
                        lengths = (n, lengths)
                    out.put(capacity - size * n, lengths, k)
            c = 0
    made = []
    for groups in out.groups.values():
        for lengths, k in groups:
            flat = []
            while lengths:
                flat.append(lengths[0])
                lengths = lengths[1]
            made.append((flat, k))
    return made


def places(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, sequence, offset), in order: pieces of a
    length from that number on go to that sequence and the next ones."""
    rows, used, sequence = [], {}, 0
    for lengths, k in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + k
            offset += n
        sequence += k
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: one piece that holds the end id alone. Documents
    longer than ``capacity`` are cut, others never. Repeated rows and repeated
    or null keys are packed row by row, other columns are not looked at, an
    empty table gives no rows. Sequences are gapless from offset 0.
    """
    made = written(pieces(docs, tokenizer, capacity, key, text), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(pack_histogram(histogram, capacity))
    shift = 44  # pieces of one length number less than 2 ** 44
    shared = docs.sparkSession.sparkContext.broadcast(((plan[:, 0] << shift) + plan[:, 1], plan[:, 1:]))
    kind = docs.schema[key].dataType.simpleString()
    numbered = made.join(base, ["task", "length"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        forget()  # the words that this worker remembers were for the pieces
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (np.asarray(batch.column(i), dtype=np.int64) for i in (3, 5))
            hit = rows[np.searchsorted(keys, (length << shift) + number, side="right") - 1]
            columns = [*batch.columns[:5], pa.array(hit[:, 1] + number - hit[:, 0]), pa.array(hit[:, 2])]
            yield pa.RecordBatch.from_arrays(
                columns, [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    placed = numbered.mapInArrow(
        place,
        f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
    return placed.withColumnRenamed("key", key)
