"""Benchmark decontamination by an FM-index of every training shard.

A shard is some megabytes of documents inside a task. Its words become numbers
of the benchmark's vocabulary; a word outside it can be in no occurrence and
ends a run, and a run shorter than the shortest phrase can hold none. The runs
that remain are sorted by suffix and their Burrows-Wheeler transform goes into
a wavelet matrix. All phrases of the benchmark are searched backward at once,
one word at a time, by two ranks each; rows that remain are walked back to the
next sampled suffix, which gives their place in a document. Occurrences are
merged to spans of words.

The benchmark goes to the tasks in blocks of bounded size. Documents pass
through one step for each block, so any number of blocks needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import byte_texts, offsets_of, sliced, written

WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once, and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
SAMPLED = 16

# separators become blanks, A-Z become a-z
_FOLD = bytes(
    0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class Phrases:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        index = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(index.get(name, -1))
        found = sorted(owners)
        self.shortest = min(map(len, found), default=0)
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        # right-aligned, so that all end in the last column
        self.words = np.zeros((len(found), size), dtype=np.int64)
        for i, w in enumerate(found):
            self.words[i, size - len(w) :] = w
        lists = [sorted(owners[w]) for w in found]
        self.owner_at = offsets_of(map(len, lists))
        self.owner = np.fromiter(chain.from_iterable(lists), dtype=np.int64)


class Bits:
    """A bit vector with ranks: 64 bits a word and counts before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 2, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bits = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int(len(symbols) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of the positions."""
        at = [np.zeros(len(symbol), dtype=np.int64), *ends]
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            for i, x in enumerate(at):
                ones = bits.rank(x)
                at[i] = np.where(one, zeros + ones, x - ones)
        return [x - at[0] for x in at[1:]]

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            out |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return out


class FMIndex:
    """Over runs of symbols (from 1), each closed by a 0 that sorts by its place."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        n = len(text)
        closing = text == 0
        closed = int(closing.sum())
        rank = np.where(closing, np.cumsum(closing) - 1, closed + text)
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            ranked = rank[order]
            fresh = np.concatenate([[False], ranked[1:] != ranked[:-1]])
            dense = np.empty(n, dtype=np.int64)
            dense[order] = np.cumsum(fresh)
            if n == 0 or dense[order[-1]] == n - 1:
                break
            after = np.full(n, -1, dtype=np.int64)
            after[: n - step] = dense[step:]
            rank = dense * (n + 1) + after + 1
            order, step = np.argsort(rank, kind="stable"), 2 * step
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        before = text[order - 1] if n else text
        if n:
            before[order == 0] = 0
        self.bwt = WaveletMatrix(before, alphabet)
        # every run's start is sampled, so a walk never leaves its run
        start = np.concatenate([[True], closing[:-1]]) if n else closing
        kept = (start | (np.arange(n) % SAMPLED == 0))[order]
        self.kept, self.samples = Bits(kept), order[kept]
        self.n = n

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their rows [low, high)."""
        active = np.arange(len(phrases.lengths))
        low, high = np.zeros(len(active), dtype=np.int64), np.full(len(active), self.n, dtype=np.int64)
        done = []
        for step, column in enumerate(reversed(range(phrases.words.shape[1]))):
            over = phrases.lengths[active] == step
            done.append((active[over], low[over], high[over]))
            active, low, high = active[~over], low[~over], high[~over]
            symbol = phrases.words[active, column]
            a, b = self.bwt.rank(symbol, low, high)
            low, high = self.first[symbol] + a, self.first[symbol] + b
            some = low < high
            active, low, high = active[some], low[some], high[some]
        done.append((active, low, high))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order."""
        out, back = np.empty(len(rows), dtype=np.int64), np.arange(len(rows))
        walked = 0
        while len(rows):
            at = self.kept.get(rows)
            out[back[at]] = self.samples[self.kept.rank(rows[at])] + walked
            rows, back = rows[~at], back[~at]
            symbol = self.bwt.get(rows)
            rows = self.first[symbol] + self.bwt.rank(symbol, rows)[0]
            walked += 1
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(phrases: Phrases, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, merged spans of hit words, items with occurring windows."""
    words = [words_of(t) for t in texts]
    out = [(len(w), [], set()) for w in words]
    if not len(phrases.lengths):
        return out
    at = offsets_of(len(w) + 1 for w in words)  # a word outside the vocabulary after each text
    get = phrases.vocabulary.get
    ids = np.zeros(at[-1], dtype=np.int64)
    for lo, w in zip(at, words):
        ids[lo : lo + len(w)] = np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    # the runs, each with the word that ends it
    sizes = ends - starts + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    index = FMIndex(ids[place], len(phrases.vocabulary) + 1)
    found, low, high = index.search(phrases)
    counts = high - low
    rows = np.arange(counts.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(found) else low
    where = place[index.locate(rows)]
    phrase = np.repeat(found, counts)
    doc = np.searchsorted(at, where, side="right") - 1
    order = np.lexsort((where, doc))
    for i in order:
        d, p = int(doc[i]), int(phrase[i])
        lo = int(where[i] - at[d])
        out[d][1].append((lo, lo + int(phrases.lengths[p])))
        out[d][2].update(phrases.names[o] for o in phrases.owner[phrases.owner_at[p] : phrases.owner_at[p + 1]] if o >= 0)
    return [(n, merged(spans), items) for n, spans, items in out]


def block_count(items: DataFrame, text: str) -> int:
    return 1 + (items.agg(F.sum(F.octet_length(text))).head()[0] or 0) // BLOCK_BYTES


def phrase_blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator:
    """Broadcast phrases of bounded parts of the benchmark."""
    sent = benchmark.sparkSession.sparkContext.broadcast
    items = benchmark.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    n = block_count(items, "text")
    part = F.pmod(F.xxhash64("key", "text"), F.lit(n))
    for i in range(n):
        block = items if n == 1 else items.where(part == i)
        yield sent(Phrases([(r[0], (r[1] or "").encode()) for r in block.toLocalIterator()], size))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """One row per document: ``key``, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    ``spans`` are merged runs of hit words, from the first to one past the last;
    ``items`` the sorted ids of items with occurring windows. Null and empty
    texts have no words. An item of fewer words than ``size`` is one window,
    one without words none; an item without id marks words but is not listed.
    Repeated rows, repeated or null keys are answered row by row; repeated items
    count once; other columns are not looked at; empty tables work: no documents
    give no rows, no items give no hits.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<bigint>)").alias("edges"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = f"key {kind}, text string, n_words bigint, edges array<bigint>, items array<string>"

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches, "text", SHARD_BYTES):
                found = search_shard(shared.value, byte_texts(part.column(1)))
                edges, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                for i, (_, spans, names) in enumerate(found):
                    if spans:
                        edges[i] = list(chain.from_iterable(merged([*zip(edges[i][::2], edges[i][1::2]), *spans])))
                        items[i] = sorted(names.union(items[i]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array((n for n, _, _ in found), pa.int64()),
                        pa.array(edges, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    part.schema.names,
                )

        return run

    for shared in phrase_blocks(benchmark, item, text, size):
        out = out.mapInArrow(step(shared), schema)
    starts, ends = F.filter("edges", lambda _, i: i % 2 == 0), F.filter("edges", lambda _, i: i % 2 == 1)
    spans = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s: F.struct(s["start"], s["end"]))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return (
        out.select("key", "n_words", "items", spans.alias("spans"))
        .select("key", "n_words", hit.alias("n_hit"), "items", "spans")
        .select(
            F.col("key").alias(key),
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "items",
            "spans",
        )
    )


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without spans of words; what stands between words remains."""
    folded = text.translate(_FOLD)
    bounds, at = [], 0
    for w in folded.split():
        lo = folded.index(w, at)
        at = lo + len(w)
        bounds.append((lo, at))
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, text[last:]])


def removed(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id"
) -> DataFrame:
    """The documents, all columns kept, without the words of benchmark windows.

    Windows of all blocks of the benchmark are cut together, and a text is searched
    again after a removal, until no window of any block occurs. Documents of which no word is left are dropped if they lost words;
    texts without occurrences, null or empty ones too, pass as they are.
    """
    items = benchmark.select(text).distinct().withColumn(item, F.lit(""))
    if block_count(items, text) > 1:
        return _removed_by_blocks(docs, items, size, text, item)

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches, text, SHARD_BYTES):
                at = part.schema.get_field_index(text)
                texts = byte_texts(part.column(at))
                todo, lost = list(range(len(texts))), set()
                while todo:
                    found = search_shard(shared.value, [texts[i] for i in todo])
                    hits = [(i, n, spans) for i, (n, spans, _) in zip(todo, found) if spans]
                    for i, _, spans in hits:
                        texts[i] = without(texts[i], spans)
                    lost.update(i for i, n, spans in hits if n == sum(b - a for a, b in spans))
                    todo = [i for i, _, _ in hits]
                old = part.column(at)
                new = [t.decode() if v else None for v, t in zip(old.is_valid().to_pylist(), texts)]
                new = pa.array(new, part.schema.field(at).type)
                part = part.set_column(at, part.schema.field(at), new)
                yield part.filter(pa.array(i not in lost for i in range(part.num_rows)))

        return run

    out = docs
    for shared in phrase_blocks(items, item, text, size):
        out = out.mapInArrow(step(shared), docs.schema)
    return out


def _removed_by_blocks(docs: DataFrame, items: DataFrame, size: int, text: str, item: str) -> DataFrame:
    """The same for a benchmark of many blocks: one block is with the tasks at a time,
    and only the hits of each are written."""
    at, new, lost = "_row_of_removed", "_text_of_removed", "_lost_of_removed"
    numbered = written(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")

    def mark(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches, "text", SHARD_BYTES):
                found = search_shard(shared.value, byte_texts(part.column(1)))
                hits = [(k, n, list(chain.from_iterable(spans))) for k, (n, spans, _) in zip(part.column(0).to_pylist(), found) if spans]
                if hits:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits), kinds)], ["at", "n", "edges"])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            texts, gone = [], []
            for t, n, lists in zip(byte_texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                spans = merged([x for edges in lists for x in zip(edges[::2], edges[1::2])])
                texts.append(without(t, spans).decode())
                gone.append(n == sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(gone)], ["at", "text", "lost"])

    todo, done = numbered.select(F.col(at).alias("at"), F.col(text).alias("text")), None
    while True:
        hits = None
        for shared in phrase_blocks(items, item, text, size):
            now = written(todo.mapInArrow(mark(shared), "at bigint, n bigint, edges array<bigint>"), "hits")
            hits = now if hits is None else hits.unionAll(now)
            shared.destroy()
        hits = hits.groupBy("at").agg(F.first("n").alias("n"), F.collect_list("edges").alias("edges"))
        now = todo.join(hits, "at").select("at", "text", "n", "edges").mapInArrow(cut, "at bigint, text string, lost boolean")
        now = written(now, "cut")
        if now.isEmpty():
            break
        done = now if done is None else done.join(now, "at", "left_anti").unionAll(now)
        todo = now.where("not lost").select("at", "text")
    if done is None:
        return numbered.drop(at)
    out = numbered.join(done.select(F.col("at").alias(at), F.col("text").alias(new), F.col("lost").alias(lost)), at, "left")
    out = out.where(F.col(lost).isNull() | ~F.col(lost)).withColumn(text, F.coalesce(new, text))
    return out.select(*docs.columns)
