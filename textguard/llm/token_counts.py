"""Token counts by a sentencepiece model: lengths only, no ids leave a task.

A long text is a list of segments, each a run of blanks with the word that
follows. No piece of a suitable model has a word-start mark after another
character (checked when the model is loaded), so merges never cross the start
of a segment and the counts of segments add up. Batches are cut by bytes, the
segments that a batch holds for the first time go to the library in one call,
and each worker keeps the counts of the segments it has met.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import map_texts

#: Segments a worker remembers, and the longest that it does (bytes).
CACHE_SEGMENTS, CACHE_LONGEST = 1_000_000, 64
MARK = "▁"

_SEGMENT = re.compile(b" +[^ ]*")
_STATE: dict[str, tuple] = {}


def segments(text: bytes) -> list[bytes]:
    """Segments without their first blank: the library puts a mark in its place."""
    if not text:
        return []
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [x[1:] for x in _SEGMENT.findall(b" " + text)]
    return text.split(b" ")


def _load(path: str):
    """The model, and whether its texts may be cut at all."""
    if path not in _STATE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
        safe = all(MARK not in p.lstrip(MARK) for p in pieces)
        # white space must be kept as it is, with one mark put in front
        safe = safe and [model.encode(x) for x in ("a b", "a  b", "\ta ")] == [
            model.encode("a") + model.encode("b"),
            model.encode("a") + model.encode(" b"),
            model.encode("\ta") + [model.piece_to_id(MARK)],
        ]
        _STATE[path] = (model, safe, {})
    return _STATE[path]


def count_batch(path: str, texts: list[bytes]) -> list[int]:
    """Tokens of each text, equal to encoding every whole text."""
    model, safe, known = _load(path)
    mark = MARK.encode()
    cut = [segments(t) if safe and mark not in t else None for t in texts]
    if len(known) > CACHE_SEGMENTS:
        known.clear()
    fresh = {s for parts in cut if parts is not None for s in parts}.difference(known)
    fresh.discard(b"")
    words = list(fresh)
    known[b""] = 1  # one blank at the end of a text
    lengths = map(len, model.encode([w.decode() for w in words], num_threads=1)) if words else ()
    known.update(zip(words, lengths))
    out = [
        len(model.encode(t.decode())) if parts is None else sum(map(known.__getitem__, parts))
        for t, parts in zip(texts, cut)
    ]
    for w in words:
        if len(w) > CACHE_LONGEST:
            del known[w]
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated
    or null keys are counted row by row; other columns are not looked at; an
    empty table gives no rows. ``model`` is the path of a sentencepiece model
    that exists on every machine. No shuffle: a row is counted where it is read.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        counts = count_batch(model, texts)
        return {
            "key": batch.column(0),
            "n_bytes": pa.array(map(len, texts), pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
        }

    counted = map_texts(columns, "text", f"key {kind}, n_bytes bigint, n_tokens bigint", work)
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
