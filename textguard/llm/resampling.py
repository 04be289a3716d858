"""Documents drawn so that they look like a target corpus (importance resampling).

Texts of a batch go through Arrow kernels as a whole: lower case, split by a
pattern, flattened, dictionary-encoded. Sequences of words come from the
dictionary numbers moved by one, each different pair gets its CRC once, and its
bucket is taken for every place. Buckets of all documents and of all target
texts are counted in tasks and added up by Spark; their log-ratios are the gains
that a second pass adds up for each document. Gumbel noise by key makes a draw
without replacement of the highest scores.

Places among the drawn are found without one order over all rows: scores are
whole numbers of a bounded range, so their counts say where each score begins,
and only rows of equal score are put in order together.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textguard.llm.common import offsets_of, segment_sums, sliced, written

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 7
#: Drawn: this many of so many documents that are long enough.
SHARE = (25, 100)
#: What is not in a word.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased (A-Z) words of all texts, and where each text's begin."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=GAPS)
    words = pc.list_flatten(lists)
    bounds = offsets_of(np.asarray(pc.list_value_length(lists)))
    real = np.asarray(pc.binary_length(words)) > 0  # a gap at an end leaves an empty word
    counts = segment_sums(real.astype(np.int64), bounds).astype(np.int64)
    return words.filter(pa.array(real)).dictionary_encode(), offsets_of(counts)


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all neighbouring pairs, where each text's words
    begin. Place i of the pairs is that of word i, or -1 for the last word of a text."""
    words, offsets = split_words(texts)
    codes = words.indices.to_numpy().astype(np.int64)
    known = words.dictionary.cast(pa.binary() if words.dictionary.type == pa.string() else pa.large_binary()).to_pylist()
    sums = np.fromiter(map(crc32, known), dtype=np.int64, count=len(known))
    pairs = np.full(len(codes), -1, dtype=np.int64)
    follows = np.ones(len(codes), dtype=bool)
    follows[offsets[1:][np.diff(offsets) > 0] - 1] = False
    here = np.flatnonzero(follows)
    distinct, place = np.unique(codes[here] * len(known) + codes[here + 1], return_inverse=True)
    left, right = np.divmod(distinct, max(1, len(known)))
    after = [b" " + w for w in known]
    # the CRC of a pair goes on from that of its first word
    crcs = map(crc32, map(after.__getitem__, right.tolist()), sums[left].tolist())
    pairs[here] = (np.fromiter(crcs, dtype=np.int64, count=len(distinct)) % buckets).take(place)
    return (sums % buckets).take(codes), pairs, offsets


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) of all features of all texts; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in sliced(batches, "text"):
            ones, pairs, _ = features(part.column(0), buckets)
            total += np.bincount(ones, minlength=buckets)
            total += np.bincount(pairs[pairs >= 0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log-ratio of the target's share of a bucket to the documents', smoothed
    by one, rounded down. What reaches the driver is one row for each bucket."""
    source = bucket_counts(docs, text, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, target_text, buckets).withColumnRenamed("n", "t")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in source.join(wanted, "bucket", "full").collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"] or 0, row["t"] or 0
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_words, n_features, weight (the mean gain, rounded down)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            ones, pairs, offsets = features(part.column(1), len(gain))
            # gains are whole numbers far below 2**53, so their sums as doubles are exact
            both = gain.take(ones) + np.where(pairs >= 0, gain.take(np.maximum(pairs, 0)), 0)
            total = segment_sums(both, offsets).astype(np.int64)
            words = np.diff(offsets)
            n = words + np.maximum(words - 1, 0)
            yield pa.RecordBatch.from_pydict(
                {"key": part.column(0), "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)}
            )

    columns = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    weighed = columns.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumnRenamed("key", key)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a key in thousandths, rounded down: the same wherever it is drawn."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: tuple[int, int] = SHARE, least: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """``scored`` (a written table of ``key``, n_words, n_features, weight, score)
    with the place of each drawn row."""
    fit = F.col("n_words") >= least
    # scores are whole numbers: gains lie within some tens of thousands, and noise below 23,000
    by_score = scored.where(fit).groupBy("score").count().orderBy(F.desc("score")).collect()
    wanted = share[0] * sum(r["count"] for r in by_score) // share[1]
    before, starts = 0, []
    for r in by_score:
        if before >= wanted:
            break
        starts.append((r["score"], before))
        before += r["count"]
    lowest = starts[-1][0] if starts else None
    chosen = fit & (F.col("score") >= F.lit(lowest)) if starts else F.lit(False)
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    if not starts:
        return rest
    # equal rows travel once, so that a key of very many rows doesn't meet in one task
    columns = scored.columns
    groups = scored.where(chosen).groupBy(*columns).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first(key), "n_words", "n_features", "weight")
    groups = groups.withColumn("_end", F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = scored.sparkSession.createDataFrame(starts, "score bigint, _before bigint")
    groups = groups.join(F.broadcast(first), "score")
    last = F.col("_before") + F.col("_end")
    places = groups.withColumn("rank", F.explode(F.sequence(last - F.col("_rows") + 1, last)))
    return rest.unionByName(
        places.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    )


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    share: tuple[int, int] = SHARE,
    least: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, n_words, n_features, weight, score, rank.

    Of the documents with ``least`` words or more, ``share`` (so many of so many,
    rounded down) of highest score have a rank from 1 on, ties by smaller key;
    all others have none. Texts without words, null ones too, weigh 0 and are
    never drawn. A null key counts as an empty one in the noise and comes first
    among equal scores. Repeated rows count and are drawn row by row; rows of
    equal key and score may change places. Other columns are not looked at. An
    empty table gives no rows; an empty target gives weights against a uniform one.
    """
    gain = gains(docs, target, text, target_text, buckets)
    scored = weigh(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return ranked(written(scored, "weighed"), share, least, key)
