"""Toxicity by a convolutional text classifier, trained in numpy.

A word and its beginnings are hashed to rows of tables, and the word's embedding
is their sum, so that inflected and compound forms share most of it. Filters of
several widths slide over a text, each keeps its largest response in the whole
text, and a logistic layer scores them. Training follows the positions of the
largest responses only, and rows met in very few of its texts stay at zero. All
labelled rows are learned from: shards of Spark tasks train on their own texts and
are averaged after each round. Thresholds for rejection are calibrated for each
language on a fifth of the labelled rows, all those that the weights were not
fitted to; scores know no language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import bucket, bucketed, byte_texts, map_texts, offsets_of, sliced
from textguard.llm.quality import clear_labels

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 16
#: A word's beginnings that have an embedding of their own (bytes), beside the whole.
BEGINNINGS = (4, 5)
#: A row of a table is learned if so many texts of the fit have it.
LEAST_TEXTS = 4
#: The fit goes through all labelled texts, in shards of about so many bytes: that many rounds at
#: least and at most, between them as many as make so many readings of a text.
SHARD_BYTES, ROUNDS, PASSES = 32 << 20, (4, 30), 48_000
#: Models that meet in one task when they are averaged.
FAN = 16
#: A language needs so many calibration rows of each class for a threshold of its own.
CALIBRATION_ROWS = 20
TABLES = 1 + len(BEGINNINGS)
#: Positions that are convolved at once.
CHUNK = 1 << 16

# words: letters, digits and bytes above ASCII; A-Z become a-z
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def word_ids(text: bytes) -> np.ndarray:
    """For each word the rows in each table; row 0 stands for no word."""
    words = text.translate(_FOLD).split()
    forms = [words, *([w[:n] for w in words] for n in BEGINNINGS)]
    h = [np.fromiter(map(crc32, x), dtype=np.uint32, count=len(words)) for x in forms]
    return np.stack([1 + x % np.uint32(BUCKETS - 1) for x in h]).astype(np.int64)


@dataclass
class Model:
    tables: np.ndarray  # (forms, BUCKETS, DIM)
    kernels: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return sum(table[rows] for table, rows in zip(self.tables, ids))

    def responses(self, e: np.ndarray) -> np.ndarray:
        """Of every position, for rows of embeddings with max(WIDTHS) - 1 more rows at the end."""
        n = len(e) - max(WIDTHS) + 1
        return np.hstack([sum(e[j : j + n] @ k[j] for j in range(len(k))) + b for k, b in zip(self.kernels, self.biases)])

    def pooled(self, ids: list[np.ndarray]) -> np.ndarray:
        """The largest response of each filter in each whole text, at least 0."""
        best = np.zeros((len(ids), FILTERS * len(WIDTHS)), dtype=np.float32)
        pad, more = np.zeros((TABLES, max(WIDTHS) - 1), dtype=np.int64), max(WIDTHS) - 1
        group: list[int] = []
        held = 0

        def flush() -> None:
            joined = np.concatenate([x for i in group for x in (ids[i], pad)], axis=1)
            at = offsets_of(ids[i].shape[1] + more for i in group)
            r = self.responses(self.embed(np.concatenate([joined, pad], axis=1)))
            best[group] = np.maximum(best[group], np.maximum.reduceat(r, at[:-1], axis=0))

        for i, x in enumerate(ids):
            n = x.shape[1]
            if n > CHUNK:  # a long text in overlapping chunks
                for lo in range(0, n, CHUNK):
                    r = self.responses(self.embed(np.concatenate([x[:, lo : lo + CHUNK + more], pad], axis=1)))
                    best[i] = np.maximum(best[i], r.max(axis=0))
                continue
            if group and held + n > CHUNK:
                flush()
                group, held = [], 0
            group.append(i)
            held += n + more
        if group:
            flush()
        return best

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.pooled([word_ids(t) for t in texts]) @ self.out + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


class Adam:
    def __init__(self, value: np.ndarray, rate: float) -> None:
        self.value, self.rate, self.step = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def update(self, slope: np.ndarray, rate: float | None = None) -> None:
        self.step += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope**2 - self.v)
        m, v = self.m / (1 - 0.9**self.step), self.v / (1 - 0.99**self.step)
        self.value -= ((rate or self.rate) * m / (np.sqrt(v) + 1e-6)).astype(self.value.dtype)


def start(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    scale = np.float32(1 / np.sqrt(DIM))
    model = Model(
        rng.normal(0, 0.05, (TABLES, BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, scale, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    model.tables[:, 0] = 0
    return model


def texts_of_rows(ids: Iterable[np.ndarray]) -> np.ndarray:
    """For each row of each table the number of texts that have it."""
    seen = np.zeros((TABLES, BUCKETS), dtype=np.int64)
    for x in ids:
        for t in range(TABLES):
            seen[t, np.unique(x[t])] += 1
    return seen


class Learner:
    """A model on its way: the weights, which rows of its tables it learns, and step sizes."""

    def __init__(self, model: Model, known: np.ndarray, ones: float, rate: float = 0.01) -> None:
        """``ones``: the share of class 1; both classes count alike."""
        self.model, self.known, self.rate = model, known.copy(), rate
        self.known[:, 0] = False
        model.tables[~self.known] = 0
        self.weights = np.array([0.5 / (1 - ones), 0.5 / ones])
        self.flat = [Adam(x, rate) for x in (*model.kernels, *model.biases, model.out)]
        self.offset = Adam(np.full(1, model.offset, dtype=np.float32), rate)

    def tops(self, joined: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each text and its place, found in chunks."""
        more, n = max(WIDTHS) - 1, len(at) - 1
        high = np.full((n, FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        top = np.repeat(at[:-1, None], high.shape[1], axis=1)
        for lo in range(0, int(at[-1]), CHUNK):
            r = self.model.responses(self.model.embed(joined[:, lo : lo + CHUNK + more]))
            for d in range(int(np.searchsorted(at, lo, side="right")) - 1, n):
                a, b = max(int(at[d]) - lo, 0), min(int(at[d + 1]) - lo, len(r))
                if a >= len(r):
                    break
                place = r[a:b].argmax(axis=0) + a
                value = r[place, np.arange(r.shape[1])]
                better = value > high[d]
                high[d, better], top[d, better] = value[better], place[better] + lo
        return high, top

    def step(self, ids: list[np.ndarray], labels: np.ndarray, step: float) -> None:
        """One step along the slopes of some texts."""
        model, more = self.model, max(WIDTHS) - 1
        pad = np.zeros((TABLES, more), dtype=np.int64)
        joined = np.concatenate([x for i in ids for x in (i, pad)] + [pad], axis=1)
        high, top = self.tops(joined, offsets_of(i.shape[1] + more for i in ids))
        pooled = np.maximum(high, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.offset, -40, 40)))
        slope = ((p - labels) * self.weights[labels] / len(ids)).astype(np.float32)
        back = slope[:, None] * model.out * (high > 0)
        slopes_k, slopes_b = [], []
        touched, amount = [], []
        for n, (w, k) in enumerate(zip(WIDTHS, model.kernels)):
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            g, where = back[:, cols], top[:, cols]
            slopes_b.append(g.sum(axis=0))
            slopes_k.append(np.stack([np.einsum("df,dfe->ef", g, model.embed(joined[:, where + j])) for j in range(w)]))
            for j in range(w):
                touched.append((where + j).ravel())
                amount.append((g[:, :, None] * k[j].T[None]).reshape(-1, DIM))
        for part, s in zip(self.flat, (*slopes_k, *slopes_b, pooled.T @ slope + 1e-4 * model.out)):
            part.update(s, step)
        self.offset.update(slope.sum(keepdims=True), step)
        model.offset = float(self.offset.value[0])
        touched, amount = np.concatenate(touched), np.concatenate(amount)
        size_of = np.sqrt((amount**2).sum(axis=1, keepdims=True)) + 1e-6
        push = (5 * step * amount / np.maximum(size_of, 0.02)).astype(np.float32)
        for t in range(TABLES):
            rows_of = joined[t, touched]
            some = self.known[t, rows_of]
            np.add.at(model.tables[t], rows_of[some], -push[some])

    def run(self, texts: list[bytes], labels: np.ndarray, done: float, rng: np.random.Generator, size: int = 64) -> None:
        """Once through the texts, in an order of its own, when a share of all rounds is done."""
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // size)):
            self.step([word_ids(texts[i]) for i in rows], labels[rows], self.rate / (1 + 4 * done))

    def parts(self) -> list[np.ndarray]:
        """All that is learnt besides the tables."""
        moving = [*self.flat, self.offset]
        return [x for a in moving for x in (a.value, a.m, a.v, np.array([float(a.step)]))]

    def put(self, tables: np.ndarray, parts: list[np.ndarray]) -> None:
        self.model.tables[:] = tables
        for i, a in enumerate([*self.flat, self.offset]):
            a.value[:], a.m[:], a.v[:], a.step = *parts[4 * i : 4 * i + 3], float(parts[4 * i + 3][0])
        self.model.offset = float(self.offset.value[0])


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Both classes count alike; an absent class leaves the start values."""
    model = start(seed)
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    seen = texts_of_rows(map(word_ids, texts))
    learner = Learner(model, seen >= LEAST_TEXTS, float((labels == 1).mean()), rate)
    rng = np.random.default_rng([seed, 1])
    for epoch in range(epochs):
        learner.run(texts, labels, epoch / epochs, rng, size)
    return model


def trained(dealt: DataFrame, shards: int) -> Model:
    """A model of all rows (label, text, row, part): in every round each shard goes once through its
    texts, then changes of a table's row are averaged over the shards that changed it, and
    all other weights over all shards by their texts."""
    spark = dealt.sparkSession
    dealt = dealt.select("label", "text", "row", "part")
    n, ones = dealt.agg(F.count("*"), F.sum("label")).head()
    model = start()
    if not n or ones in (0, n):
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sum((texts_of_rows(map(word_ids, byte_texts(p.column(0)))) for p in sliced(batches, "text")), np.zeros((TABLES, BUCKETS), dtype=np.int64))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some), "n": pa.array(seen.ravel()[some])})

    texts_with = dealt.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    places = texts_with.where(F.col("n") >= LEAST_TEXTS).select("place").toPandas()["place"].to_numpy(dtype=np.int64)
    known = np.zeros(TABLES * BUCKETS, dtype=bool)
    known[places] = True
    known = known.reshape(TABLES, BUCKETS)
    learner = Learner(model, known, ones / n)
    schema = "slot int, weights binary"

    def trainer(shared, epochs: range):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["row", "text"])
            before, parts, known, ones = pickle.loads(shared.value)
            own = Learner(start(), known, ones)
            own.put(before, parts)
            slot = int(frame["part"].iloc[0])
            texts, labels = [t.encode() for t in frame["text"]], frame["label"].to_numpy(dtype=np.int64)
            for epoch in epochs:
                own.run(texts, labels, epoch / rounds, np.random.default_rng([7, epoch, slot]))
            change = (own.model.tables - before).reshape(-1, DIM)
            places = np.flatnonzero((change != 0).any(axis=1)).astype(np.int32)
            times = np.ones(len(places), dtype=np.int32)
            out = places, change[places].astype(np.float16), times, [p.astype(np.float64) * len(texts) for p in own.parts()], len(texts)
            return pd.DataFrame({"slot": [slot], "weights": [pickle.dumps(out)]})

        return run

    def total(weights) -> tuple:
        """Sums of the changes of table rows and of how many shards changed them, of the others, of texts."""
        change, times = np.zeros((TABLES * BUCKETS, DIM), dtype=np.float32), np.zeros(TABLES * BUCKETS, dtype=np.int32)
        others, texts = None, 0
        for places, c, t, parts, n in map(pickle.loads, weights):
            change[places] += c
            times[places] += t
            others, texts = parts if others is None else [a + b for a, b in zip(others, parts)], texts + n
        some = np.flatnonzero(times).astype(np.int32)
        return some, change[some], times[some], others, texts

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        return pd.DataFrame({"slot": [int(frame["slot"].iloc[0]) // FAN], "weights": [pickle.dumps(total(frame["weights"]))]})

    rounds = min(ROUNDS[1], max(ROUNDS[0], PASSES // n))
    for epoch in range(rounds if shards > 1 else 1):
        now = spark.sparkContext.broadcast(pickle.dumps((model.tables, learner.parts(), known, ones / n)))
        some = dealt.groupBy("part").applyInPandas(trainer(now, range(epoch, epoch + 1) if shards > 1 else range(rounds)), schema)
        left = shards
        while left > 1:  # at most FAN models meet in one task, and one goes to the driver
            some = some.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(add, schema)
            left = -(-left // FAN)
        places, change, times, parts, texts = pickle.loads(some.head()["weights"])
        tables = model.tables.copy()
        tables.reshape(-1, DIM)[places] += change.astype(np.float32) / times[:, None]
        learner.put(tables, [p / texts for p in parts])
        now.destroy()
    return model


def thresholds(scored: DataFrame, share: float) -> tuple[dict[str, float], float]:
    """Thresholds by language and the general one, of all rows (lang, label, score).

    Rows are counted by steps of a hundredth in the logit of their score, with the
    smallest and largest score in each; so a task holds some thousand rows of a language.
    """
    s = F.least(F.greatest("score", F.lit(1e-18)), F.lit(1 - 1e-16))
    bins = scored.groupBy("lang", F.floor(F.log(s / (1 - s)) * 100).alias("bin")).agg(
        F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"), F.min("score").alias("low"), F.max("score").alias("high")
    )

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.groupby("bin", sort=False).agg({"ones": "sum", "zeros": "sum", "low": "min", "high": "max"}).sort_values("low", ascending=False)
        ones, zeros = frame["ones"].to_numpy(), frame["zeros"].to_numpy()
        if min(ones.sum(), zeros.sum()) < CALIBRATION_ROWS:
            return pd.DataFrame({"limit": np.zeros(0)})
        hit, wrong = np.cumsum(ones) / ones.sum() * share, np.cumsum(zeros) / zeros.sum() * (1 - share)
        i = int((2 * hit / (hit + wrong + share)).argmax())
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        return pd.DataFrame({"limit": [(low[i] + high[i + 1]) / 2 if i + 1 < len(low) else low[i]]})

    def of_language(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = best(frame)
        return found.assign(lang=pd.Series([key[0]] * len(found), dtype=object))

    own = {r["lang"]: r["limit"] for r in bins.groupBy("lang").applyInPandas(of_language, "limit double, lang string").collect()}
    whole = bins.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.min("low").alias("low"), F.max("high").alias("high"))
    general = whole.groupBy(F.lit("").alias("lang")).applyInPandas(best, "limit double").collect()
    return own, general[0]["limit"] if general else 0.5


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, key: str, text: str, lang: str | None):
    """The model, thresholds by language, and the threshold for all others, from all labelled
    rows: four fifths of them train the model, the scores of the last give the thresholds."""
    marked = clear_labels(labels.where(learn(F.col(key))), label, key)
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    name = F.coalesce(F.col(lang).cast("string"), F.lit("None")) if lang else F.lit("None")
    columns = docs.where(learn(F.col(key)) & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), name.alias("lang"), F.monotonically_increasing_id().alias("row")
    )
    aside = F.crc32(F.concat_ws("#", F.lit("fold"), "key").cast("binary")) % 5 == 0
    # the texts that train move twice: to their labels, and to the shards where rounds read them
    size = columns.select("key", F.octet_length("text").alias("size")).join(marked, "key").agg(F.sum("size")).head()[0]
    shards = max(1, (size or 0) // SHARD_BYTES)
    part = F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(shards)).cast("int")
    rows = columns.where(~aside).join(marked.hint("merge"), "key").select("label", "text", "row", part.alias("part"))
    model = trained(bucketed(rows, "part", "labelled"), shards)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if 0 < share < 1:
        share = min(max(share, 0.01), 0.99)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"key": batch.column(1), "lang": batch.column(2), "score": pa.array(shared.value.scores(texts))}

    # those set aside are scored where they are read, and only their scores meet the labels
    kind = docs.schema[key].dataType.simpleString()
    scored = map_texts(columns.where(aside).select("text", "key", "lang"), "text", f"key {kind}, lang string, score double", work)
    scored = scored.join(marked, "key").select("lang", "label", "score")
    return model, *thresholds(scored, share)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """One row per document: ``key``, held_out, score, predicted, threshold, rejected.

    ``rejected`` compares the score with the threshold of the row's language
    (the general one for null, unknown or rare languages); ``predicted`` with
    0.5. Labels of rows whose crc32 of the key, modulo ``parts``, is ``held`` are
    not learned; nor are keys with both labels, null labels or null keys. Null
    and empty texts are scored as texts without words. With no label of a class
    the weights stay as they start. Repeated rows and keys are scored row by row,
    other columns are not looked at, an empty table gives no rows.
    """
    model = fit(docs, labels, label, lambda k: bucket(k, parts) != held, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), (bucket(F.col(key), parts) == held).alias("held_out"), F.col(lang).alias("lang")
    )

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        net, own, general = shared.value
        return {
            "key": batch.column(0),
            "held_out": batch.column(2),
            "score": pa.array(net.scores(texts)),
            "threshold": pa.array((own.get(str(x), general) for x in batch.column(3).to_pylist()), pa.float64()),
        }

    out = map_texts(columns, "text", f"key {kind}, held_out boolean, score double, threshold double", work)
    return out.select(
        F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The documents, all columns kept, whose score is below their language's threshold."""
    model = fit(docs, labels, label, lambda k: bucket(k, parts) != held, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.schema.names

    def run(batches):
        net, own, general = shared.value
        for part in sliced(batches, text):
            scores = net.scores(byte_texts(part.column(names.index(text))))
            limits = [own.get(str(x), general) for x in part.column(names.index(lang)).to_pylist()]
            yield part.filter(pa.array(scores < np.array(limits)))

    return docs.mapInArrow(run, docs.schema)
