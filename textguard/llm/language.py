"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of it, a logistic classifier over
hashed byte n-grams says whether a text's language has that bit. A text gets
the language whose codeword costs least under the classifiers' losses, weighted
by how well each bit was learned; if the second costs about as little, the
answer is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import bucket, map_texts

#: Features are hashed to this many numbers; long texts are counted in windows.
BUCKETS, WINDOW_BYTES = 8192, 1 << 20
#: The fit takes about so many texts of each language, of all languages together
#: and, where there are very many, at least of each.
FIT_PER_LANGUAGE, FIT_TEXTS, FIT_LEAST = 400, 12_800, 16
UNKNOWN = "und"
AMBIGUOUS = 1.0

# a-z fold upper case, bytes above ASCII stand for themselves, all else is one blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed runs of two and three bytes over the whole text."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    folded = b" " + text.translate(_FOLD) + b" "
    for lo in range(0, max(1, len(folded) - 2), WINDOW_BYTES):
        x = np.frombuffer(folded[lo : lo + WINDOW_BYTES + 2], dtype=np.uint8).astype(np.uint32)
        two = x[:-1] * np.uint32(257) + x[1:]
        h = two[:-1] * np.uint32(0x9E3779B1) + x[2:] * np.uint32(0x85EBCA6B)
        out += np.bincount(h >> np.uint32(19), minlength=BUCKETS)
        out += np.bincount((two[:-1] * np.uint32(0xC2B2AE35)) >> np.uint32(19), minlength=BUCKETS)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    return scaled(np.array([ngram_counts(t) for t in texts], dtype=np.float32).reshape(-1, BUCKETS))


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Rows of -1 and 1. All divisions for few classes, else the random code
    with the largest smallest distance of some tries."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        columns = np.arange(1, 2 ** (n - 1))
        return np.where((columns[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, int(10 * np.ceil(np.log2(n)))))
        code = code[:, abs(code.sum(axis=0)) < n]  # a bit that all have tells nothing
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the second is about as near."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        unsure = np.ones(len(texts), dtype=bool)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            loss = self.losses(features([texts[i] for i in some]))
            best = loss.argmin(axis=1)
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            score[some] = 1 / p.sum(axis=1)
            ordered = np.sort(loss, axis=1)
            unsure[some] = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else False
            for i, b in zip(some, best):
                names[i] = self.languages[b]
        return names, score, unsure


def fit(x: np.ndarray, labels: list[str], epochs: int = 40, rate: float = 4.0, seed: int = 3) -> Model:
    """``x``: features of the texts that ``labels`` belong to."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[name] for name in labels]].astype(np.float32) if labels else np.zeros((0, code.shape[1]))
    w, b = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    if not code.shape[1]:
        return Model(languages, code, w, b, np.ones(0))
    # languages count alike, whatever their share of the sample
    size = Counter(labels)
    weight = np.array([len(labels) / len(languages) / size[name] for name in labels], dtype=np.float32)[:, None]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            slope = -y[rows] * weight[rows] / (1 + np.exp(y[rows] * (x[rows] @ w + b)))
            step = rate / (1 + epoch / 10) / len(rows)
            w -= (step * (x[rows].T @ slope)).astype(np.float32) + step * 1e-3 * w
            b -= (step * slope.sum(axis=0)).astype(np.float32)
    right = (np.sign(x @ w + b) == y).mean(axis=0)
    trust = np.maximum(np.log((right + 0.01) / (1.01 - right)), 0.05)
    return Model(languages, code, w, b, trust / trust.mean())


def sample(docs: DataFrame, language: str, text: str) -> DataFrame:
    """(label, at, n): n-gram counts above zero of whole texts, about FIT_PER_LANGUAGE of
    each language, fewer where there are more than FIT_TEXTS / FIT_PER_LANGUAGE languages.

    Rows are drawn one by one, by a hash of their number in the input, so it does not
    matter how often a key or a text is repeated. Only counts leave a task.
    """
    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(language).alias("label"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    counts = rows.groupBy("label").count().collect()  # a row for each language
    each = max(FIT_LEAST, min(FIT_PER_LANGUAGE, FIT_TEXTS // max(1, len(counts))))
    rates = docs.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "name string, rate double")
    draw = F.pmod(F.xxhash64("row", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(rates), F.col("label") == F.col("name")).where(draw < F.col("rate"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        made = [ngram_counts(t) for t in texts]
        at = [np.flatnonzero(x) for x in made]
        return {
            "label": batch.column(0),
            "at": pa.array([i.astype(np.int32) for i in at], pa.list_(pa.int32())),
            "n": pa.array([x[i].astype(np.float32) for x, i in zip(made, at)], pa.list_(pa.float32())),
        }

    return map_texts(chosen.select("label", "text"), "text", "label string, at array<int>, n array<float>", work)


def predict_language(
    docs: DataFrame, parts: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", language: str = "lang"
) -> DataFrame:
    """One row per document: ``key``, held_out, lang_pred, score, ambiguous.

    Rows whose crc32 of the key, modulo ``parts``, is ``held`` are never learned
    from. Null texts and texts without a letter are ``und`` with score 0; so are
    all if no language can be learned. Repeated rows and repeated or null keys
    are answered row by row, other columns are not looked at, an empty table
    gives no rows.
    """
    held_out = bucket(F.col(key), parts) == held
    rows = sample(docs.where(~held_out), language, text).collect()
    rows.sort(key=lambda r: (r["label"], r["at"], r["n"]))
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
    model = fit(scaled(x), [r["label"] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held_out"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        names, score, unsure = shared.value.predict(texts)
        return {
            "key": batch.column(0),
            "held_out": batch.column(2),
            "lang_pred": pa.array(names, pa.string()),
            "score": pa.array(score),
            "ambiguous": pa.array(unsure),
        }

    out = map_texts(columns, "text", f"key {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean", work)
    return out.withColumnRenamed("key", key)
