"""Text quality by a regularised quadratic discriminant.

Statistics of a document, transformed so that they are about normal, are
modelled by one Gaussian per class. Means and covariances come from sums over
all labelled rows, gathered as partial sums of tasks; covariances are shrunk
towards a multiple of the identity by the share that the oracle-approximating
rule gives. A score is the difference of two log densities, each a Mahalanobis
distance by the class's Cholesky factor, computed once when the model is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import bucket, map_texts, written

NAMES = (
    "log_words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "bangs", "pipes",
    "beyond_ascii", "line_length", "repeated_lines", "distinct_words", "capital_words", "marked_words", "blank",
)

_KINDS = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (
        65 <= _b <= 90, 48 <= _b <= 57, _c in ".,;:?'\"()-", _c in "#$%&*+<=>@[\\]^_`{}~/", _c == "!", _c == "|",
        _b >= 128, _c in " \t\n\r\x0b\x0c",
    )


def _share(n: float, total: float) -> float:
    """A share on the scale of its log-odds, kept finite."""
    return float(np.log((n + 0.5) / (total - n + 0.5))) if total >= n else 0.0


def statistics(text: bytes) -> list[float]:
    """Of one whole text; an empty one has those of nothing."""
    bytes_ = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, digits, marks, symbols, bangs, pipes, beyond, blank = (bytes_ @ _KINDS).tolist()
    words, lines = text.split(), [x for x in text.splitlines() if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    n, size = len(words), len(text)
    capital = sum(map(bytes.isupper, words))
    marked = sum(1 for w in words if w[-1] in b"!#$%&*|@~^")
    return [
        np.log1p(n),
        np.log1p(lengths.mean() if n else 0.0),
        np.log1p(lengths.std() if n else 0.0),
        _share(upper, size), _share(digits, size), _share(marks, size), _share(symbols, size), _share(bangs, size),
        _share(pipes, size), _share(beyond, size),
        np.log1p(n / max(1, len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        # fewer words are distinct in longer texts: on the scale of n ** 0.8
        np.log1p(len(set(words))) - 0.8 * np.log1p(n),
        _share(capital, n), _share(marked, n), _share(blank, size),
    ]


@dataclass
class Gaussian:
    n: float
    mean: np.ndarray
    cov: np.ndarray
    factor: np.ndarray = field(init=False)
    log_det: float = field(init=False)

    def __post_init__(self) -> None:
        p = len(self.mean)
        trace, square = float(np.trace(self.cov)), float((self.cov**2).sum())
        # oracle-approximating shrinkage
        below = (self.n + 1 - 2 / p) * (square - trace**2 / p)
        share = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + trace**2) / below)
        shrunk = (1 - share) * self.cov + (share * trace / p + 1e-6) * np.eye(p)
        self.factor = np.linalg.inv(np.linalg.cholesky(shrunk))
        self.log_det = -2 * float(np.log(np.diag(self.factor)).sum())

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (((x - self.mean) @ self.factor.T) ** 2).sum(axis=1) - 0.5 * self.log_det


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    classes: list[Gaussian | None]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if None in self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.shift) / self.scale
        low, high = self.classes
        gap = high.log_density(z) - low.log_density(z) + np.log(high.n / low.n)
        # log densities of many statistics add up to more than they know
        return 1 / (1 + np.exp(-np.clip(gap / 2, -40, 40)))


def clear_labels(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(key, label) of keys that are labelled 0 or 1 and never both."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    both = marked.groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"), F.max(label).alias("top"))
    return both.where("label = top").select("key", F.col("label").cast("int").alias("label"))


def class_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per label: sums of 1, x and x xT over all rows (label, x), summed by Spark."""
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            label = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, p)
            for k in np.unique(label):
                some = np.hstack([np.ones(((label == k).sum(), 1)), x[label == k]])
                total[int(k)] = total.get(int(k), 0) + some.T @ some
        for k, m in total.items():
            n = m.size
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array(np.full(n, k, dtype=np.int32)),
                    "cell": pa.array(np.arange(n, dtype=np.int32)),
                    "value": pa.array(m.ravel()),
                }
            )

    sums = rows.mapInArrow(run, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["label"], np.zeros((p + 1) ** 2))[r["cell"]] = r["v"]
    return {k: v.reshape(p + 1, p + 1) for k, v in out.items()}


def fit(sums: dict[int, np.ndarray]) -> Model:
    p = len(NAMES)
    total = sum(sums.values(), np.zeros((p + 1, p + 1)))
    n = max(1.0, total[0, 0])
    shift = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - shift**2, 1e-6))
    classes: list[Gaussian | None] = []
    for k in (0, 1):
        s = sums.get(k)
        if s is None or s[0, 0] < 2:
            classes.append(None)
            continue
        mean = s[0, 1:] / s[0, 0]
        cov = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        classes.append(Gaussian(float(s[0, 0]), (mean - shift) / scale, cov / np.outer(scale, scale)))
    ones = sums[1][0, 0] if 1 in sums else 0.0
    return Model(shift, scale, classes, float(ones / total[0, 0]) if total[0, 0] else 0.5)


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``key``, held_out, score (that the label is 1), predicted.

    Labels of rows whose crc32 of the key, modulo ``parts``, is ``held`` are not
    learned; nor are keys with both labels, null labels or null keys. If a class
    has fewer than two rows, every score is the share of ones (0.5 without any
    label). Null texts count as empty and are scored like any. Repeated rows are
    scored row by row and learned as often, other columns are not looked at, an
    empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        x = np.array([statistics(t) for t in texts], dtype=np.float64)
        return {"key": batch.column(0), "x": pa.array(list(x), pa.list_(pa.float64()))}

    made = written(map_texts(columns, "text", f"key {kind}, x array<double>", work), "statistics")
    held_out = bucket(F.col("key"), parts) == held
    learned = made.where(~held_out).join(clear_labels(labels, label, key), "key").select("label", "x")
    model = docs.sparkSession.sparkContext.broadcast(fit(class_sums(learned)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x))], ["key", "score"])

    return made.mapInArrow(score, f"key {kind}, score double").select(
        F.col("key").alias(key), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
