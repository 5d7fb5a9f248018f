"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives a few transformed statistics (length, vocabulary, repetition, symbols, layout). Per class, their mean and
covariance are summed over all labelled training rows; the covariance is shrunk towards the pooled one and towards a
multiple of the identity. A document's score is the difference of the two log densities, by Mahalanobis distances from
Cholesky factors that are made once, brought to a probability by a logistic curve fitted on a fold that the
covariances have not seen.

Edge cases: a null text counts as empty, and empty texts are scored like others; without labels of both classes every
score is the share of label 1 (0.5 without any label); rows with a null ``doc_id`` are scored, not learnt from; repeated
label rows count each; an empty table gives an empty result; further columns are kept untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved

HELD_OUT, CALIBRATES = 2, 3  # folds
POOLED, SPHERE = 0.1, 0.02  # shares of the pooled covariance and of the scaled identity
CUT = 0.7
BINS_PER_UNIT, LIMIT = 20, 60  # log-density differences are binned for the curve

NAMES = (
    "words", "word_length", "distinct", "repeats", "symbols", "marks", "digits", "capitals", "other_letters", "lines",
    "line_length", "repeated_lines", "bars", "entropy", "bigrams", "long_words",
)

_BYTES = np.arange(256)
_IS = {
    "symbols": np.isin(_BYTES, list(b"#$%&*@^~<>{}[]\\=+_/")),
    "marks": np.isin(_BYTES, list(b".,;:!?'\"()-")),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "capitals": (_BYTES >= 65) & (_BYTES <= 90),
    "other": _BYTES >= 192,  # first bytes of characters beyond ASCII
    "bars": np.isin(_BYTES, list(b"|")),
}
_SHARES = np.stack([_IS[k] for k in ("symbols", "marks", "digits", "capitals", "other", "bars")]).astype(float)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of ``NAMES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), data.split(b"\n")
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    total = max(len(data), 1)
    symbols, marks, digits, capitals, other, bars = np.log((_SHARES @ counts) / total + 1e-3).tolist()
    p = counts[counts > 0] / total
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    sizes = list(map(len, words))
    return [
        np.log1p(n),
        np.log1p(sum(sizes) / max(n, 1)),
        len(set(words)) / max(n, 1),
        np.log(same / max(n - 1, 1) + 1e-3),
        symbols, marks, digits, capitals, other,
        np.log1p(len(lines)),
        np.log1p(len(data) / len(lines)),
        np.log(1 - len(set(lines)) / len(lines) + 1e-2),
        bars,
        float(-(p * np.log(p)).sum()),
        pairs / max(n - 1, 1),
        np.log(sum(s > 20 for s in sizes) / max(n, 1) + 1e-3),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per document."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(collect, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor and log normaliser; then the curve to a probability."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 less that under label 0, a row per document."""
        if self.means is None:
            return np.zeros(len(x))
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.offsets)]
        return np.clip(logs[1] - logs[0], -LIMIT, LIMIT)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Label -> rows, sum of x, sum of x x'; each partition sends one row per label."""
    d = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            for label in np.unique(labels):
                own = x[labels == label]
                n, s, q = held.get(int(label), (0, np.zeros(d), np.zeros((d, d))))
                held[int(label)] = (n + len(own), s + own.sum(axis=0), q + own.T @ own)
        flat = [[float(n), *s, *q.ravel()] for n, s, q in held.values()]
        for label, values in zip(held, flat):
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)],
                ["label", "i", "v"],
            )

    sums = rows.mapInArrow(add, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for label in {r["label"] for r in sums}:
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r["label"] == label:
                v[r["i"]] = r["v"]
        out[label] = (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """Shrunk covariances and their factors."""
    counts = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
    if not all(counts.values()):
        n = sum(counts.values())
        share = counts[1] / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Discriminant(None, None, None, 1.0, float(np.log(share / (1 - share))))
    means = np.array([moments[k][1] / counts[k] for k in (0, 1)])
    spreads = [moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / sum(counts.values())
    # The identity is scaled per statistic, so that units do not matter.
    sphere = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, offsets = [], []
    for k in (0, 1):
        shrunk = (1 - POOLED - SPHERE) * spreads[k] + POOLED * pooled + SPHERE * sphere
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(-np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (difference, label, count), by Newton's method."""
    v, y, m = (np.array(c, float) for c in zip(*bins))
    w = np.array([1.0, np.log((m @ y + 1) / (m @ (1 - y) + 1))])
    x = np.stack([v, np.ones_like(v)], axis=1)
    w = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (m * (p - y)) + np.array([1e-3, 0]) * w
        hessian = (x.T * (m * p * (1 - p))) @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def _differences(model: Discriminant, rows: DataFrame) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = model.difference(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(v * BINS_PER_UNIT), pa.float64())], ["label", "v"])

    return rows.mapInArrow(score, "label int, v double").groupBy("label", "v").agg(F.count("*").alias("n"))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows outside the held-out fold; ``stats`` has (doc_id, x)."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    rows = saved(stats.join(known, "doc_id").select("label", "x", fold(F.col("doc_id")).alias("fold")), "labelled")
    first = discriminant(_moments(rows.filter(F.col("fold") != CALIBRATES).select("label", "x")))
    held = _differences(first, rows.filter(F.col("fold") == CALIBRATES).select("label", "x")).collect()
    model = discriminant(_moments(rows.select("label", "x")))
    if model.means is None or first.means is None or len({r["label"] for r in held}) < 2:
        return model
    slope, shift = curve([(r["v"] / BINS_PER_UNIT, r["label"], r["n"]) for r in held])
    return Discriminant(model.means, model.factors, model.offsets, slope, shift)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score), a row per document; only the text is looked at."""
    stats = saved(with_statistics(docs), "statistics")
    model = fit(stats, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return stats.mapInArrow(rate, "doc_id bigint, score double")
