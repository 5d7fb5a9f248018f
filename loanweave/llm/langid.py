"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed counts of character 1- to 3-grams over letters and word borders. Document frequencies cover all
training documents. The weights are learnt by follow-the-regularised-leader with an elastic net, whose first-order part
leaves most weights at exactly zero, on a bounded sample of labelled rows: about ``SAMPLE`` of them, drawn by the hash of
the id, evenly from each language, so that a rare one gives all its rows. Each round trains one learner per shard of the sample from the common state, then averages the states. A
temperature, fitted on about ``CALIBRATION`` further rows that the weights have not seen, makes the scores calibrated.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no row has a label; rows
with a null ``doc_id`` or ``lang`` are predicted, but not learnt from; repeated rows are rows of their own; an empty table
gives an empty result; further columns are kept untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved

UNKNOWN = "und"
WIDTH = 1 << 15  # n-gram buckets
SAMPLE = 8192
CALIBRATION = 4096
HELD_OUT, CALIBRATES = 2, 3  # folds
SHARDS, ROUNDS = 4, 3

# Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_LETTER = r"\p{L}"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Counts of the n-gram buckets of a text, ``WIDTH`` long."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    border = codes == 32
    keep = ~border
    keep[1:] |= border[1:] & ~border[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ codes[1:]) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ codes[2:]) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    hashed = np.concatenate((one[codes != 32], two, three)) >> shift
    return np.bincount(hashed, minlength=WIDTH)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of length 1."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the accumulated gradients lead to: zero up to ``L1``, else shrunk."""
    shrunk = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, shrunk)


def ftrl_step(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int) -> None:
    """One document, in place; only its buckets change."""
    w = ftrl_weights(z[at], n[at])
    p = _softmax(x @ w)
    p[label] -= 1.0
    g = x[:, None] * p
    more = n[at] + g * g
    z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
    n[at] = more


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = weighted(grams(text), self.idf)
        return x @ self.weights[at]


def _document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are; summed over all of them by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += grams(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["bucket", "n"]
        )

    sums = texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(WIDTH, np.int64)
    total = 0
    for bucket, n in sums:  # WIDTH rows at most
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    return frequency, total


def fit(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> LanguageModel | None:
    """Learn from the labelled documents outside the held-out fold; None if there are none."""
    labelled = docs.select(F.col("doc_id").cast("bigint"), "text", F.col("lang").cast("string")).filter(
        F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT) & F.col("text").rlike(_LETTER)
    )
    frequency, total = _document_frequency(labelled.select("text"))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + frequency)) + 1
    fits = fold(F.col("doc_id")) != CALIBRATES
    counted = labelled.groupBy("lang", fits.alias("fits")).agg(F.count("*").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})

    def drawn(rows: DataFrame, of: bool, n: int) -> DataFrame:
        """About ``n`` of the rows, as evenly from each language as it has them."""
        have = {r["lang"]: r["n"] for r in counted if r["fits"] == of}
        most = even_share(list(have.values()), n)
        rates = {name: min(1.0, most / m) for name, m in have.items()}
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
        all_of = [name for name, rate in rates.items() if rate == 1.0]
        part_of = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("lang") == k, F.lit(r)) for k, r in rates.items() if r < 1.0])
        return rows.filter(F.col("lang").isin(all_of) | F.coalesce(draw < part_of, F.lit(False)))

    learning = drawn(labelled.filter(fits), True, sample)
    place = {name: i for i, name in enumerate(languages)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [weighted(grams(t.as_py()), idf) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([place[name.as_py()] for name in batch.column(2)], pa.int32()),
                    pa.array([at.astype(np.int32) for at, _ in pairs], pa.list_(pa.int32())),
                    pa.array([x.astype(np.float32) for _, x in pairs], pa.list_(pa.float32())),
                ],
                ["doc_id", "label", "at", "x"],
            )

    rows = saved(
        learning.mapInArrow(features, "doc_id bigint, label int, at array<int>, x array<float>").withColumn(
            "shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
        ),
        "language-sample",
    )
    shape = (WIDTH, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)

    def learner(z0: np.ndarray, n0: np.ndarray, turn: int):
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            z, n = z0.copy(), n0.copy()
            order = np.random.default_rng(turn).permutation(len(pdf))
            pdf = pdf.sort_values("doc_id", kind="stable").iloc[order]
            for at, x, label in zip(pdf["at"], pdf["x"], pdf["label"]):
                ftrl_step(z, n, np.asarray(at), np.asarray(x, np.float64), label)
            return pd.DataFrame({"z": [z.tobytes()], "n": [n.tobytes()], "rows": [len(pdf)]})

        return learn

    for turn in range(ROUNDS):
        states = rows.groupBy("shard").applyInPandas(learner(z, n, turn), "z binary, n binary, rows bigint").collect()
        seen = sum(s["rows"] for s in states)
        if seen:
            z = sum(np.frombuffer(s["z"]).reshape(shape) * s["rows"] for s in states) / seen
            n = sum(np.frombuffer(s["n"]).reshape(shape) * s["rows"] for s in states) / seen
    model = LanguageModel(languages, idf, ftrl_weights(z, n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [model.logits(t.as_py()).tolist() for t in batch.column(1)]
            labels = [place[name.as_py()] for name in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(logits, pa.list_(pa.float64()))], ["label", "logits"]
            )

    checked = (
        drawn(labelled.filter(~fits), False, calibration).mapInArrow(score, "label int, logits array<double>").collect()
    )
    return LanguageModel(languages, idf, model.weights, temperature_of(checked))


def even_share(counts: list[int], total: int) -> float:
    """The number at which each count is cut so that they sum up to ``total``; infinite if they do not reach it."""
    left, counts = total, sorted(counts)
    for i, n in enumerate(counts):
        if n * (len(counts) - i) >= left:
            return left / (len(counts) - i)
        left -= n
    return float("inf")


def temperature_of(rows: list) -> float:
    """The temperature of least cross entropy, by golden-section search over its logarithm."""
    if not rows:
        return 1.0
    labels = np.array([r["label"] for r in rows])
    logits = np.array([r["logits"] for r in rows])
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Documents with ``lang_pred`` and ``score``. Only the text is looked at."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    best = _best(model)
    readable = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    found = docs.withColumn("_p", F.when(readable, best(F.when(readable, F.col("text")))))
    return found.withColumns(
        {
            "lang_pred": F.coalesce(F.col("_p.lang"), F.lit(UNKNOWN)),
            "score": F.coalesce(F.col("_p.score"), F.lit(0.0)),
        }
    ).drop("_p")


def _best(model: LanguageModel):
    @F.pandas_udf("lang string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for text in texts:
            if text is None or not text:
                names.append(None)
                scores.append(0.0)
                continue
            p = _softmax(model.logits(text) / model.temperature)
            names.append(model.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return pd.DataFrame({"lang": names, "score": scores})

    return best


def identify(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """Fit on the labelled documents and predict all."""
    return predict(docs, fit(docs, sample, calibration))
