"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word, lower-cased, is the bag of its hashed character n-grams (with its borders) and itself. The vectors of all subwords
of a window of a few words are averaged and go through a linear softmax over the two labels. A document's log-odds are the
log-mean-exp of those of its windows, so that a few words in a long text are not averaged away; every window of the whole
text counts. Vectors and softmax are trained together on document labels; a misspelt or new word shares the n-grams, and
thus the vectors, of the words that were seen. Subwords that too few training documents hold keep the vector 0.

The training sample is bounded: at most ``SAMPLE`` labelled rows of each label, drawn by the hash of their id, of texts of
at most ``LONGEST`` characters. Scoring sees whole texts of any length, in pieces, with memory for one text.

Edge cases: a null or empty text, or one without a letter or digit, has one empty window and is scored by the bias; without
labels of both kinds every score is the share of label 1 (0.5 without any label); rows with a null ``doc_id`` are scored,
not learnt from; labels other than 0 and 1 are left out; of repeated label rows each is a row of the sample, and so is each
document row of a sampled id, within the same bound; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT, FOLDS = 0, 5
CUT = 0.5
SAMPLE = {0: 6144, 1: 4096}  # rows of each label, at most
LONGEST = 20_000  # characters of a text to learn from
WINDOW = 2  # words
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSIONS = 16
RARE = 1000  # a subword is learnt if it is in one of this many documents, and in two at least
STEPS = 32_768  # document visits of the training, in 4 to 40 rounds
BATCH = 64
RATE, DECAY = 0.5, 1e-6
SEED = 7

# A longer run of letters counts as several words, so that no word is unbounded.
_WORD = re.compile(r"\w{1,64}")
_AT_ONCE = 1 << 16  # words held at once; a multiple of the window
_CACHED = 400_000


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its n-grams."""
    bordered = f"<{word}>".encode()
    whole = bordered.decode()
    parts = [whole[i : i + n].encode() for n in GRAMS for i in range(len(whole) - n + 1)]
    return [zlib.crc32(p) % BUCKETS for p in (bordered, *parts)]


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a bounded number at a time; whole windows but for the last."""
    found = _WORD.finditer((text or "").lower())
    while words := [m.group() for m in islice(found, _AT_ONCE)]:
        yield words


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive, maybe empty, segments."""
    running = np.concatenate([[0.0], np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def log_mean_exp(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of consecutive segments, none of them empty."""
    sizes = np.diff(offsets)
    top = np.maximum.reduceat(values, offsets[:-1])
    total = np.add.reduceat(np.exp(values - np.repeat(top, sizes)), offsets[:-1])
    return top + np.log(total / sizes)


@dataclass(frozen=True)
class Bags:
    """Documents as windows, windows as words, words as subwords: the members of each level, and where each begins."""

    subword: np.ndarray
    word_start: np.ndarray
    word: np.ndarray
    window_start: np.ndarray
    document_start: np.ndarray


def bags(texts: Sequence[str | None]) -> Bags:
    known: dict[str, int] = {}
    words, windows, documents = [], [0], [0]
    for text in texts:
        found = [known.setdefault(w, len(known)) for part in pieces(text) for w in part]
        before = windows[-1]
        words.append(np.array(found, np.int32))
        windows += [before + min(i + WINDOW, len(found)) for i in range(0, max(len(found), 1), WINDOW)]
        documents.append(len(windows) - 1)
    held = [np.array(subwords(w), np.int32) for w in known]
    start = np.cumsum([0, *map(len, held)])
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    kept = frequent(flat(held), start, flat(words), np.array(windows), np.array(documents))
    inside = kept[flat(held)]
    return Bags(
        flat(held)[inside], np.concatenate([[0], np.cumsum(inside)])[start], flat(words), np.array(windows), np.array(documents)
    )


def frequent(subword, word_start, word, window_start, document_start) -> np.ndarray:
    """Which subwords are in enough documents."""
    counts = np.zeros(BUCKETS, np.int64)
    for low, high in zip(document_start[:-1], document_start[1:]):
        own = np.unique(word[window_start[low] : window_start[high]])
        if len(own):
            counts[np.unique(np.concatenate([subword[word_start[w] : word_start[w + 1]] for w in own]))] += 1
    return counts >= max(2, (len(document_start) - 1) // RARE)


@dataclass(frozen=True)
class Model:
    """``vectors`` (subword x dimension) and a softmax of ``weights`` (dimension x label) and ``bias`` (label)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    learnt: np.ndarray  # which subwords have a vector

    def odds(self) -> tuple[np.ndarray, float]:
        """What each subword adds to the log-odds of label 1 in an average, and the bias."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    none = np.zeros((BUCKETS, 1))
    return Model(none, np.zeros((1, 2)), np.array([math.log(1 - share), math.log(share)]), np.zeros(BUCKETS, bool))


def train(texts: Sequence[str | None], labels: Sequence[int], seed: int = SEED) -> Model:
    """Adaptive gradient descent on the cross-entropy of document labels."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    held, rng = bags(texts), np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    weights = rng.standard_normal((DIMENSIONS, 1)) / math.sqrt(DIMENSIONS) * np.array([[-0.5, 0.5]])
    bias = np.array([1.0, -1.0])
    seen = [np.full_like(a, 1e-8) for a in (vectors, weights, bias)]
    learnt = np.zeros(BUCKETS, bool)
    size = np.diff(held.word_start)

    for _ in range(int(np.clip(STEPS // len(y), 4, 40))):
        order = rng.permutation(len(y))
        for batch in np.array_split(order, max(1, len(y) // BATCH)):
            # The batch's documents, windows, distinct words and distinct subwords.
            firsts, lasts = held.document_start[batch], held.document_start[batch + 1]
            windows = np.concatenate([np.arange(a, b) for a, b in zip(firsts, lasts)])
            in_doc = lasts - firsts
            in_window = held.window_start[windows + 1] - held.window_start[windows]
            met = np.concatenate([held.word[held.window_start[a] : held.window_start[b]] for a, b in zip(firsts, lasts)])
            window_start = np.concatenate([[0], np.cumsum(in_window)])
            words, word_at = np.unique(met, return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size[words])])
            parts = held.subword[np.repeat(held.word_start[words] - starts[:-1], size[words]) + np.arange(starts[-1])]
            own, part_at = np.unique(parts, return_inverse=True)

            # Forward: average per window, softmax, log-mean-exp per document.
            apart = weights[:, 1] - weights[:, 0]
            per_word = segment_sums((vectors[own] @ apart)[part_at], starts)
            n = np.maximum(segment_sums(size[words][word_at], window_start), 1)
            odds = segment_sums(per_word[word_at], window_start) / n + bias[1] - bias[0]
            pooled = log_mean_exp(odds, np.concatenate([[0], np.cumsum(in_doc)]))
            p = 1 / (1 + np.exp(-np.clip(pooled, -40, 40)))

            # Backward: each window's part in its document's error, then each subword's.
            share = np.exp(odds - np.repeat(pooled, in_doc)) / np.repeat(in_doc, in_doc)
            error = np.repeat((p - y[batch]) / len(batch), in_doc) * share
            of_word = np.bincount(word_at, np.repeat(error / n, in_window), len(words))
            of_part = np.bincount(part_at, np.repeat(of_word, size[words]), len(own))
            steps = (
                (vectors, seen[0], own, np.outer(of_part, apart) + DECAY * vectors[own], RATE),
                (weights, seen[1], slice(None), np.outer(vectors[own].T @ of_part, [-0.5, 0.5]), RATE / 10),
                (bias, seen[2], slice(None), error.sum() * np.array([-0.5, 0.5]), RATE / 2),
            )
            learnt[own] = True
            for values, squares, at, gradient, rate in steps:
                squares[at] += gradient**2
                values[at] -= rate * gradient / np.sqrt(squares[at])
    return Model(vectors, weights, bias, learnt)


class Scorer:
    """Log-odds of whole texts; the sums of words met before are kept, up to a bound."""

    def __init__(self, model: Model):
        adds, self.bias = model.odds()
        self.adds = np.where(model.learnt, adds, 0.0).astype(np.float64)
        self.learnt = model.learnt
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        found = self.known.get(word)
        if found is None:
            parts = np.array(subwords(word))
            parts = parts[self.learnt[parts]]
            found = float(self.adds[parts].sum()), len(parts)
            if len(self.known) >= _CACHED:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> float:
        top, total, windows = -math.inf, 0.0, 0
        for words in pieces(text):
            sums = np.zeros((-(-len(words) // WINDOW) * WINDOW, 2))
            sums[: len(words)] = [self.word(w) for w in words]
            sums = sums.reshape(-1, WINDOW, 2).sum(axis=1)
            odds = sums[:, 0] / np.maximum(sums[:, 1], 1) + self.bias
            here = odds.max()
            if here > top:
                total, top = total * math.exp(top - here), here
            total += np.exp(odds - top).sum()
            windows += len(odds)
        pooled = top + math.log(total / windows) if windows else self.bias
        return 1 / (1 + math.exp(-min(max(pooled, -40.0), 40.0)))


def fold(doc_id: Column) -> Column:
    """Remainder 0..4 of the CRC-32 of the id's decimal text; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % FOLDS).cast("int")


def sample(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, longest: int = LONGEST) -> DataFrame:
    """(text, label): labelled rows outside the held-out fold, at most ``most`` of each label."""
    most = SAMPLE if most is None else most
    key, drawn = F.col("_id"), F.xxhash64("_id", F.lit(SEED))
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    known = known.filter(fold(key) != HELD_OUT)
    by_label = [known.filter(F.col("_label") == v).orderBy(drawn, "_id").limit(n) for v, n in most.items()]
    chosen = by_label[0].unionByName(by_label[1])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").filter(F.length("text") <= longest)
    # The chosen rows are bounded by ``most``, whatever the tables' size.
    met = texts.join(F.broadcast(chosen), "_id")
    return met.orderBy(drawn, F.xxhash64("text")).limit(sum(most.values())).select("text", F.col("_label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels).toArrow()
    return train(rows.column("text").to_pylist(), rows.column("label").to_pylist())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score), a row per document; only the text is looked at."""
    model = fit(docs, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            p = [scorer(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rate, "doc_id bigint, score double")
