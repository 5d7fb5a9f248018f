"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets form a class, and only classes are compared. Each class has a signature of
``COORDINATES`` minima and is posted under its (coordinate, value) pairs. Two classes are candidates if they agree in at
least ``MATCHES`` coordinates. To agree that often, they must share a pair among the ``COORDINATES - MATCHES + 1`` rarest
pairs of each (*prefix*), so only those are joined; frequent pairs, such as those of a passage that very many documents
share, are *skipped* while merging and only compared when a candidate is counted. A class with fewer than ``MATCHES``
pairs known to others has no candidate at all. Candidates are confirmed on the full shingle sets.

No list of postings is expanded to all its pairs. Each class in a list is first paired with leaders of the list, in
two rounds, which joins a group of near copies by as many pairs as it has members. What remains are lists that hold classes of
different components; there, and only there, classes of different components are paired, so no link between components
is lost.

Of two documents with similarity 0.75, fewer than ``MATCHES`` of 64 coordinates agree with probability 5e-5 or less;
above that, the chance falls quickly.

Edge cases: a null or empty text has no set and is linked with nothing; fewer than five words are one shingle; repeated
rows and copies share a class; a row with a null ``doc_id`` takes part, but gives its component no id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
MATCHES = 34
SEED = 20_011

# The longer signature: coordinates, 16 of which share a number; and how many standard deviations below the expected
# count of a pair at the threshold a count may lie.
SKETCH = 1024
PER_NUMBER = 16
FIRST = 8  # numbers that are looked at first
DEVIATIONS = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII letters lower-cased, words cut at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, in both steps
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


class Signer:
    """The smallest value of a set under each of a number of hash functions, as 32 bits."""

    def __init__(self, coordinates: int, seed: int):
        rng = np.random.default_rng(seed)
        self.masks = rng.integers(0, 2**64, coordinates, np.uint64)
        self.factors = rng.integers(0, 2**64, coordinates, np.uint64) | np.uint64(1)

    def __call__(self, hashes: np.ndarray, step: int = 2048) -> np.ndarray:
        smallest = np.full(len(self.masks), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), step):
            block = (hashes[i : i + step, None] ^ self.masks) * self.factors
            smallest = np.minimum(smallest, block.min(axis=0))
        return (smallest >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, kind)))


def _set_key(hashes: np.ndarray) -> bytes | None:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def signatures(docs: DataFrame, coordinates: int = COORDINATES, seed: int = SEED) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) per document; the last two are null or empty for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(coordinates, seed)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                sizes.append(len(found))
                keys.append(_set_key(found))
                sigs.append(signer(found) if len(found) else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sigs, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, sig array<int>")


def packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, ``PER_NUMBER`` coordinates to a 64-bit number."""
    digits = (signature.view(np.uint32) & np.uint32(15)).astype(np.uint64).reshape(-1, PER_NUMBER)
    return (digits << (np.arange(PER_NUMBER, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(set_key, hashes, sketch) per document that has words."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(SKETCH, seed + 1)
        for batch in batches:
            for at in range(0, len(batch), 64):  # the sets of few documents at a time
                sets = [s for s in (shingles(t.as_py()) for t in batch.column(0)[at : at + 64]) if len(s)]
                keys = pa.array([_set_key(s) for s in sets], pa.binary())
                lists = _lists([s.view(np.int64) for s in sets], np.int64)
                sketches = _lists([packed(signer(s, 256)) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([keys, lists, sketches], ["set_key", "hashes", "sketch"])

    return docs.select("text").mapInArrow(collect, "set_key binary, hashes array<bigint>, sketch array<bigint>")


def least_count(coordinates: int, percent: int) -> int:
    """Agreeing digits that a pair at the threshold has almost surely; unlike values share a digit 1 time in 16."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(coordinates * p - DEVIATIONS * (coordinates * p * (1 - p)) ** 0.5)


def _differing(a: Column, b: Column) -> Column:
    """In how many of their 16 digits two numbers differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def similar_sketches(a: Column, b: Column, percent: int) -> tuple[Column, Column]:
    """Whether the first numbers, and all of them, agree often enough."""
    head = sum((_differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(FIRST)), F.lit(0))
    counts = F.zip_with(a, b, _differing)
    whole = F.aggregate(counts, F.lit(0), lambda total, x: total + x)
    first = FIRST * PER_NUMBER
    return head <= first - least_count(first, percent), whole <= SKETCH - least_count(SKETCH, percent)


def agreeing(a: Column, b: Column) -> Column:
    """In how many coordinates two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(pair, cid): the postings of each class that can lead to a candidate, rarest pairs first."""
    posted = classes.select("cid", F.posexplode("sig").alias("i", "v")).select(
        "cid", F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("pair")
    )
    shared = posted.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    # Pairs of one class only come first in the order and lead nowhere; they use up places of the prefix.
    known = posted.join(shared.hint("shuffle_hash"), "pair").groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("pairs")
    )
    places = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("pairs"))
    able = known.filter(F.size("pairs") >= matches)
    return able.select("cid", F.explode(F.slice("pairs", F.lit(1), places)).alias("p")).select("p.pair", "cid")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    union = F.size("left") + F.size("right") - F.col("common")
    return both.filter(F.col("common") * 100 >= union * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per document."""
    signed = saved(signatures(docs, coordinates, seed), "signatures")
    groups = signed.filter("n_shingles > 0").groupBy("set_key")
    # The numbers are fixed by writing them.
    classes = saved(
        groups.agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("cid"), "*"),
        "classes",
    )
    postings = saved(prefixes(classes, coordinates, matches), "postings")

    able = saved(classes.join(postings.select("cid").distinct(), "cid", "left_semi"), "able")
    texts = docs.join(
        able.select(F.col("first_doc").alias("_first")).distinct().hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("_first")),
        "left_semi",
    )
    hashed = shingle_sets(texts, seed).join(able.select("set_key", "cid"), "set_key")
    sets = saved(hashed.select("cid", "hashes", "sketch"), "shingle-sets")

    def counted(pairs: DataFrame) -> DataFrame:
        left = able.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
        right = able.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
        both = pairs.distinct().join(left, "a").join(right, "b")
        sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        return both.filter(sizes & (agreeing(F.col("sig_a"), F.col("sig_b")) >= matches)).select("a", "b")

    def starred(labelled: DataFrame, orders: list[Column]) -> DataFrame:
        """Pair the classes of each list with its leaders in other components; grows with the postings."""
        least = [F.min_by(F.struct("cid", "root"), order) for order in orders]
        leaders = labelled.groupBy("pair").agg(F.array(*least).alias("leaders"))
        led = labelled.join(leaders, "pair").select("cid", "root", F.explode("leaders").alias("l"))
        across = led.filter("root <> l.root")
        return across.select(F.least("cid", "l.cid").alias("a"), F.greatest("cid", "l.cid").alias("b"))

    def with_roots(roots: DataFrame) -> DataFrame:
        return postings.join(roots, postings["cid"] == roots["node"], "left").select(
            "pair", "cid", F.coalesce("root", "cid").alias("root")
        )

    alone = postings.withColumn("root", F.col("cid"))
    links = saved(_confirmed(counted(starred(alone, [F.col("cid"), F.xxhash64("cid")])), sets, percent), "links")
    roots = components(links)
    # Again with a leader of the list's first component, another in each list, for what the first leaders missed.
    order = F.struct("root", F.xxhash64("cid", "pair"))
    links = saved(
        links.unionByName(_confirmed(counted(starred(with_roots(roots), [order])), sets, percent)), "links"
    )
    roots = components(links)

    # Lists that still hold several components: pair across components.
    labelled = with_roots(roots)
    spread = labelled.groupBy("pair").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2")
    lists = postings.groupBy("cid").agg(F.collect_list("pair").alias("pairs"))
    mixed = labelled.join(spread, "pair", "left_semi").join(able.select("cid", "n"), "cid")
    mixed = saved(mixed.join(lists, "cid").join(sets.select("cid", "sketch"), "cid"), "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    head, whole = similar_sketches(F.col("x.sketch"), F.col("y.sketch"), percent)
    across = (
        (F.col("x.pair") == F.col("y.pair"))
        & (F.col("x.cid") < F.col("y.cid"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
        & head
        & (F.array_min(F.array_intersect("x.pairs", "y.pairs")) == F.col("x.pair"))
        & whole
    )
    rest = x.join(y, across).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    more = saved(_confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    in_class = classes.join(roots, classes["cid"] == roots["node"], "left").select(
        "set_key", "first_doc", F.coalesce("root", "cid").alias("root")
    )
    smallest = in_class.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    found = in_class.join(smallest, "root").select("set_key", "component_id")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = signed.filter("n_shingles > 0").join(found, "set_key").select("doc_id", "n_shingles", "component_id")
    return rows.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
