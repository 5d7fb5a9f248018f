"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Vectors are compared by the angle between them, so they are scaled to length 1. Equal vectors form a class. On a bounded
sample, iterative quantisation learns rotations of the centred vectors, whose signs are balanced codes wherever the vectors
lie, also if they have a direction in common. Each class gets such a code, cut into substrings, one per table. Classes that
agree in a substring of any table and are close in a check code are reranked by the cosine of their original vectors.

Dense groups are not expanded: in each table bucket the smallest class is a leader, and a class within half the
threshold angle of a leader joins its *ball*. Any two members of a ball are linked for certain, by the triangle
inequality of angles, so they are only counted. Pairs are made between classes of different balls.

Substrings are as long as it takes for buckets to stay small, by the collisions measured in the sample; the number of
tables follows from the wanted recall of pairs that are just at the threshold, whose angle is wider as seen from the centre
than from the origin. Where most vectors lie within the threshold of their common direction, most pairs are links, and the
work is that of comparing them.

Edge cases: a vector that is null, empty, zero or has a null or non-finite component is linked with nothing; vectors of
different lengths are never linked; repeated rows are linked like any copies; a null ``vec_id`` is counted, but names no
component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved

COSINE = 0.9
RECALL = 0.97  # of pairs exactly at the threshold, under independent bits
SAMPLE = 4096  # vectors that the rotations are learnt from
MEASURED = 2048  # of them, for the centre and for collisions of vectors that are not linked
ROUNDS = 8
CHECK_BITS = 64
SHORTEST, LONGEST = 4, 30  # bits of a substring
NEIGHBOURS = 1.0  # that share a bucket with a class, on average
MOST_TABLES = 512
TRIAL_BITS = 8 * LONGEST  # that collisions are measured with
ORIGIN_TABLES = 4  # from the origin, for leaders only
SEED = 7


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


@dataclass(frozen=True)
class Coder:
    """Codes of vectors of one length: signs of the projections of centred vectors, and of others as they are."""

    centre: np.ndarray
    projection: np.ndarray
    width: int  # bits of a substring
    tables: int
    turn: float  # angle of a threshold pair as seen from the centre, in half turns
    origin: np.ndarray
    origin_width: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.projection >= 0

    def substrings(self, x: np.ndarray, bits: np.ndarray) -> list[int]:
        """Of the centred code, then of the code from the origin."""
        own = bits[CHECK_BITS:].reshape(self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))
        plain = (x @ self.origin >= 0).reshape(ORIGIN_TABLES, self.origin_width)
        return own.tolist() + (plain @ (1 << np.arange(self.origin_width, dtype=np.int64))).tolist()

    def near(self) -> int:
        """Differing check bits that a threshold pair stays below, but for four deviations."""
        return int(CHECK_BITS * self.turn + 4 * math.sqrt(CHECK_BITS * self.turn * (1 - self.turn)))


def rotations(v: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotations of centred principal components whose signs quantise them with the least error |sign(VR) - VR|.

    Alternately take the signs, then the best rotation for them (orthogonal Procrustes). Codes longer than the vector use
    several rotations, each from another random start.
    """
    dims, rng, parts = v.shape[1], np.random.default_rng(seed), []
    for _ in range(-(-bits // dims)):
        rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(rounds):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            rotation = (left @ right).T
        parts.append(rotation)
    return np.concatenate(parts, axis=1)[:, :bits]


def turn_at(cosine: float, spread: float) -> float:
    """Half turns between two vectors of the wanted cosine, seen from a centre at the root of ``spread`` from both; at most a
    quarter turn, beyond which unlike vectors are as close."""
    seen = 1 - (1 - cosine) / spread if spread > 0 else 0.0
    return math.acos(min(max(seen, 0.0), 1.0)) / math.pi


def tables_for(width: int, turn: float, recall: float = RECALL) -> int:
    """Tables in which a threshold pair meets at least once, with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-min((1 - turn) ** width, 1 - 1e-12))))


def collisions(bits: np.ndarray, width: int) -> float:
    """The share of pairs that agree in a substring, over the substrings of the bits."""
    shares = []
    for i in range(0, bits.shape[1] - width + 1, width):
        _, counts = np.unique(bits[:, i : i + width] @ (1 << np.arange(width, dtype=np.int64)), return_counts=True)
        shares.append((counts * (counts - 1.0)).sum() / max(len(bits) * (len(bits) - 1.0), 1.0))
    return float(np.mean(shares))


def unlike(sample: np.ndarray, cosine: float) -> np.ndarray:
    """The first rows of a sample without those that are linked to an earlier one."""
    some = sample[:MEASURED]
    return some[~np.triu(some @ some.T >= cosine, 1).any(axis=0)]


def learn(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> Coder:
    """From unit vectors, for a table of so many ``rows`` of their length."""
    apart = unlike(sample, cosine)  # groups of copies neither move the centre nor count as collisions
    centre = apart.mean(axis=0)
    v = sample - centre
    _, directions = np.linalg.eigh(v.T @ v)
    v = v @ directions
    turn = turn_at(cosine, float(np.median((v**2).sum(axis=1))))
    # The shortest substring with few neighbours per bucket, as long as the tables that it needs are not too many.
    trial = (apart - centre) @ directions @ rotations(v, TRIAL_BITS, seed) >= 0
    width = SHORTEST
    while width < LONGEST and tables_for(width + 1, turn, recall) <= MOST_TABLES and collisions(trial, width) * rows > NEIGHBOURS:
        width += 1
    tables = tables_for(width, turn, recall)
    rotation = rotations(v, CHECK_BITS + width * tables, seed)
    origin_width = min(LONGEST, max(8, math.ceil(math.log2(max(rows, 2)))))
    origin = rotations(sample, ORIGIN_TABLES * origin_width, seed)
    return Coder(centre, directions @ rotation, width, tables, turn, origin, origin_width)


def _coded(classes: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """(cid, check, subs): the check code as a number, and the substring of each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_powers = np.uint64(1) << np.arange(CHECK_BITS, dtype=np.uint64)
        for batch in batches:
            checks, subs = [], []
            for vector in batch.column(1).to_pylist():
                coder = coders[len(vector)]
                x = np.asarray(vector, np.float64)
                x /= np.abs(x).max()
                x /= np.linalg.norm(x)
                bits = coder.bits(x)
                checks.append(int((check_powers * bits[:CHECK_BITS]).sum(dtype=np.uint64).astype(np.int64)))
                subs.append(coder.substrings(x, bits))
            columns = [batch.column(0), pa.array(checks, pa.int64()), pa.array(subs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "check", "subs"])

    return classes.select("cid", "vector").mapInArrow(code, "cid bigint, check bigint, subs array<bigint>")


def cosine_of(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def link_vectors(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    good, bad = rows.filter(usable(F.col("vector"))), rows.filter(~usable(F.col("vector")))
    grouped = good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = saved(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")
    coders = {}
    for d, rows_of in [tuple(r) for r in classes.groupBy(F.size("vector")).count().collect()]:
        drawn = classes.filter(F.size("vector") == d).orderBy(F.xxhash64("cid", F.lit(seed))).limit(sample)
        x = np.array([r["vector"] for r in drawn.select("vector").collect()], np.float64).reshape(-1, d)
        x /= np.abs(x).max(axis=1, keepdims=True)
        coders[d] = learn(x / np.linalg.norm(x, axis=1, keepdims=True), rows_of, cosine, recall, seed)

    coded = saved(_coded(classes, coders).join(classes.select("cid", F.size("vector").alias("d")), "cid"), "codes")
    bucket = F.xxhash64("d", "i", "v")
    by_length = lambda value: F.coalesce(
        F.lit(None).cast("int"), *[F.when(F.col("d") == d, F.lit(value(c))) for d, c in coders.items()]
    )
    near, tables = by_length(lambda c: c.near()), by_length(lambda c: c.tables)
    posted = coded.select("cid", "check", near.alias("near"), "d", F.posexplode("subs").alias("i", "v")).select(
        "cid", "check", "near", bucket.alias("bucket"), (F.col("i") < tables).alias("pairs")
    )
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    vector = lambda side: classes.select(F.col("cid").alias(side), F.col("vector").alias(f"v_{side}"))

    def reranked(pairs: DataFrame, least: float) -> DataFrame:
        both = pairs.join(vector("a"), "a").join(vector("b"), "b")
        return both.filter(F.size("v_a") == F.size("v_b")).filter(cosine_of(F.col("v_a"), F.col("v_b")) >= least).select("a", "b")

    # Balls: a class joins the smallest leader of its buckets that is within half the angle.
    leaders = posted.groupBy("bucket").agg(F.min(F.struct("cid", "check")).alias("l"), F.count("*").alias("n")).filter("n > 1")
    led = posted.join(leaders, "bucket").filter("cid <> l.cid").filter(_distance(F.col("check"), F.col("l.check")) <= F.col("near"))
    close = reranked(led.select(F.col("cid").alias("a"), F.col("l.cid").alias("b")).distinct(), half)
    in_ball = saved(close.groupBy("a").agg(F.min("b").alias("ball")), "balls")

    # Buckets by ball, then pairs of balls that meet in a bucket, then pairs of their members there.
    labelled = saved(
        posted.filter("pairs").join(in_ball, posted["cid"] == in_ball["a"], "left").select(
            "bucket", "cid", "check", "near", F.coalesce("ball", "cid").alias("ball")
        ),
        "bucket-postings",
    )
    held = labelled.groupBy("bucket", "ball").agg(F.count("*").alias("n"))
    several = held.groupBy("bucket").agg(F.count("*").alias("balls")).filter("balls > 1")
    held = held.join(several, "bucket", "left_semi")
    first, second = held.select("bucket", F.col("ball").alias("p")), held.select("bucket", F.col("ball").alias("q"))
    meeting = first.join(second, "bucket").filter("p < q")
    one = labelled.select("bucket", F.col("ball").alias("p"), F.col("cid").alias("a"), F.col("check").alias("c_a"), "near")
    two = labelled.select("bucket", F.col("ball").alias("q"), F.col("cid").alias("b"), F.col("check").alias("c_b"))
    met = meeting.join(one, ["bucket", "p"]).join(two, ["bucket", "q"]).filter(_distance(F.col("c_a"), F.col("c_b")) <= F.col("near"))
    # A leader that belongs to another ball is not a member of its own; its members are checked against it here.
    own = in_ball.join(in_ball.select(F.col("a").alias("ball"), F.col("ball").alias("other")), "ball")
    candidates = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(
        own.select(F.least("a", "ball").alias("a"), F.greatest("a", "ball").alias("b"))
    )
    links = saved(reranked(candidates.distinct(), cosine), "vector-links")

    copies = classes.select("cid", "copies")
    member = classes.join(in_ball, classes["cid"] == in_ball["a"], "left").select(
        "cid", "copies", F.coalesce("ball", "cid").alias("ball")
    )
    inside = member.join(member.groupBy("ball").agg(F.sum("copies").alias("n_ball")), "ball").select(
        "cid", (F.col("n_ball") - 1).alias("n")
    )
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(copies, both["b"] == copies["cid"]).groupBy("a").agg(F.sum("copies").alias("n"))
    total = inside.unionByName(outside.select(F.col("a").alias("cid"), "n")).groupBy("cid").agg(F.sum("n").alias("n_links"))

    roots = components(links.unionByName(in_ball.select("a", F.col("ball").alias("b"))))
    rooted = classes.join(roots, classes["cid"] == roots["node"], "left").select(
        "cid", "vector", "first_id", F.coalesce("root", "cid").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(smallest, "root").join(total, "cid").select("vector", "n_links", "component_id")
    found = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
