"""Hard negatives by a secondary-sort shuffle.

Components become ``floor(256 x)``, so that scores, the inner products with an anchor, are integers and ties are exact. An
anchor's positives are its best other rows of the same label; a positive's hard negatives are the best rows of another
label that score at most as much as it and at least ``least`` per cent of that.

Scored pairs get a packed key of (anchor, descending score, id), are dealt by anchor and sorted by key within the partition
(``repartitionAndSortWithinPartitions``). One pass over the sorted stream opens a window at each positive, hands the
negatives that follow to the open windows and closes a window when it is full or its lower end is passed. It holds the open
windows and the first ids of the present score, never an anchor's pairs.

All rows are scored for each anchor, but few pairs are shuffled. Rows are dealt over shards; the anchors stream through each
shard, first for the shard's best positives, then, when the best of all are known, for its best negatives of each window.
The best of all rows are among the best of each shard, so nothing is lost, and what a shard sends for an anchor is bounded
by the number of windows. A task holds one shard and one batch of anchors. Work grows with anchors times rows, as asked.

Edge cases: a row takes no part, as anchor or candidate, if its label, id or vector is null or a component is null or
non-finite; vectors of other lengths than the anchor's are not its candidates; a row with the anchor's own id is never its
candidate; repeated rows are anchors and candidates each; ties go to the smaller id; an anchor without a positive, and a
positive without a negative, give no rows; a positive with a negative score has an empty window; scores beyond 64 bits are
held at the limit; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import quantised, takes_part
from .common import saved

POSITIVES, NEGATIVES = 5, 5
LEAST = 80  # per cent of the positive's score
SHARD_BYTES = 1 << 25  # of vectors, held by a task
SHARDS, SHARD_ROWS = 100, 1024  # so many shards on small tables, if each has so many rows
AT_ONCE = 1 << 21  # scores held at once

_LIMITS = np.iinfo(np.int64)
_SHIFT = 1 << 63  # brings signed numbers into unsigned order
FOUND = "anchor long, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Shard:
    """Candidates of one length, by id, so that the first of equal scores has the smallest id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        self.far = np.abs(points).max(initial=0)

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """(anchor, candidate) scores as 64-bit integers."""
        if self.points.shape[1] * self.far * np.abs(asked).max(initial=0) < 2**53:
            return (asked @ self.points.T).astype(np.int64)
        as_whole = lambda rows: np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)
        return np.clip(as_whole(asked) @ as_whole(self.points).T, _LIMITS.min, _LIMITS.max).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def lower_end(score: int, least: int = LEAST) -> int:
    """The smallest whole number that is at least ``least`` per cent of the score."""
    return -(-score * least // 100)


def positives_in(shard: Shard, own_id: int, label: int, scores: np.ndarray, asked: dict, k: int) -> np.ndarray:
    same = np.flatnonzero((shard.labels == label) & (shard.ids != own_id))
    return same[best(scores[same], k)]


def negatives_in(shard: Shard, own_id: int, label: int, scores: np.ndarray, asked: dict, k: int) -> np.ndarray:
    """The k best of each window; a candidate in several windows comes once."""
    tops = [int(v) for v in asked["tops"]]
    ends = [lower_end(v, asked["least"]) for v in tops]
    reach = (scores <= max(tops)) & (scores >= min(ends)) & (shard.labels != label) & (shard.ids != own_id)
    other = np.flatnonzero(reach)
    found: set[int] = set()
    for top, end in zip(tops, ends):
        inside = other[(scores[other] <= top) & (scores[other] >= end)]
        found.update(inside[best(scores[inside], k)].tolist())
    return np.array(sorted(found), int)


def through_shards(rows: DataFrame, anchors: DataFrame, shards: int, pick: Callable, k: int, least: int) -> DataFrame:
    """(anchor, id, score) of what ``pick`` chooses for each anchor in each shard.

    A partition is sorted so that a shard's candidates come before the anchors that stream through it.
    """
    none = F.lit(None).cast("array<long>")
    candidates = rows.select(
        "d", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "uid", "vec_id",
        "label", "vector", none.alias("tops"),
    )
    asked = anchors.select(
        "d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "uid", "vec_id",
        "label", "vector", "tops",
    )
    dealt = candidates.unionByName(asked).repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", "asks")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            d, number, asks, uids, ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            starts = np.asarray(batch.column(6).offsets)
            flat = np.asarray(batch.column(6).values, np.float64)
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(number) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
                vectors = flat[starts[low] : starts[high]].reshape(high - low, d[low])
                if key != (d[low], number[low]):
                    key, held, shard = (d[low], number[low]), [], None
                if not asks[low]:
                    held.append((ids[low:high], labels[low:high], vectors))
                    continue
                if not held and shard is None:
                    continue  # a shard without candidates
                if held:
                    shard, held = Shard(*(np.concatenate(part) for part in zip(*held))), []
                tops = batch.column(7).slice(low, high - low).to_pylist()
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for some in np.array_split(np.arange(high - low), -(-(high - low) * len(shard.ids) // AT_ONCE)):
                    scores = shard.scores(vectors[some])
                    for i, own in zip(some.tolist(), scores):
                        asked_for = {"tops": tops[i], "least": least}
                        at = pick(shard, int(ids[low + i]), int(labels[low + i]), own, asked_for, k)
                        found.append((int(uids[low + i]), shard.ids[at], own[at]))
                anchor = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                columns = [anchor, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "id", "score"])

    return dealt.mapInArrow(stream, FOUND)


def packed_key(anchor: int, score: int, id_: int) -> bytes:
    """Sorts as (anchor, descending score, id)."""
    return struct.pack(">QQQ", anchor + _SHIFT, _SHIFT - 1 - score, id_ + _SHIFT)


def unpacked_key(key: bytes) -> tuple[int, int, int]:
    anchor, score, id_ = struct.unpack(">QQQ", key)
    return anchor - _SHIFT, _SHIFT - 1 - score, id_ - _SHIFT


def by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def windows(pairs: Iterator[tuple[bytes, int | None]], k: int = NEGATIVES, least: int = LEAST) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted pairs.

    A pair's value is the anchor's id for a positive and None for a negative.
    """
    anchor = level = None
    open_: list[list] = []  # anchor's id, positive's id and score, lower end, negatives so far
    first: list[int] = []  # negatives of the present score
    for key, value in pairs:
        row, score, id_ = unpacked_key(key)
        if row != anchor:
            anchor, level, open_ = row, None, []
        if score != level:
            level, first = score, []
            open_ = [w for w in open_ if w[4] < k and score >= w[3]]
        if value is not None:
            window = [value, id_, score, lower_end(score, least), 0]
            open_.append(window)
            takes = [(window, n) for n in first if score >= window[3]]
        else:
            if len(first) < k:
                first.append(id_)
            takes = [(w, id_) for w in open_ if w[4] < k and score >= w[3]]
        for window, negative in takes:
            window[4] += 1
            yield window[0], window[1], window[4], negative, window[2], score


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` marks.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``.
    """
    spark = vectors.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("embedding"))
    rows = vectors.filter(whole).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), quantised(F.col("embedding")).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.size("embedding").alias("d"),
    )
    # The numbers are fixed by writing them.
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "points")
    total, entries = rows.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    shards = max(1, -(-8 * entries // SHARD_BYTES), min(SHARDS, -(-total // SHARD_ROWS)))
    anchors = rows.filter("asks")

    near = through_shards(rows, anchors.withColumn("tops", F.lit(None).cast("array<long>")), shards, positives_in, positives, least)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    chosen = saved(ranked.select("anchor", "id", "score"), "positives")

    tops = chosen.groupBy("anchor").agg(F.collect_set("score").alias("tops"))  # a few scores each
    asked = anchors.join(tops, anchors["uid"] == tops["anchor"])
    away = through_shards(rows, asked, shards, negatives_in, negatives, least)
    named = chosen.join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("value")), "anchor")
    pairs = saved(named.select("anchor", "id", "score", "value").unionByName(away.withColumn("value", F.lit(None).cast("long"))), "pairs")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda r: (packed_key(r[0], r[2], r[1]), r[3]))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, by_anchor)
    mined = ordered.mapPartitions(lambda stream: windows(stream, negatives, least))
    return spark.createDataFrame(mined, RESULT, verifySchema=False)
