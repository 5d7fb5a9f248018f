"""Exact top-k inner products by ball-tree branch and bound, shard by shard.

Components become ``floor(256 x)``, so scores are integers and ties are exact. Candidates are dealt over cells of space, each
to the nearest of a bounded number of sampled pivots; a cell with many rows is split into several shards by hash. Each shard
becomes one ball tree, built once and written. A query visits the nodes of a tree in the order of their upper bound,
``q . centre + |q| radius``, and stops at the first that cannot reach its current k-th score.

The same bound orders the cells, by pivot and radius. Every query first searches its best cell; the k-th score found there is
shared with the next few, and the improved one with the rest, each only if its bound reaches the score. In every round the
queries stream through the trees: a task holds one tree and one batch of queries.

Edge cases: a vector that is null or has a null or non-finite component takes no part, as query or candidate, and
neither does a row with a null ``vec_id``; vectors of another length than the query are not its candidates; repeated
rows are candidates each, but never of a query with their own id; a query with fewer candidates returns all; an empty
table gives an empty result; further columns are ignored. Scores beyond 64 bits are held at the limit.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K = 5
SCALE = 256
LEAF = 64
SHARD_ROWS = 8192
PIVOTS = 2048  # cells, at most
ROUNDS = (1, 5)  # cells that have been searched after the first and second round
BATCH = 1024  # queries at once
SLACK = 1e-9  # rounding of a bound must not cut off a point that reaches it
SEED = 3

_LIMITS = np.iinfo(np.int64)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a query's inner product with a point of a ball can be, a row per query."""
    norms = np.sqrt((queries**2).sum(axis=1))
    size = norms[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii)
    return queries @ centres.T + norms[:, None] * radii + SLACK * (1 + size)


class BallTree:
    """Nodes as arrays: centre, radius, children (or -1), and the range of points below."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.centres, self.radii, self.children, self.ranges = [], [], [], []
        pending = [(0, len(points), None, 0)]
        while pending:
            low, high, parent, side = pending.pop()
            here = points[self.order[low:high]]
            centre = here.mean(axis=0)
            apart = np.sqrt(((here - centre) ** 2).sum(axis=1))
            node = len(self.centres)
            self.centres.append(centre)
            self.radii.append(apart.max() if len(apart) else 0.0)
            self.children.append([-1, -1])
            self.ranges.append((low, high))
            if parent is not None:
                self.children[parent][side] = node
            if high - low > leaf and self.radii[-1] > 0:
                # Split at the median along the line of two far points.
                one = here[apart.argmax()]
                other = here[((here - one) ** 2).sum(axis=1).argmax()]
                along = here @ (one - other)
                middle = (high - low) // 2
                self.order[low:high] = self.order[low:high][np.argpartition(along, middle, kind="introselect")]
                pending += [(low, low + middle, node, 0), (low + middle, high, node, 1)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return upper_bounds(queries, self.centres, self.radii)

    def search(self, query, bounds, ids, own, k, floor, score):
        """The k best (score, -id) of the points, none below ``floor``."""
        best: list[tuple] = []
        nodes = [(-bounds[0], 0)]
        least = floor
        while nodes:
            bound, node = heapq.heappop(nodes)
            if least is not None and -bound < least:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(nodes, (-bounds[left], left))
                heapq.heappush(nodes, (-bounds[right], right))
                continue
            low, high = self.ranges[node]
            at = self.order[low:high]
            scores = score(at, query)
            if least is not None:
                reach = np.flatnonzero(scores >= least)
                at, scores = at[reach], scores[reach]
            for value, vec in zip(scores.tolist(), ids[at].tolist()):
                if vec != own:
                    entry = (int(value), -vec)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k and (least is None or best[0][0] > least):
                least = best[0][0]
        return best


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


FOUND = "uid bigint, query_id bigint, vec_id bigint, score bigint"
KEY = ["d", "cell", "salt"]


class Shard:
    """The tree of some candidates, all of one length."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points, self.tree = ids, points, BallTree(points)
        self.far = np.abs(points).max(initial=0)

    def best(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        exact = len(query) * self.far * np.abs(query).max(initial=0) < 2**53
        asked = query if exact else np.array([int(x) for x in query], object)

        def score(at, _):
            if exact:
                return self.points[at] @ query
            whole = np.array([[int(x) for x in p] for p in self.points[at]], object).reshape(len(at), len(query))
            return np.array([min(max(v, _LIMITS.min), _LIMITS.max) for v in whole @ asked], np.int64)

        return self.tree.search(query, bounds, self.ids, own, k, floor, score)


@dataclass(frozen=True)
class Cells:
    """Pivots of one length, with the radius of the cell around each (negative for an empty one)."""

    pivots: np.ndarray
    radii: np.ndarray

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each point, and its distance from the pivot."""
        cell = ((self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T).argmin(axis=1)
        return cell, np.sqrt(((points - self.pivots[cell]) ** 2).sum(axis=1))

    def ordered(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells by falling bound, and their bounds; empty ones have none."""
        bounds = np.where(self.radii >= 0, upper_bounds(queries, self.pivots, np.maximum(self.radii, 0)), -np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        return order, np.take_along_axis(bounds, order, axis=1)


def _matrix(vectors: pa.ListArray, low: int, high: int, d: int) -> np.ndarray:
    starts = np.asarray(vectors.offsets)
    return np.asarray(vectors.values, np.float64)[starts[low] : starts[high]].reshape(high - low, d)


def _dealt(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Rows with their ``cell`` and ``apart``, the distance from its pivot. Lengths without a pivot have one cell at 0."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, apart = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for d, part in pdf.reset_index(drop=True).groupby("d"):
                points = np.stack([np.asarray(v, np.float64) for v in part["vector"]]).reshape(len(part), d)
                at = part.index.to_numpy()
                cell[at], apart[at] = (cells[d] if d in cells else Cells(np.zeros((1, d)), np.zeros(1))).nearest(points)
            yield pdf.assign(cell=cell, apart=apart)

    held = ["vec_id", "vector", "asks", "d", "uid"]
    schema = "vec_id bigint, vector array<double>, asks boolean, d int, uid bigint, cell int, apart double"
    return rows.select(*held).mapInPandas(deal, schema)


def _trees(dealt: DataFrame) -> DataFrame:
    """A row per shard with its tree."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]).reshape(len(pdf), int(pdf["d"].iloc[0]))
        shard = Shard(pdf["vec_id"].to_numpy(np.int64), points)
        return pdf[KEY][:1].assign(tree=[pickle.dumps(shard, protocol=5)])

    return dealt.select(*KEY, "vec_id", "vector").groupBy(*KEY).applyInPandas(build, "d int, cell int, salt int, tree binary")


def _routed(queries: DataFrame, cells: dict[int, Cells], first: int, last: int | None) -> DataFrame:
    """(d, cell, uid, query_id, vector, floor) of the cells from the ``first`` to before the ``last`` in a query's order whose
    bound reaches its floor."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, floors = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            at, to = [], []
            for i, d in enumerate(lengths):
                known = cells.get(d)
                if known is None:
                    at, to = at + [i] * (first == 0), to + [0] * (first == 0)
                    continue
                order, bounds = known.ordered(_matrix(batch.column(3), i, i + 1, d))
                reach = bounds[0, first:last] >= (-np.inf if floors[i] is None else floors[i])
                reach &= bounds[0, first:last] > -np.inf
                here = order[0, first:last][reach].tolist()
                at, to = at + [i] * len(here), to + here
            out = batch.take(pa.array(at, pa.int64()))
            columns = [out.column(2), pa.array(to, pa.int32()), out.column(0), out.column(1), out.column(3), out.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["d", "cell", "uid", "query_id", "vector", "floor"])

    asked = queries.select("uid", "query_id", "d", "vector", "floor")
    return asked.mapInArrow(route, "d int, cell int, uid bigint, query_id bigint, vector array<double>, floor bigint")


def _searched(routed: DataFrame, trees: DataFrame, salts: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best of each shard for the queries sent there.

    A partition is sorted so that a shard's tree comes before the queries that stream through it.
    """
    nothing = {"uid": "bigint", "query_id": "bigint", "vector": "array<double>", "floor": "bigint"}
    held = trees.select(*KEY, F.lit(False).alias("asks"), "tree", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    asked = routed.join(salts, ["d", "cell"]).withColumn("salt", each)
    asked = asked.select(*KEY, F.lit(True).alias("asks"), F.lit(None).cast("binary").alias("tree"), *nothing)
    dealt = held.unionByName(asked).repartition(parts, *KEY).sortWithinPartitions(*KEY, "asks")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for low, high in zip([0, *cuts], [*cuts, len(keys)]):
                if not keys[low][3]:
                    key, shard = keys[low][:3], pickle.loads(batch.column(4)[low].as_py())
                    continue
                if key != keys[low][:3]:
                    continue  # a shard without candidates
                found: list[tuple[int, int, int, int]] = []
                for start in range(low, high, BATCH):
                    stop = min(start + BATCH, high)
                    queries = _matrix(batch.column(7), start, stop, key[0])
                    bounds = shard.tree.bounds(queries)
                    uids, owns, floors = (batch.column(i).slice(start, stop - start).to_pylist() for i in (5, 6, 8))
                    for uid, own, floor, query, bound in zip(uids, owns, floors, queries, bounds):
                        found += [(uid, own, -minus, value) for value, minus in shard.best(query, bound, own, k, floor)]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(stream, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``is_query`` marks, ties to the smaller id."""
    usable = vectors.filter(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    rows = usable.select(
        F.col("vec_id").cast("bigint"), quantised(F.col("embedding")).alias("vector"), is_query.alias("asks"),
        F.size("embedding").alias("d"),
    )
    # The numbers are fixed by writing them.
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "points")
    wanted = max(1, min(pivots, -(-rows.count() // shard_rows)))
    drawn = rows.orderBy(F.xxhash64("uid", F.lit(SEED))).limit(wanted).select("d", "vector").collect()
    picked: dict[int, list] = {}
    for r in drawn:
        picked.setdefault(r["d"], []).append(r["vector"])
    start = {d: Cells(np.array(v, np.float64).reshape(len(v), d), np.zeros(len(v))) for d, v in picked.items()}

    dealt = saved(_dealt(rows, start), "points-in-cells")
    # A row per cell, of which there are no more than pivots and lengths without one.
    sizes = saved(dealt.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")), "cells")
    salts = sizes.select("d", "cell", F.ceil(F.col("n") / shard_rows).cast("int").alias("salts"))
    radii = {d: np.full(len(c.pivots), -1.0) for d, c in start.items()}
    for r in sizes.filter(F.col("d").isin(list(radii))).collect():
        radii[r["d"]][r["cell"]] = r["radius"] * (1 + SLACK) + SLACK
    cells = {d: Cells(c.pivots, radii[d]) for d, c in start.items()}

    salted = dealt.join(salts, ["d", "cell"]).withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))
    trees = saved(_trees(salted), "trees")
    parts = max(trees.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    queries = dealt.filter("asks").select("uid", F.col("vec_id").alias("query_id"), "vector", "d")

    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    found = None
    for first, last in zip((0, *ROUNDS), (*ROUNDS, None)):
        if found is None:
            asked = queries.withColumn("floor", F.lit(None).cast("bigint"))
        else:
            full = found.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
            asked = queries.join(full.select("uid", "floor"), "uid", "left")
        more = _searched(_routed(asked, cells, first, last), trees, salts, k, parts)
        together = more if found is None else found.unionByName(more)
        ranked = together.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = saved(ranked.select("uid", "query_id", "vec_id", "score"), "best-so-far")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")
