"""Classification trees as tables: grown from aggregated tallies, and walked by joins.

Growing reads the rows once to bin them to small whole numbers, which are written narrow, and then once per level. A level
counts (node, feature, bin, class), combined on the map side to at most nodes x features x bins entries; running counts over
the bins of a node and feature give every split its gain. No row moves between levels: a row's node follows from the splits
so far, a table of at most 2**depth entries.

A tree is a table of nodes: ``tree``, ``node``, ``feature`` (position), ``threshold``, ``left`` and ``right`` (node ids, null in
a leaf) and ``counts`` per class. Values up to the threshold go left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .profile import melt
from .quantiles import exact_quantiles

MAX_BINS = 32
NODE_SCHEMA = (
    "tree int, node int, depth int, feature int, threshold double, left int, right int, counts array<double>, "
    "gain double, prediction int"
)


@dataclass(frozen=True)
class Node:
    node: int
    depth: int
    counts: tuple[float, ...]
    feature: int | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float | None = None

    @property
    def prediction(self) -> int:
        return self.counts.index(max(self.counts))


def thresholds(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> dict[str, list[float]]:
    """At most ``bins`` - 1 candidate thresholds per feature.

    Midpoints of neighbouring values where a feature has at most ``bins`` of them, otherwise quantiles. A sketch tells
    apart the features that are worth counting exactly, so that no list of many distinct values is built.
    """
    few_most = 2 * bins
    about = df.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(c) for c in features]).first()
    maybe = [c for c in features if about[c] <= few_most]
    values: dict[str, list[float]] = {c: [] for c in features}
    if maybe:
        for row in melt(df, maybe).filter("value is not null").distinct().collect():
            values[row["feature"]].append(row["value"])
    many = [c for c in features if c not in maybe or len(values[c]) > bins]
    found = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c in features if c not in many for v in [sorted(values[c])]}
    if many:
        narrow = written(df.select(*many), "tree-values")
        probs = [i / bins for i in range(1, bins)]
        for row in exact_quantiles(melt(narrow, many), "value", ["feature"], probs, interpolate=False).collect():
            found[row["feature"]] = sorted({v for v in row["q"] if v < row["max"]})
    return {c: found.get(c, []) for c in features}


def binned(df: DataFrame, features: Sequence[str], cuts: dict[str, list[float]], keep: Sequence[str]) -> DataFrame:
    """(kept columns, ``bins``): per feature the number of its thresholds that lie below the value."""
    cut = [i for i, c in enumerate(features) if cuts[c]]
    splits = [[-math.inf, *[math.nextafter(t, math.inf) for t in cuts[features[i]]], math.inf] for i in cut]
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(features)])
    if cut:
        inputs, outputs = [f"_in{i}" for i in cut], [f"_bin{i}" for i in cut]
        rows = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs).transform(rows)
    numbers = [(F.col(f"_bin{i}") if i in cut else F.lit(0)).cast("smallint") for i in range(len(features))]
    return rows.select(*keep, F.array(*numbers).alias("bins"))


def impurity_of(counts: Sequence[Column], kind: str) -> Column:
    """Gini or entropy of class counts."""
    total = sum(counts[1:], counts[0])
    shares = [c / total for c in counts]
    if kind == "gini":
        return F.lit(1.0) - sum((s * s for s in shares[1:]), shares[0] * shares[0])
    logs = [F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares]
    return sum(logs[1:], logs[0])


def best_splits(state: DataFrame, classes: int, impurity: str) -> DataFrame:
    """(node, feature, bin, gain, left, right): the best split of each node; of equal ones the first feature and bin.

    ``state`` has ``node``, ``label`` and ``bins``. A node that no split improves is missing.
    """
    one_class = [F.count(F.when(F.col("label") == k, 1)).alias(f"c{k}") for k in range(classes)]
    tally = state.select("node", "label", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(*one_class)
    group = Window.partitionBy("node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [f"c{k}" for k in range(classes)]
    left = [F.col(f"l{k}") for k in range(classes)]
    right = [F.col(f"r{k}") for k in range(classes)]
    n_left, n_right = sum(left[1:], left[0]), sum(right[1:], right[0])
    n = n_left + n_right
    both = [a + b for a, b in zip(left, right)]
    sums = tally.select(
        "node", "feature", "bin",
        *[F.sum(c).over(upto).alias(f"l{k}") for k, c in enumerate(columns)],
        *[(F.sum(c).over(group) - F.sum(c).over(upto)).alias(f"r{k}") for k, c in enumerate(columns)],
    ).filter(n_right > 0)
    gain = (
        impurity_of(both, impurity) - n_left / n * impurity_of(left, impurity) - n_right / n * impurity_of(right, impurity)
    )
    split = F.struct(
        gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin").cast("int")).alias("b"),
        F.array(*left).alias("left"), F.array(*right).alias("right"),
    )
    best = sums.groupBy("node").agg(F.max(split).alias("s")).filter("s.gain > 0")
    return best.select("node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain", "s.left", "s.right")


def pruned(nodes: dict[int, Node]) -> dict[int, Node]:
    """Siblings that are leaves of the same class become one leaf."""
    for node in sorted(nodes, reverse=True):
        own = nodes[node]
        if own.left is not None:
            pair = nodes[own.left], nodes[own.right]
            if all(c.left is None for c in pair) and pair[0].prediction == pair[1].prediction:
                del nodes[own.left], nodes[own.right]
                nodes[node] = Node(own.node, own.depth, own.counts)
    return nodes


def grow(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int = 2,
    depth: int = 5,
    impurity: str = "gini",
    bins: int = MAX_BINS,
    prune: bool = True,
) -> DataFrame:
    """The node table of a classification tree of ``label`` (0 .. ``classes`` - 1) on complete numeric features.

    Rows with a missing feature or label are left out. An empty table gives no nodes. The nodes, at most 2**(depth + 1),
    pass through the driver; rows never do.
    """
    spark, features = df.sparkSession, list(features)
    complete = df.dropna(subset=[*features, label])
    cuts = thresholds(complete, features, bins)
    labelled = complete.withColumn("_label", F.col(label).cast("int"))
    rows = written(binned(labelled, features, cuts, ["_label"]).withColumnRenamed("_label", "label"), "tree-bins")
    start = rows.groupBy().agg(*[F.count(F.when(F.col("label") == k, 1)).alias(f"c{k}") for k in range(classes)]).first()
    counts = tuple(float(v) for v in start)
    if not sum(counts):
        return spark.createDataFrame([], NODE_SCHEMA)
    nodes = {1: Node(1, 0, counts)}
    state, level = rows.withColumn("node", F.lit(1)), [1]
    for d in range(depth):
        found = best_splits(state.filter(F.col("node").isin(level)), classes, impurity).collect()
        for s in found:
            children = 2 * s["node"], 2 * s["node"] + 1
            cut = cuts[features[s["feature"]]][s["bin"]]
            nodes[s["node"]] = replace(
                nodes[s["node"]], feature=s["feature"], threshold=cut, left=children[0], right=children[1], gain=s["gain"]
            )
            for child, c in zip(children, (s["left"], s["right"])):
                nodes[child] = Node(child, d + 1, tuple(float(v) for v in c))
        if not found:
            break
        level = [c for s in found for c in (2 * s["node"], 2 * s["node"] + 1)]
        splits = spark.createDataFrame([(s["node"], s["feature"], s["bin"]) for s in found], "node int, _f int, _b int")
        goes_right = (F.get("bins", F.col("_f")) > F.col("_b")).cast("int")
        below = F.when(F.col("_f").isNotNull(), 2 * F.col("node") + goes_right).otherwise(F.col("node"))
        state = state.join(splits, "node", "left").select("label", "bins", below.alias("node"))
    kept = pruned(nodes) if prune else nodes
    listed = [
        (0, n.node, n.depth, n.feature, n.threshold, n.left, n.right, list(n.counts), n.gain, n.prediction) for n in kept.values()
    ]
    return spark.createDataFrame(listed, NODE_SCHEMA)


def walk(rows: DataFrame, nodes: DataFrame, values: str, depth: int, root: int = 1) -> DataFrame:
    """Rows with ``tree`` and ``counts`` of the leaf each reaches, a row per input row and tree.

    ``values`` is the column with the array of features. One join with the node table per level; as a row's way through
    all trees stays in its task while the node table is small, and the table is dealt by node when it is not, no level
    gathers rows.
    """
    step = nodes.select(
        F.col("tree").alias("_tree"), F.col("node").alias("_id"), F.col("feature").alias("_feature"),
        F.col("threshold").alias("_cut"), F.col("left").alias("_left"), F.col("right").alias("_right"),
    )
    trees = [F.lit(r["tree"]) for r in nodes.select("tree").distinct().collect()]  # as many as the forest has
    state = rows.withColumn("tree", F.explode(F.array(*trees).cast("array<int>"))).withColumn("_at", F.lit(root))
    for _ in range(depth):
        value = F.get(F.col(values), F.col("_feature"))
        below = F.when(F.col("_left").isNull(), F.col("_at")).when(value <= F.col("_cut"), F.col("_left")).otherwise(F.col("_right"))
        met = state.join(step, (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_id")))
        state = met.select(*rows.columns, "tree", below.alias("_at"))
    leaves = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_id"), "counts")
    ends = state.join(leaves, (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_id")))
    return ends.select(*rows.columns, "tree", "counts")


def forest_probabilities(rows: DataFrame, nodes: DataFrame, key: str, values: str, classes: int, depth: int, root: int = 1) -> DataFrame:
    """(key, p): the mean over the trees of each leaf's class shares."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    reached = walk(rows.select(key, values), nodes, values, depth, root)
    votes = [F.sum(F.get("counts", F.lit(k)) / total).alias(f"v{k}") for k in range(classes)]
    everything = sum((F.col(f"v{k}") for k in range(1, classes)), F.col("v0"))
    return reached.groupBy(key).agg(*votes).select(key, F.array(*[F.col(f"v{k}") / everything for k in range(classes)]).alias("p"))
