"""Trees as tables: grown like the library's, walked like its predictions."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanweave.operators.trees import forest_probabilities, grow, thresholds, walk
from loanweave.plans.model_queries import held_out_part
from loanweave.plans.tree_table import ROOT, levels, saved_nodes
from loanweave.schema import KEY

from .conftest import SF

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(2000):
        a, b, c = rng.randrange(12), rng.randrange(7), rng.random()
        y = int((a > 6) != (b > 2) if rng.random() < 0.9 else rng.random() < 0.3) + (1 if c > 0.8 else 0)
        data.append((i, float(a), b, c, y))
    return spark.createDataFrame(data, "id int, a double, b int, c double, y int").cache()


def shape(nodes, node, root_depth=0):
    """The tree as nested (feature, threshold, left, right) or class counts."""
    at = {r["node"]: r for r in nodes}

    def below(i):
        r = at[i]
        return (r["feature"], r["threshold"], below(r["left"]), below(r["right"])) if r["left"] is not None else list(r["counts"])

    return below(node)


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_grown_like_the_library(rows, impurity):
    few = ["a", "b"]
    own = grow(rows, few, "y", classes=3, depth=3, impurity=impurity).collect()
    vectors = VectorAssembler(inputCols=few, outputCol="x").transform(rows)
    theirs = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=3, impurity=impurity).fit(vectors)
    assert shape(own, 1) == shape(saved_nodes(theirs).collect(), ROOT)


def test_continuous_features_are_cut_at_quantiles(rows):
    cuts = thresholds(rows, FEATURES, bins=8)
    assert cuts["b"] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert len(cuts["c"]) == 7 and cuts["c"] == sorted(cuts["c"]) and len(cuts["a"]) == 7
    nodes = grow(rows, FEATURES, "y", classes=3, depth=4, bins=8).collect()
    leaves = [r for r in nodes if r["left"] is None]
    assert sum(sum(r["counts"]) for r in leaves) == 2000


def test_walk_reaches_the_leaf_that_holds_the_row(rows):
    nodes = grow(rows, FEATURES, "y", classes=3, depth=4).cache()
    values = F.array(*[F.col(c).cast("double") for c in FEATURES])
    ends = walk(rows.select("id", "y", values.alias("x")), nodes, "x", depth=4)
    assert ends.count() == 2000
    for r in ends.groupBy("counts").agg(*[F.count(F.when(F.col("y") == k, 1)).alias(f"c{k}") for k in range(3)]).collect():
        assert list(r["counts"]) == [r["c0"], r["c1"], r["c2"]]


def test_walk_gives_the_forests_probabilities(spark, model):
    predicted = model.transform(held_out_part(spark, SF))
    table = predicted.select(KEY, vector_to_array("features_scaler").alias("x"), vector_to_array("probability").alias("q")).cache()
    nodes = saved_nodes(model.stages[-1]).cache()
    found = forest_probabilities(table, nodes, KEY, "x", classes=2, depth=5, root=ROOT).join(table, KEY).collect()
    assert len(found) == table.count()
    assert all(abs(a - b) <= 1e-12 for r in found for a, b in zip(r["p"], r["q"]))
    by_level = levels(nodes).groupBy("tree").agg(F.count("*").alias("n"), F.max("level").alias("depth")).collect()
    assert len(by_level) == 20 and sum(r["n"] for r in by_level) == nodes.count() and max(r["depth"] for r in by_level) <= 5


def test_odd_tables(spark):
    schema = "a double, b int, y int"
    assert grow(spark.createDataFrame([], schema), ["a", "b"], "y").count() == 0
    same = grow(spark.createDataFrame([(1.0, 1, 0)] * 5 + [(1.0, 1, 1)] * 2, schema), ["a", "b"], "y").collect()
    assert [(r["node"], list(r["counts"]), r["left"]) for r in same] == [(1, [5.0, 2.0], None)]
    holes = [(None, 1, 0), (1.0, None, 1), (2.0, 2, None), (1.0, 1, 0), (2.0, 1, 1)]
    nodes = grow(spark.createDataFrame(holes, schema), ["a", "b"], "y", depth=1).collect()
    assert sorted((r["node"], list(r["counts"]), r["threshold"]) for r in nodes) == [
        (1, [1.0, 1.0], 1.5), (2, [1.0, 0.0], None), (3, [0.0, 1.0], None),
    ]


def test_siblings_of_one_class_are_merged(spark):
    rows = spark.createDataFrame([(0.0, 0, 0)] * 9 + [(1.0, 0, 0)] * 5 + [(1.0, 0, 1)] * 4, "a double, b int, y int")
    assert grow(rows, ["a", "b"], "y", depth=2).count() == 1
    assert grow(rows, ["a", "b"], "y", depth=2, prune=False).count() == 3
