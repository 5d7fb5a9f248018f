"""Exact quantiles against brute force, with sketches coarse enough that most values are folded."""

import math
import random

import numpy as np
import pytest

from loanweave.operators import box_stats, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def data(kind: str, n: int) -> list[float]:
    rng = random.Random(7)
    return {
        "continuous": lambda: [rng.gauss(0, 1000) for _ in range(n)],
        "hot value": lambda: [5.0 if i % 3 == 0 else rng.random() * 10 for i in range(n)],
        "few values": lambda: [float(rng.randint(0, 4)) for _ in range(n)],
        "constant": lambda: [2.5] * n,
        "long tail": lambda: [math.exp(rng.gauss(0, 4)) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5000])
@pytest.mark.parametrize("kind", ["continuous", "hot value", "few values", "constant", "long tail"])
def test_matches_brute_force(spark, kind, n):
    a, b = data(kind, n), data("continuous", n + 1)
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, "v", ["g"], PROBS, accuracy=100).collect()}
    for group, values in (("a", a), ("b", b)):
        assert got[group]["n"] == len(values)
        assert got[group]["q"] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)
        assert got[group]["min"] == min(values) and got[group]["max"] == max(values)
        assert got[group]["mean"] == pytest.approx(np.mean(values))


def test_many_groups(spark):
    df = spark.range(40_000).selectExpr("IF(id % 2 = 0, NULL, id) AS g", "CAST(id AS DOUBLE) AS v")
    got = exact_quantiles(df, "v", ["g"], [0.5], accuracy=100)
    assert got.count() == 20_001
    assert got.filter("g is null").first()["n"] == 20_000


def test_observed_value_quantile(spark):
    values = data("hot value", 2001)
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = exact_quantiles(df, "v", ["g"], PROBS, interpolate=False, accuracy=50).first()["q"]
    assert got == list(np.quantile(values, PROBS, method="inverted_cdf"))


def test_missing_values_and_null_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("a", 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, "v", ["g"], [0.5]).collect()}
    assert got == {None: (2, [2.0]), "a": (1, [4.0])}


def test_box_statistics_by_hand(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([(0, v) for v in values], "loan_status int, x double")
    row = box_stats(df, ["x"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert (row["n"], row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (6, 1.0, 5.0, 1)


@pytest.fixture
def small_broadcasts(spark):
    """Only what is known to be small is broadcast, as beside large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    yield
    spark.conf.set(name, before)


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_rows_of_a_large_group_are_not_sent_to_one_task(spark, small_broadcasts, capsys):
    df = spark.range(100_000).selectExpr("IF(id < 0, 'b', 'a') AS g", "CAST(id AS DOUBLE) AS v")
    got = exact_quantiles(df, "v", ["g"], [0.5])
    assert "BroadcastHashJoin" in plan_of(got, capsys)
    assert got.first()["q"] == [49_999.5]


def test_boxes_are_sent_to_the_rows(spark, small_broadcasts, capsys):
    df = spark.range(100_000).selectExpr("CAST(id % 2 AS INT) AS loan_status", "CAST(hash(id) AS DOUBLE) AS x")
    got = box_stats(df, ["x"])
    plan = plan_of(got, capsys)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sum(r["n"] for r in got.collect()) == 100_000
