"""Whitening against plain arithmetic on whole tables, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as contract
from loanweave.llm import whitening

from ..conftest import SF

ROW = "vec_id bigint, embedding array<double>"


def by_hand(vectors):
    """(n, S, covariance, x) by exact fractions, each product of centred values."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    centred = [[Fraction(row[i]) - Fraction(s[i], n) for i in range(d)] for row in x]
    cov = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)]
    return n, s, np.array(cov), x


def check(rows, vectors, components=8):
    n, s, cov, x = by_hand(list(vectors.values()))
    d = len(s)
    by_id = dict(zip(vectors, x))
    values = np.linalg.eigvalsh(cov)[::-1]
    w = {}
    for r in rows:
        own = by_id[r["vec_id"]]
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(own, s))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        w.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    assert set(w) == set(vectors) and all(sorted(v) == list(range(1, min(components, d) + 1)) for v in w.values())
    # Whitened values reproduce the axes up to sign, from centred rows.
    got = np.array([[w[i][k] for k in sorted(w[i])] for i in vectors], float)
    centred = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(by_id[i], s)] for i in vectors])
    axes = centred.T @ got / n / np.sqrt(values[: got.shape[1]])
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-9)
    assert np.allclose(cov @ axes, axes * values[: got.shape[1]], atol=1e-7 * values[0])
    assert np.abs(got.T @ got / n - np.eye(got.shape[1])).max() < 1e-9


def test_query_equals_plain_arithmetic(spark):
    rows = contract.queries()["op11_whitening"](spark, SF).collect()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(rows, {r[0]: r[1] for r in given})
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] <= 1e-4


def test_polarisation_is_exact_for_large_values():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**61), 2**61, (50, 5))
    c = whitening.centre(whitening.counted(x))
    sums = whitening.squared(c.shifted(x))
    n, total = len(x), [sum(map(int, col)) for col in x.T]
    for i in range(5):
        assert n * int(sums[i]) - int(c.rest[i]) ** 2 == n * sum(int(v) ** 2 for v in x[:, i]) - total[i] ** 2
    cov = whitening.covariance(c, sums)
    want = [[float(Fraction(sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])), n) - Fraction(total[i] * total[j], n * n)) for j in range(5)] for i in range(5)]
    assert np.array_equal(cov, np.array(want))


def test_packing_of_sums_keeps_sign():
    values = np.array([0, -1, 2**150, -(2**150), 7], object)
    assert whitening.unpacked(whitening.packed(values)).tolist() == values.tolist()


def test_partitions_are_added_in_a_tree(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=4).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), ROW).repartition(70)
    check(whitening.whiten(df).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = {i: rng.normal(size=3).tolist() for i in range(20)}
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, [])]
    alone = [(105, [1.0, 2.0]), (None, [2.0, 5.0])]
    df = spark.createDataFrame([*good.items(), *odd, *alone], ROW).selectExpr("*", "1 AS n", "2 AS d", "3 AS whitened", "4 AS w")
    rows = whitening.whiten(df).collect()
    check([r for r in rows if r["vec_id"] in good], good)
    pair = [r for r in rows if r["vec_id"] is None or r["vec_id"] >= 100]
    assert {r["vec_id"] for r in pair} == {105, None} and {r["n"] for r in pair} == {2}
    # Two points have one direction: the second eigenvalue is 0.
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in pair)


def test_repeated_rows_and_constant_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5])] * 4, ROW)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and all(r["n"] == 4 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in rows)


def test_empty_table(spark):
    found = whitening.whiten(spark.createDataFrame([], ROW))
    assert found.collect() == [] and "identity_error" in found.columns


def test_huge_components_do_not_fail(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], ROW)
    assert whitening.whiten(df).count() == 6
