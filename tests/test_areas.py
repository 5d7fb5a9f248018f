"""Areas under ROC by group against pairs counted one by one."""

import random

import pytest

from loanweave.operators import auc, auc_by_group

SCHEMA = "g string, s double, loan_status int"


def by_hand(rows):
    out = {}
    for g in {r[0] for r in rows}:
        pos = [s for h, s, y in rows if h == g and y == 1 and s is not None and s == s]
        neg = [s for h, s, y in rows if h == g and y == 0 and s is not None and s == s]
        pairs = [(p > n) + 0.5 * (p == n) for p in pos for n in neg]
        out[g] = (len(pos), len(neg), sum(pairs) / len(pairs) if pairs else None)
    return out


@pytest.mark.parametrize("values", [4, 10**9])
def test_equals_pairs(spark, values):
    rng = random.Random(values)
    names = ["hot"] * 8 + ["a", "b", None]
    rows = [(rng.choice(names), rng.randrange(values) / values - 0.5, rng.randrange(2)) for _ in range(600)]
    rows += [("a", None, 1), ("b", float("nan"), 0), ("one", 0.5, 1), ("one", 0.7, 1), ("hot", 0.1, None)]
    found = {r["g"]: (r["n_pos"], r["n_neg"], r["area"]) for r in auc_by_group(spark.createDataFrame(rows, SCHEMA), ["g"], "s").collect()}
    expected = by_hand([r for r in rows if r[2] is not None])
    assert set(found) == set(expected)
    for g, (p, n, area) in expected.items():
        assert found[g][:2] == (p, n) and found[g][2] == (pytest.approx(area, abs=1e-12) if area is not None else None)


def test_without_groups_equals_the_evaluator(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([("x", round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(500)], SCHEMA)
    row = auc_by_group(rows, [], "s").first()
    assert row["area"] == pytest.approx(auc(rows, "s"), abs=1e-12)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert auc_by_group(empty, ["g"], "s").count() == 0
    assert auc_by_group(empty, [], "s").first()["area"] is None
