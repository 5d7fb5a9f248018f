import numpy as np
import pytest
from pyspark.sql import functions as F

from loanweave.llm.balltree import top_k
from loanweave.llm.itq import CHECK_BITS, learn, link_vectors, rotations, tables_for, turn_at

VEC = "vec_id bigint, embedding array<float>, label int"


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VEC)


def groups(seed, n, dims=32, noise=0.25):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 6 == 0:
            base = rng.standard_normal(dims)
        v = base + rng.standard_normal(dims) * noise * rng.random()
        rows.append((i, v.astype(np.float32).tolist()))
    return rows


ODD = [
    (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]),
    (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, []), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, -2.0]), (50, [1.0, 2.0]),
]


def cosines(rows):
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_recall_and_precision(spark):
    rows = groups(4, 1200)
    linked = cosines(rows) >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in link_vectors(make(spark, rows)).collect()}
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.9 * linked.sum()
    for i, _ in rows:
        c = got[i]["component_id"]
        assert got[i]["kept"] == (c == i) and c <= i and (c == i or linked[c].any())


def test_dense_group_is_counted_whole(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * 0.05).astype(np.float32).tolist()) for i in range(400)]
    got = link_vectors(make(spark, rows)).collect()
    assert {r["n_links"] for r in got} == {399} and {r["component_id"] for r in got} == {0}


def test_odd_vectors(spark):
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in link_vectors(make(spark, ODD)).collect()), key=str)
    same = {6, 7, None, 50}
    expected = [(i, 4 if i in same and v else 0, 6 if i in same else i) for i, v in ODD]
    assert got == sorted(expected, key=str)
    assert link_vectors(make(spark, [])).count() == 0


def common_direction(seed, n, mean, dims=64, near=40):
    """Unit vectors whose cosines are ``mean`` on average, and some close pairs among them."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(dims)
    base /= np.linalg.norm(base)
    noise = rng.standard_normal((n, dims))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.sqrt(mean) * base + np.sqrt(1 - mean) * noise
    for i in range(near):
        x[2 * i + 1] = x[2 * i] + rng.standard_normal(dims) * 0.04
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("mean, most", [(0.0, 0.01), (0.5, 0.03), (0.8, 0.15)])
def test_codes_are_balanced_and_buckets_small(mean, most):
    x = common_direction(3, 4000, mean)
    coder = learn(x, len(x))
    bits = coder.bits(x)
    share = bits.mean(axis=0)
    assert ((share > 0.2) & (share < 0.8)).all()
    pairs = 0
    for i in range(coder.tables):
        low = CHECK_BITS + i * coder.width
        _, counts = np.unique(bits[:, low : low + coder.width] @ (1 << np.arange(coder.width)), return_counts=True)
        pairs += (counts * (counts - 1) // 2).sum()
    assert pairs < most * len(x) * (len(x) - 1) / 2


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_recall_where_vectors_have_a_direction_in_common(spark, mean):
    x = common_direction(5, 1000, mean)
    linked = x.astype(np.float32).astype(np.float64)
    linked /= np.linalg.norm(linked, axis=1, keepdims=True)
    linked = linked @ linked.T >= 0.9
    np.fill_diagonal(linked, False)
    found = {r["vec_id"]: r["n_links"] for r in link_vectors(make(spark, list(enumerate(x.tolist())))).collect()}
    assert all(found[i] <= n for i, n in enumerate(linked.sum(axis=1)))
    assert sum(found.values()) >= 0.9 * linked.sum() > 0


def test_rotation_is_orthogonal():
    x = np.random.default_rng(1).standard_normal((300, 16))
    projection = rotations(x, 40, 7)
    first = projection[:, :16]
    assert np.allclose(first.T @ first, np.eye(16), atol=1e-8)
    assert projection.shape == (16, 40)


def test_tables_follow_the_angle_at_the_centre():
    assert turn_at(0.9, 1.0) == pytest.approx(np.arccos(0.9) / np.pi)
    assert turn_at(0.9, 0.2) == pytest.approx(1 / 3) and turn_at(0.9, 0.0) == 0.5
    assert tables_for(12, turn_at(0.9, 1.0)) < tables_for(12, turn_at(0.9, 0.5)) < tables_for(12, turn_at(0.9, 0.2))


@pytest.mark.parametrize("shard_rows", [8192, 100, 20])
def test_top_k_equals_brute_force(spark, shard_rows):
    rows = groups(5, 700, 16) + [(1000 + i, [0.25] * 16) for i in range(60)]
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(np.float64) * 256).astype(np.int64)
    ids = [i for i, _ in rows]
    expected = []
    for q, i in enumerate(ids):
        if i % 50 == 0:
            scores = sorted((-int(s), j) for j, s in zip(ids, x @ x[q]) if j != i)[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = top_k(make(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_top_k_of_odd_vectors(spark):
    got = top_k(make(spark, ODD), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (50, 1, 7, 256 * 256 * 10), (50, 2, 6, 256 * 256 * 5), (50, 3, 6, 256 * 256 * 5), (50, 4, 2, 0), (50, 5, 10, -256 * 256 * 5),
    ]
    assert top_k(make(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e8, 1.0]), (1, [1e8, 1.0]), (2, [1e8, 2.0])]
    got = top_k(make(spark, rows), F.col("vec_id") == 0).collect()
    big = 25_600_000_000**2
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, min(big + 2 * 65536, 2**63 - 1)), (1, min(big + 65536, 2**63 - 1))] or [
        r["vec_id"] for r in got
    ] == [1, 2]  # equal once both are at the limit
