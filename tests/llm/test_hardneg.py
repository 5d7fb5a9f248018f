"""Hard negatives against brute force, and the stream's windows."""

import random

import pytest
from pyspark.sql import functions as F

from loanweave.llm import hardneg

ROW = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, is_anchor, positives=5, negatives=5, least=80):
    whole = [
        (i, [int(256 * x // 1) for x in v], y) for i, v, y in rows
        if i is not None and v is not None and y is not None and all(x is not None and abs(x) < float("inf") for x in v)
    ]
    out = []
    for a, v, y in whole:
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in whole if i != a and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for minus, p, _ in [s for s in scored if s[2] == y][:positives]:
            score = -minus
            inside = [s for s in scored if s[2] != y and least * score <= -100 * s[0] <= 100 * score]
            out += [(a, p, rank, i, score, -m) for rank, (m, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, every=3, **options):
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # Few distinct values, so that scores tie within and across labels.
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 0.75]) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    assert mined(spark.createDataFrame(rows, ROW)) == by_hand(rows, lambda i: i % 3 == 0)


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", 8)
    monkeypatch.setattr(hardneg, "AT_ONCE", 16)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], rng.randrange(4)) for i in range(150)]
    rows += [(1000 + i, [0.5, 0.5, 0.5], i % 2) for i in range(80)]  # a group of copies
    df = spark.createDataFrame(rows, ROW)
    assert mined(df) == by_hand(rows, lambda i: i % 3 == 0)
    assert mined(df, positives=2, negatives=3, least=50) == by_hand(rows, lambda i: i % 3 == 0, 2, 3, 50)


def test_odd_rows(spark):
    base = [(i, [1.0, i / 10], i % 2) for i in range(12)]
    odd = [
        (30, None, 1), (33, [1.0, None], 1), (36, [1.0, float("nan")], 0), (39, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0),
        (42, [1.0, 1.0], None), (45, [], 1), (48, [1.0, 1.0, 1.0], 1), (51, [0.0, 0.0], 0), (54, [-1.0, -1.0], 1),
    ]
    df = spark.createDataFrame(base + odd, ROW).selectExpr("*", "1 AS uid", "2 AS d", "3 AS tops", "4 AS score", "'x' AS anchor")
    assert mined(df) == by_hand(base + odd, lambda i: i % 3 == 0)


def test_repeated_rows(spark):
    rows = [(3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (5, [0.9, 0.0], 1), (5, [0.9, 0.0], 1)]
    assert mined(spark.createDataFrame(rows, ROW)) == by_hand(rows, lambda i: i % 3 == 0)
    assert len(mined(spark.createDataFrame(rows, ROW))) == 4  # two anchors, one positive, two rows of one negative


def test_empty_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], ROW)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], ROW)) == []


def test_huge_scores_are_held(spark):
    df = spark.createDataFrame([(0, [3e38], 0), (1, [3e38], 0), (2, [3e38], 1)], ROW)
    assert mined(df) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_keys_sort_by_anchor_descending_score_id():
    keys = [(a, s, i) for a in (0, 7) for s in (-(2**63), -5, 0, 2**63 - 1) for i in (-3, 0, 9)]
    packed = sorted(hardneg.packed_key(*k) for k in keys)
    assert [hardneg.unpacked_key(k) for k in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2]))


def test_windows_read_the_stream_once():
    pairs = [(0, 100, 4, None), (0, 100, 5, 50), (0, 100, 6, None), (0, 90, 7, 50), (0, 80, 8, None), (0, 71, 9, None), (1, 71, 9, None)]
    stream = iter([(hardneg.packed_key(a, s, i), v) for a, s, i, v in pairs])
    assert list(hardneg.windows(stream, k=3)) == [
        (50, 5, 1, 4, 100, 100), (50, 5, 2, 6, 100, 100), (50, 5, 3, 8, 100, 80), (50, 7, 1, 8, 90, 80),
    ]


def test_lower_end_rounds_up():
    assert [hardneg.lower_end(s) for s in (100, 101, 1, 0, -10)] == [80, 81, 1, 0, -8]
