import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loanweave.functions import key_bucket
from loanweave.operators import sample_n, split, stratified_split, with_folds, with_key, with_stratified_split
from loanweave.schema import KEY


def digest(key: int, seed: int) -> str:
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


def keys(df) -> set[int]:
    return {r[KEY] for r in df.select(KEY).collect()}


def test_bucket_formula_and_large_keys(spark):
    values = [0, 1, 999, 1000, 123456, 2**40, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "k bigint").select("k", key_bucket(F.col("k")).alias("b"))
    assert {r["k"]: r["b"] for r in df.collect()} == {v: int(digest(v, 123)[:13], 16) % 1000 for v in values}


@pytest.mark.parametrize("key", ["id * 1000", "concat('A-', id)", "IF(id % 2 = 0, NULL, id)"])
def test_no_key_is_lost_and_none_fills_one_part(spark, key):
    df = spark.range(4000).selectExpr(f"{key} AS {KEY}", "1 AS loan_status")
    train, test = split(df)
    assert train.count() + test.count() == 4000
    folds = [r["count"] for r in with_folds(df.filter(f"{KEY} is not null"), 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) < 1.3 * min(folds)
    assert train.count() > 1000


def test_a_table_without_key_gets_one(spark):
    df = with_key(spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int"))
    assert df.select(KEY).distinct().count() == 2 and with_key(df) is df


def test_split_covers_the_table_once(loans):
    train, test = split(loans)
    assert keys(train) | keys(test) == keys(loans)
    assert not keys(train) & keys(test)


def test_folds_cover_training_rows_and_mix_categories(loans):
    train, _ = split(loans)
    folds = with_folds(train, 5).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("loan_intent").alias("d"))
    rows = folds.collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3, 4]
    assert all(r["d"] == 6 for r in rows)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 10_000])
def test_sample_is_the_smallest_digests(spark, n):
    df = spark.range(3000).withColumnRenamed("id", KEY).repartition(6)
    expected = sorted(range(3000), key=lambda k: (digest(k, 42), k))[:n]
    assert keys(sample_n(df, n)) == set(expected)


def test_sample_does_not_depend_on_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", KEY)
    assert keys(sample_n(df.repartition(1), 100)) == keys(sample_n(df.repartition(13), 100))


def test_sample_of_nothing(spark):
    assert sample_n(spark.range(0).withColumnRenamed("id", KEY), 5).count() == 0


def test_stratified_quota_is_exact(spark):
    strata = {0: 997, 1: 301, 2: 1, None: 50}
    rows = [(i * 10 + j, s) for j, (s, size) in enumerate(strata.items()) for i in range(size)]
    df = spark.createDataFrame(rows, f"{KEY} bigint, s int").repartition(7)
    train, test = stratified_split(df, "s", 0.75)
    taken = Counter(r["s"] for r in train.collect())
    assert taken == {s: math.ceil(0.75 * size) for s, size in strata.items()}
    assert train.count() + test.count() == len(rows)
    chosen = {r[KEY] for r in train.filter("s = 0").collect()}
    by_hash = sorted((k for k, s in rows if s == 0), key=lambda k: (digest(k, 123)[:13], k))
    assert chosen == set(by_hash[: math.ceil(0.75 * 997)])


def test_stratified_split_keeps_copies_of_a_key_together(spark):
    rows = [(i, 0) for i in range(200)] + [(7, 0)] * 100
    df = spark.createDataFrame(rows, f"{KEY} bigint, s int")
    marked = with_stratified_split(df, "s", 0.5).collect()
    assert len(marked) == 300
    assert len({r["is_train"] for r in marked if r[KEY] == 7}) == 1
