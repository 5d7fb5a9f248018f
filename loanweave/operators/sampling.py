"""Samples, splits and folds. All depend on the row key alone, never on partitioning, and none sorts the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS, HASH_DIGITS, key_bucket, key_digest, key_hash
from ..schema import KEY

TRAIN_SHARE = 0.8


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows in a given order."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = KEY) -> DataFrame:
    """``min(n, rows)`` rows without replacement: those with the smallest key digest.

    A top-n alone makes every task send n rows to a single one. A cut on the digest, set from the row count so that
    about 4n + 100 rows pass, comes first; should fewer than n pass, the condition lets all rows through.
    """
    digest = key_digest(F.col(key), seed)
    prefix = key_hash(F.col(key), seed)
    total = df.agg(F.count("*").alias("total"))
    share = F.least(F.lit(4.0 * n + 100) / F.greatest(F.col("total"), F.lit(1)), F.lit(1.0))
    top = (share * F.lit(float(16**HASH_DIGITS - 1))).cast("bigint")
    cut = total.select(F.lpad(F.lower(F.hex(top)), HASH_DIGITS, "0").alias("cut")).scalar()
    enough = df.filter(prefix <= cut).agg((F.count("*") >= n).alias("enough")).scalar()
    candidates = df.filter((prefix <= cut) | ~enough)
    return candidates.orderBy(digest, key).limit(n)


def is_train(train: float = TRAIN_SHARE, seed: int = 123, key: str = KEY):
    return key_bucket(F.col(key), seed) < round(train * BUCKETS)


def split(df: DataFrame, train: float = TRAIN_SHARE, seed: int = 123, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by key bucket: a pure filter, no shuffle."""
    chosen = is_train(train, seed, key)
    return df.filter(chosen), df.filter(~chosen)


def with_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """The table with a row key: its own, or else a digest over all columns. Equal rows share a key."""
    if key in df.columns:
        return df
    values = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in df.columns]
    return df.withColumn(key, F.md5(F.concat_ws("\x1f", *values)))


def with_folds(df: DataFrame, k: int, seed: int = 321, key: str = KEY) -> DataFrame:
    """Append ``fold`` (0 .. k-1), from a digest of its own: even on any table, split or not."""
    return df.withColumn("fold", F.floor(key_bucket(F.col(key), seed) * k / F.lit(BUCKETS)).cast("int"))


def with_stratified_split(
    df: DataFrame, strata: str, train: float = 0.75, seed: int = 123, key: str = KEY
) -> DataFrame:
    """Append ``is_train``: exactly ``ceil(train * size)`` rows of each stratum, those with the smallest key hash.

    A stratum is never sorted. Its rows are counted per hash range, which is even because the hash is; a running count
    over the ranges finds the one where the quota is met, and only that range (1 in 65,536) is ranked, one entry per
    key. Rows that share a key stay together.
    """
    rows = df.select(F.col(strata).alias("s"), F.col(key).alias("k")).withColumn("h", key_hash(F.col("k"), seed))
    hash_range = F.substring("h", 1, 4)
    stratum = Window.partitionBy("s")

    def where_met(tally: DataFrame, quota: Column, *order: str) -> DataFrame:
        """The row of each stratum whose running count reaches the quota, with what is ``missing`` before it."""
        running = stratum.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = tally.withColumns({"end": F.sum("n").over(running), "quota": quota})
        before = F.col("end") - F.col("n")
        met = counted.filter((F.col("end") >= F.col("quota")) & (before < F.col("quota")))
        return met.withColumn("missing", F.col("quota") - before)

    per_range = rows.withColumn("r", hash_range).groupBy("s", "r").agg(F.count("*").alias("n"))
    cut_range = where_met(per_range, F.ceil(F.lit(train) * F.sum("n").over(stratum)), "r")
    # One row per stratum; the joins are null-safe, and Catalyst broadcasts the small side where it is small.
    cuts = cut_range.select(F.col("s").alias("cut_s"), F.col("r").alias("cut_r"), F.col("missing").alias("take"))
    per_key = (
        rows.join(cuts, F.col("s").eqNullSafe(F.col("cut_s")) & (hash_range == F.col("cut_r")))
        .groupBy("s", "h", "k", "take")
        .agg(F.count("*").alias("n"))
    )
    last = where_met(per_key, F.col("take"), "h", "k").select(
        F.col("s").alias("_s"), F.struct("h", "k").alias("_last")
    )
    mark = F.struct(key_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    joined = df.join(last, F.col(strata).eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("is_train", F.coalesce(mark <= F.col("_last"), F.lit(False))).drop("_s", "_last")


def stratified_split(df: DataFrame, strata: str, train: float = 0.75, seed: int = 123, key: str = KEY):
    """Train and test rows with the same mix of strata."""
    marked = with_stratified_split(df, strata, train, seed, key)
    chosen = F.col("is_train")
    return marked.filter(chosen).drop("is_train"), marked.filter(~chosen).drop("is_train")
