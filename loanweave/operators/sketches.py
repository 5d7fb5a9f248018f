"""Stored, mergeable profiles: one small row per part of a table and column, merged later without the rows.

A part is a day, a file or whatever the caller names. Counts, moments and bounds merge exactly; quantiles come from KLL
sketches, whose size does not depend on the rows and whose rank error is known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .profile import melt

SIZE = 2048
PROFILE_SCHEMA = (
    "part string, column_name string, n bigint, n_missing bigint, mean double, m2 double, low double, high double, sketch binary"
)


def rank_error(size: int = SIZE) -> float:
    """The part of the rows by which a sketched quantile's rank may be off, with a confidence of 99 %.

    Fixed values: the published error of these sketches.
    """
    return 2.296 / size**0.9021


def profile_parts(df: DataFrame, columns: Sequence[str], part: str, size: int = SIZE) -> DataFrame:
    """A row per part and column. One pass; a part is summed up on the map side, so a hot part is no hot task."""
    values = melt(df, columns, [part]).withColumn("value", F.nanvl("value", F.lit(None)))
    v = F.col("value")
    return values.groupBy(F.col(part).cast("string").alias("part"), F.col("feature").alias("column_name")).agg(
        F.count(v).alias("n"),
        F.count(F.when(v.isNull(), 1)).alias("n_missing"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"),
    )


def store_profiles(profiles: DataFrame, path: str) -> None:
    """Keep the profiles of some parts; parts that are stored already are replaced, all others stay."""
    by_part = profiles.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_part.partitionBy("part").parquet(path)


def stored_profiles(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PROFILE_SCHEMA).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no profiles at {path}") from exc
        raise


def merge_profiles(profiles: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, n, n_missing, mean, sd, low, high, quantiles) of all parts together, from the profiles alone.

    A column without a value has null moments and quantiles.
    """
    group = Window.partitionBy("column_name")
    total = F.sum("n").over(group)
    pooled = F.sum(F.col("n") * F.col("mean")).over(group) / F.nullif(total, F.lit(0))
    apart = F.coalesce(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("pooled"), 2), F.lit(0.0))
    merged = (
        profiles.withColumn("pooled", pooled)
        .groupBy("column_name", "pooled")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_missing").alias("n_missing"),
            F.sum(apart).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )
    some = F.col("n") > 0
    quantile = lambda p: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return merged.select(
        "column_name", "n", "n_missing", F.col("pooled").alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sd"),
        "low", "high", F.array(*[quantile(float(p)) for p in probs]).alias("quantiles"),
    )
