"""Profiling of a table: schema, bounds, moments, quartiles, tallies, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL
from ..session import written
from .quantiles import exact_quantiles


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(kept columns, feature, value): one row per input row and column."""
    return df.select(*keep, *[F.col(c).cast(as_type).alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value"
    )


def _spread(row: DataFrame, items: Sequence[tuple]) -> DataFrame:
    """A one-row aggregate to one row per item; each item lists the same-named columns of its row."""
    return row.select(F.inline(F.array(*[F.struct(*item) for item in items])))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows and missing values."""
    columns = df.columns
    counted = df.agg(F.count("*").alias("rows"), *[F.count(F.col(c)).alias(c) for c in columns])
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return _spread(
        counted,
        [
            (
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("column_type"),
                F.col("rows").alias("n_rows"),
                (F.col("rows") - F.col(c)).alias("n_missing"),
            )
            for i, c in enumerate(columns)
        ],
    )


def bounds(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value, truncated to whole numbers."""
    return df.agg(F.min(column).cast("bigint").alias("low"), F.max(column).cast("bigint").alias("high"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of each column, in one pass."""
    measures = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(
        *[
            (fn(c) if m == "n" else fn(F.col(c).cast("double"))).alias(f"{m}:{c}")
            for c in columns
            for m, fn in measures.items()
        ]
    )
    return _spread(
        wide, [(F.lit(c).alias("feature"), *[F.col(f"{m}:{c}").alias(m) for m in measures]) for c in columns]
    )


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, minimum and maximum of each text column, in one pass."""
    measures = {"n": F.count, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(F.col(c)).alias(f"{m}:{c}") for c in columns for m, fn in measures.items()])
    return _spread(
        wide, [(F.lit(c).alias("feature"), *[F.col(f"{m}:{c}").alias(m) for m in measures]) for c in columns]
    )


def summary_quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each column. The columns are written once for the passes over them."""
    narrow = written(df.select(*dict.fromkeys(columns)), "quartiles")
    quartiles = exact_quantiles(melt(narrow, columns), "value", ["feature"], [0.25, 0.5, 0.75])
    q1, median, q3 = (F.get("q", F.lit(i)) for i in range(3))
    return quartiles.select("feature", "min", q1.alias("q1"), median.alias("median"), "mean", q3.alias("q3"), "max")


def counts(df: DataFrame, keys: Sequence[str], share: bool = False) -> DataFrame:
    """Rows per key, optionally with the share of all rows."""
    tally = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return tally.withColumn("share", F.col("n") / tally.agg(F.sum("n")).scalar()) if share else tally


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of each categorical column."""
    return counts(melt(df, columns, as_type="string").withColumnRenamed("value", "level"), ["feature", "level"])


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct non-missing values of each column, as text."""
    options = level_counts(df, columns).filter(F.col("level").isNotNull())
    return options.select(F.col("feature").alias("column_name"), F.col("level").alias("option")).orderBy(
        "column_name", "option"
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin of a column, missing values left out and empty bins included."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    limits = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("limits")).scalar()
    low, width = F.col("limits.low"), (F.col("limits.high") - F.col("limits.low")) / bins
    index = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    tally = (
        values.withColumn("limits", limits)
        .select(F.when(width == 0, 0).otherwise(index).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    every_bin = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every_bin.join(tally, "bin", "left")
        .withColumn("limits", limits)
        .select(
            "bin",
            (low + F.col("bin") * width).alias("bin_low"),
            (low + (F.col("bin") + 1) * width).alias("bin_high"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def box_stats(df: DataFrame, columns: Sequence[str], by: str = LABEL) -> DataFrame:
    """Box-plot statistics of each column per value of ``by``: quartiles, whiskers at 1.5 IQR and outliers.

    The columns are written once for the passes over them; the boxes too, so that the planner knows how few they are and
    sends them to the rows.
    """
    narrow = written(df.select(*dict.fromkeys([by, *columns])), "box")
    long = melt(narrow, columns, keep=[by]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    quartiles = exact_quantiles(long, "value", [by, "feature"], [0.25, 0.5, 0.75])
    q1, median, q3 = (F.get("q", F.lit(i)) for i in range(3))
    fence = 1.5 * (q3 - q1)
    box = F.struct(
        q1.alias("q1"), median.alias("median"), q3.alias("q3"), (q1 - fence).alias("lo"), (q3 + fence).alias("hi")
    )
    boxes = written(quartiles.select(F.col(by).alias("_by"), F.col("feature").alias("_feature"), box.alias("box")), "boxes")
    value, within = F.col("value"), F.col("value").between(F.col("box.lo"), F.col("box.hi"))
    return (
        long.join(boxes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("feature") == F.col("_feature")))
        .groupBy("feature", by, "box.q1", "box.median", "box.q3")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(within, value)).alias("whisker_low"),
            F.max(F.when(within, value)).alias("whisker_high"),
            F.count(F.when(~within, 1)).alias("n_outliers"),
        )
    )
