"""Exact quantiles per group without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which fails on a continuous column of a
large group. Here a first pass builds mergeable sketches of bounded size (``percentile_approx``), whose known rank
error gives an interval around each wanted rank. A second pass keeps single values only inside those intervals and
folds each stretch between them to one row (count, smallest, largest, total), already on the map side. The intervals are
cut into equal parts; a running count over the parts, of which a group has a fixed number, says which of them hold a
wanted rank, and only the values of such a part are ranked, each part by itself.

The sketches are written before the second pass. Then the planner knows their size: those of few groups are broadcast,
and no row of the table is shuffled to meet them, where a sort-merge join sorts all rows of a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ACCURACY = 50_000  # rank error of a sketch: at most rows / ACCURACY
PARTS = 1024  # of each interval


def _edges(probs: Sequence[float], accuracy: int) -> list[float]:
    slack = 2.0 / accuracy
    return [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]


def _attach(rows: DataFrame, keys: list[str], small: DataFrame) -> DataFrame:
    """Join a table with one row per key to each row; null is a key like any other."""
    named = small.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return rows.join(named, same).drop(*[f"_{c}" for c in keys])


def _part(v: Column, edges: list[Column]) -> Column:
    """Which of the equal parts between the edges around it a value lies in; grows with the value."""
    low = F.greatest(*[F.when(v > e, e) for e in edges])
    high = F.least(*[F.when(v <= e, e) for e in edges])
    width = high - low
    index = F.least(F.floor((v - low) / width * PARTS), F.lit(PARTS - 1))
    return F.when((width > 0) & (width < float("inf")), index).otherwise(0).cast("int")


def exact_quantiles(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    probs: Sequence[float],
    interpolate: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: the ``by`` columns, ``n`` non-missing values, their ``min``, ``mean`` and ``max``, and ``q``,
    the quantiles in the order of ``probs``.

    ``interpolate`` chooses between the linearly interpolated quantile and the smallest observed value whose
    cumulative share reaches the probability.
    """
    by, k = list(by), len(probs)
    v, edge = F.col("v"), lambda i: F.get("edges", F.lit(i))
    rows = df.select(*by, F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan("v"))
    sketch = rows.groupBy(*by).agg(F.percentile_approx("v", _edges(probs, accuracy), accuracy).alias("edges"))

    edges = [edge(i) for i in range(2 * k)]
    inside = reduce(lambda a, b: a | b, [v.between(edge(2 * i), edge(2 * i + 1)) for i in range(k)])
    stretch = reduce(lambda a, b: a + b, [(v > e).cast("int") for e in edges])
    place = [*by, "stretch", "part"]
    folded = (
        _attach(rows, by, written(sketch, "sketch"))
        .select(
            *by,
            "v",
            stretch.alias("stretch"),
            F.when(inside, _part(v, edges)).otherwise(0).alias("part"),
            F.when(inside, v).alias("single"),
        )
        .groupBy(*place, "single")
        .agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))
    )

    def ranks(p: float) -> list[Column]:
        """The 0-based ranks that a quantile needs."""
        if not interpolate:
            return [F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))]
        position = F.lit(p) * (F.col("n") - 1)
        return [F.floor(position), F.ceil(position)]

    def here(rank: Column) -> Column:
        return (F.col("start") <= rank) & (rank < F.col("end"))

    group = Window.partitionBy(*by)
    running = group.orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = folded.groupBy(*place).agg(
        F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")
    )
    counted = parts.withColumns(
        {
            "end": F.sum("m").over(running),
            "n": F.sum("m").over(group),
            "min": F.min("low").over(group),
            "mean": F.sum("total").over(group) / F.sum("m").over(group),
            "max": F.max("high").over(group),
        }
    ).withColumn("start", F.col("end") - F.col("m"))
    needed = counted.filter(reduce(lambda a, b: a | b, [here(r) for p in probs for r in ranks(p)]))
    needed = needed.select(*place, F.col("start").alias("before"), "n", "min", "mean", "max")

    in_part = Window.partitionBy(*place).orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        _attach(folded.drop("total"), place, needed)
        .withColumn("end", F.col("before") + F.sum("m").over(in_part))
        .withColumn("start", F.col("end") - F.col("m"))
    )

    def at(rank: Column) -> Column:
        """Value at a 0-based rank of the group."""
        known = (
            F.when(rank == F.col("start"), F.col("low"))
            .when(rank == F.col("end") - 1, F.col("high"))
            .when(F.col("low") == F.col("high"), F.col("low"))
            .otherwise(F.raise_error(F.lit("a quantile fell outside its interval")).cast("double"))
        )
        return F.max(F.when(here(rank), known))

    def quantile(p: float) -> Column:
        if not interpolate:
            return at(*ranks(p))
        position = F.lit(p) * (F.col("n") - 1)
        lower, upper = (at(r) for r in ranks(p))
        return lower + (upper - lower) * (position - F.floor(position))

    return ranked.groupBy(*by, "n", "min", "mean", "max").agg(F.array(*[quantile(p) for p in probs]).alias("q"))
