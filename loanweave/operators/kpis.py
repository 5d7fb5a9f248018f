"""Portfolio indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL


def default_rate(label: Column) -> Column:
    """Share of all rows whose label is 1; 0 on an empty table."""
    return F.coalesce(F.try_divide(F.sum(label), F.count("*")), F.lit(0.0))


def portfolio_kpis(df: DataFrame) -> DataFrame:
    """Size, defaults, default rate in percent, mean income and mean loan in one pass; all 0 on an empty table."""
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(LABEL), F.lit(0)).alias("n_default"),
        (default_rate(F.col(LABEL)) * 100).alias("default_rate_pct"),
        F.coalesce(F.avg("person_income"), F.lit(0.0)).alias("mean_income"),
        F.coalesce(F.avg("loan_amnt"), F.lit(0.0)).alias("mean_loan"),
    )
