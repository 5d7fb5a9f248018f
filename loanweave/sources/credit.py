"""The ``credit`` table derived from the order, customer and line-item tables.

Only the requested columns are derived. The line items, by far the largest input, are read and shuffled only when the
interest rate or the label (which depends on it) is among them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, KEY, LABEL

_FROM_LINES = {"loan_int_rate", LABEL}

# The columns read from each table. A declared schema spares the footer-reading job per query.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_discount double, l_tax double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _rates(lines: DataFrame) -> DataFrame:
    """Interest rate per order, from whole cents so that no summation order can change it.

    ``floor(x + 0.5)`` stays in primitive doubles, where ``round`` would build a BigDecimal per value.
    """
    cents = lines.groupBy(F.col("l_orderkey").alias(KEY)).agg(
        F.expr("sum(floor(l_discount * 100 + 0.5D))").alias("sd"),
        F.expr("sum(floor(l_tax * 100 + 0.5D))").alias("stx"),
        F.count("*").alias("n"),
    )
    rate = "(500 + floor(cast(120 * sd + 40 * stx as double) / cast(n as double))) / 100D AS loan_int_rate"
    return cents.selectExpr(KEY, rate)


def _base(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        f"o_orderkey AS {KEY}",
        "CASE WHEN o_custkey % 97 = 5 THEN 123 ELSE CAST(20 + (o_custkey * 7) % 50 AS INT) END AS person_age",
        "CAST(floor(15000 + (c_acctbal + 1000) * 8) AS DOUBLE) AS person_income",
        """CASE c_mktsegment WHEN 'MACHINERY' THEN 'RENT' WHEN 'FURNITURE' THEN 'RENT' WHEN 'BUILDING' THEN 'MORTGAGE'
           WHEN 'AUTOMOBILE' THEN 'OWN' ELSE 'OTHER' END AS person_home_ownership""",
        """CASE WHEN o_orderkey % 37 = 3 THEN NULL WHEN o_orderkey % 101 = 7 THEN 123D
           ELSE CAST((o_custkey * 13) % 41 AS DOUBLE) END AS person_emp_length""",
        """CASE WHEN o_orderkey % 16 = 0 THEN 'HOMEIMPROVEMENT' WHEN o_orderpriority = '1-URGENT' THEN 'MEDICAL'
           WHEN o_orderpriority = '2-HIGH' THEN 'DEBTCONSOLIDATION' WHEN o_orderpriority = '3-MEDIUM' THEN 'EDUCATION'
           WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'PERSONAL' ELSE 'VENTURE' END AS loan_intent""",
        "CAST(floor(o_totalprice / 15) AS DOUBLE) AS loan_amnt",
        "CASE WHEN o_custkey % 6 = 0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file",
        "CAST(2 + (o_custkey * 11) % 29 AS INT) AS cb_person_cred_hist_length",
        "o_orderstatus AS st",
    )


def credit(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The loan table, or the asked-for columns of it, in schema order."""
    wanted = set(columns) if columns is not None else set(COLUMNS)
    if unknown := wanted - set(COLUMNS):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    rows = _base(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    derived = {"loan_percent_income": "floor(loan_amnt * 100 / person_income) / 100D AS loan_percent_income"}
    if wanted & _FROM_LINES:
        rows = rows.join(_rates(table(spark, sf_dir, "lineitem")), KEY, "left")
        derived[LABEL] = f"""CASE WHEN {KEY} % 23 = 0 THEN 1 WHEN loan_amnt / person_income > 0.5D AND st <> 'O' THEN 1
            WHEN person_home_ownership = 'RENT' AND loan_int_rate > 14 THEN 1 ELSE 0 END AS {LABEL}"""
    return rows.selectExpr(*[derived.get(c, c) for c in COLUMNS if c in wanted])


def credit_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text, with planted faults: bad numbers, an unknown category, missing values, an extra column."""
    key = F.col(KEY)
    text = {c: F.col(c).cast("string") for c in COLUMNS}
    text["person_income"] = F.when(key % 50 == 1, "n/a").otherwise(text["person_income"])
    text["loan_amnt"] = F.when(key % 60 == 2, "12d").otherwise(text["loan_amnt"])
    text["loan_intent"] = F.when(key % 70 == 3, "WEDDING").otherwise(text["loan_intent"])
    text["person_home_ownership"] = F.when(key % 80 != 4, text["person_home_ownership"])
    text["person_age"] = F.when(key % 90 != 5, text["person_age"])
    return credit(spark, sf_dir).select(*[c.alias(n) for n, c in text.items()], F.lit("x").alias("note"))
