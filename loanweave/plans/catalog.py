"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's or the given name; ``sql`` is its oracle, if SQL can express it."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# The loan table for the oracles; sources/credit.py derives the same with the DataFrame API.
CREDIT_SQL = """
WITH li AS (
  SELECT l_orderkey, SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS sd,
         SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS stx, COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS application_id,
    CASE WHEN o.o_custkey % 97 = 5 THEN 123
         ELSE CAST(20 + (o.o_custkey * 7) % 50 AS INT) END AS person_age,
    CAST(FLOOR(15000 + (c.c_acctbal + 1000) * 8) AS DOUBLE) AS person_income,
    CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'RENT' WHEN 'FURNITURE' THEN 'RENT'
         WHEN 'BUILDING' THEN 'MORTGAGE' WHEN 'AUTOMOBILE' THEN 'OWN' ELSE 'OTHER' END AS person_home_ownership,
    CASE WHEN o.o_orderkey % 37 = 3 THEN NULL
         WHEN o.o_orderkey % 101 = 7 THEN CAST(123 AS DOUBLE)
         ELSE CAST((o.o_custkey * 13) % 41 AS DOUBLE) END AS person_emp_length,
    CASE WHEN o.o_orderkey % 16 = 0 THEN 'HOMEIMPROVEMENT'
         WHEN o.o_orderpriority = '1-URGENT' THEN 'MEDICAL'
         WHEN o.o_orderpriority = '2-HIGH' THEN 'DEBTCONSOLIDATION'
         WHEN o.o_orderpriority = '3-MEDIUM' THEN 'EDUCATION'
         WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'PERSONAL' ELSE 'VENTURE' END AS loan_intent,
    CAST(FLOOR(o.o_totalprice / 15) AS DOUBLE) AS loan_amnt,
    CASE WHEN li.n IS NULL THEN NULL
         ELSE (500 + FLOOR(CAST(120 * li.sd + 40 * li.stx AS DOUBLE) / CAST(li.n AS DOUBLE))) / CAST(100 AS DOUBLE)
         END AS loan_int_rate,
    CASE WHEN o.o_custkey % 6 = 0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
    CAST(2 + (o.o_custkey * 11) % 29 AS INT) AS cb_person_cred_hist_length,
    o.o_orderstatus AS st
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
credit AS (
  SELECT application_id, person_age, person_income, person_home_ownership, person_emp_length,
    loan_intent, loan_amnt, loan_int_rate,
    FLOOR(loan_amnt * 100 / person_income) / CAST(100 AS DOUBLE) AS loan_percent_income,
    cb_person_default_on_file, cb_person_cred_hist_length,
    CAST(CASE WHEN application_id % 23 = 0 THEN 1
              WHEN loan_amnt / person_income > 0.5 AND st <> 'O' THEN 1
              WHEN person_home_ownership = 'RENT' AND loan_int_rate > 14 THEN 1 ELSE 0 END AS INT) AS loan_status
  FROM base)"""

# The same with every column as text and planted faults.
DIRTY_SQL = (
    CREDIT_SQL
    + """,
credit_dirty AS (
  SELECT CAST(application_id AS VARCHAR) AS application_id, application_id AS k,
    CASE WHEN application_id % 90 = 5 THEN NULL ELSE CAST(person_age AS VARCHAR) END AS person_age,
    CASE WHEN application_id % 50 = 1 THEN 'n/a' ELSE CAST(person_income AS VARCHAR) END AS person_income,
    CASE WHEN application_id % 80 = 4 THEN NULL ELSE person_home_ownership END AS person_home_ownership,
    CAST(person_emp_length AS VARCHAR) AS person_emp_length,
    CASE WHEN application_id % 70 = 3 THEN 'WEDDING' ELSE loan_intent END AS loan_intent,
    CASE WHEN application_id % 60 = 2 THEN '12d' ELSE CAST(loan_amnt AS VARCHAR) END AS loan_amnt,
    CAST(loan_int_rate AS VARCHAR) AS loan_int_rate,
    CAST(loan_percent_income AS VARCHAR) AS loan_percent_income,
    cb_person_default_on_file, CAST(cb_person_cred_hist_length AS VARCHAR) AS cb_person_cred_hist_length,
    CAST(loan_status AS VARCHAR) AS loan_status, 'x' AS note
  FROM credit)"""
)


def bucket_sql(seed: int) -> str:
    """The bucket of the row key: leading digits of its digest, as a number, modulo 1000."""
    return f"(CAST('0x' || SUBSTR(MD5(CAST(application_id AS VARCHAR) || '-{seed}'), 1, 13) AS BIGINT) % 1000)"


BUCKET_SQL = bucket_sql(123)
FOLD_SQL = f"CAST(FLOOR({bucket_sql(321)} * 5 / 1000) AS INT)"


def over_credit(select: str) -> str:
    """An oracle over the loan table; ``select`` may open with ', name AS (...)' to add tables of its own."""
    return f"{CREDIT_SQL}\n{select}"


def over_dirty(select: str) -> str:
    return f"{DIRTY_SQL}\n{select}"
