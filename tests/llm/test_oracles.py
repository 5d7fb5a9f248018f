"""The registered queries on the given tables, against SQL or what they must satisfy."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tools.check import compare, database

from ..conftest import SF

NAMES = sorted(n for n in contract.queries() if n.startswith("op"))
ORACLES = {n: s for n, s in contract.oracle_sql().items() if n.startswith("op")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    with database(SF) as con:
        expected = con.execute(ORACLES[name]).df()
    assert compare(contract.queries()[name](spark, SF).toPandas(), expected) == ""


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = contract.queries()["op1_language_id"](spark, SF).join(docs, "doc_id").filter("held_out and lang is not null")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n >= 0.95


def test_quality_ranks_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = contract.queries()["op9_quality"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert good and bad
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) >= 0.9
