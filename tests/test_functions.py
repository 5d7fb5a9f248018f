import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loanweave.functions import (
    ALERT_POLICY,
    REVIEW_POLICY,
    BandPolicy,
    decision,
    is_bad_number,
    risk_band,
    to_number,
    vector_element,
)


def test_numbers_from_text(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "-.5": -0.5, "3.": 3.0, "+7": 7.0,
        "": None, "12a": None, "12d": None, "1f": None, "NaN": None, "inf": None, "n/a": None, "0x1F": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", to_number(F.col("t")).alias("v"), is_bad_number(F.col("t")).alias("bad")).collect()
    assert {r["t"]: r["v"] for r in got} == cases
    assert {r["t"]: r["bad"] for r in got} == {t: v is None for t, v in cases.items()}


def test_missing_text_is_not_bad(spark):
    row = spark.createDataFrame([(None,)], "t string").select(is_bad_number(F.col("t")), to_number(F.col("t"))).first()
    assert tuple(row) == (False, None)


@pytest.mark.parametrize(
    ("policy", "expected"),
    [
        (REVIEW_POLICY, ["accept", "accept", "review", "review", "refuse", "refuse", "refuse", "refuse", None, None]),
        (ALERT_POLICY, ["low", "low", "moderate", "moderate", "moderate", "moderate", "high", "high", None, None]),
    ],
)
def test_bands_at_the_cut_points(spark, policy, expected):
    scores = [0.0, 0.2999, 0.30, 0.4999, 0.50, 0.5999, 0.60, 1.0, None, float("nan")]
    df = spark.createDataFrame(list(enumerate(scores)), "i int, p double")
    assert [r["b"] for r in df.select("i", risk_band(F.col("p"), policy).alias("b")).orderBy("i").collect()] == expected


def test_policies_are_checked():
    with pytest.raises(ValueError, match="one more name"):
        BandPolicy((0.5,), ("low",))
    with pytest.raises(ValueError, match="increase"):
        BandPolicy((0.5, 0.3), ("a", "b", "c"))


def test_decision(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "p int")
    assert [r[0] for r in df.select(decision(F.col("p"))).collect()] == ["default", "no default", None]


def test_vector_elements(spark):
    df = spark.createDataFrame([(Vectors.dense(0.25, 0.75),), (Vectors.dense(1.0),)], ["v"])
    assert [r[0] for r in df.select(vector_element("v", 1)).collect()] == [0.75, None]
