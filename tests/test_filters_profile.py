import pytest
from pyspark.sql import functions as F

from loanweave.operators import (
    FilterSpec,
    apply_filters,
    bounds,
    counts,
    distinct_values,
    drop_outliers,
    histogram,
    portfolio_kpis,
    schema_report,
)
from loanweave.operators.filters import keep_members, predicate
from loanweave.sources import credit


@pytest.fixture
def people(spark):
    rows = [(1, "RENT", 30), (2, "OWN", 120), (3, None, 45), (4, "RENT", None)]
    return spark.createDataFrame(rows, "application_id bigint, person_home_ownership string, person_age int")


def ids(df):
    return sorted(r["application_id"] for r in df.collect())


def test_membership_drops_missing_but_absent_filter_keeps_them(people):
    everyone = FilterSpec(members={"person_home_ownership": ["RENT", "OWN"]})
    assert ids(apply_filters(people, everyone)) == [1, 2, 4]
    assert ids(apply_filters(people, FilterSpec(equals={"person_home_ownership": None}))) == [1, 2, 3, 4]
    assert ids(apply_filters(people, FilterSpec(members={"person_home_ownership": []}))) == []


@pytest.mark.parametrize("n", [1, 500, 501, 5000])
def test_membership_lists_of_any_length(spark, people, n):
    spec = FilterSpec(members={"application_id": list(range(3, 3 + n))}, ranges={"person_age": (0, 60)})
    assert ids(apply_filters(people, spec)) == ids(people.filter(predicate(people.columns, spec))) == [3]
    values = spark.range(3, 3 + n).selectExpr("CAST(id AS STRING) AS v")
    assert ids(keep_members(people, "application_id", values).filter("person_age <= 60")) == [3]


def test_optional_equality_compares_text_and_ignores_unknown_columns(people):
    assert ids(apply_filters(people, FilterSpec(equals={"person_age": "30", "nothing": "x"}))) == [1]


def test_outliers(spark):
    rows = [(100, 50.0), (101, 1.0), (30, 51.0), (30, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "person_age int, person_emp_length double")
    assert drop_outliers(df).count() == 1


def test_kpis_of_nothing_are_zero(loans):
    row = portfolio_kpis(loans.filter("person_age > 1000")).first()
    assert tuple(row) == (0, 0, 0.0, 0.0, 0.0)


def test_filters_reach_the_scan(spark, tmp_path, loans):
    loans.write.parquet(str(tmp_path / "loans"))
    df = spark.read.parquet(str(tmp_path / "loans"))
    spec = FilterSpec(members={"loan_intent": ["MEDICAL"]}, ranges={"person_age": (20, 30)})
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = portfolio_kpis(apply_filters(df, spec))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(loan_intent,MEDICAL)" in pushed and "GreaterThanOrEqual(person_age,20)" in pushed
    assert "person_emp_length" not in plan[plan.index("ReadSchema") :]


def test_label_free_queries_do_not_read_line_items(spark):
    larger = credit(spark, "/root/testdata/sf0.01")  # not the cached table of the other tests
    plan = lambda keys: counts(larger, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan(["loan_intent"])
    assert "l_orderkey" in plan(["loan_status"])


def test_histogram_with_one_value_and_empty_bins(spark):
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [r["n"] for r in histogram(same, "v", 4).orderBy("bin").collect()] == [2, 0, 0, 0]
    apart = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    rows = histogram(apart, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 1]
    assert (rows[0]["bin_low"], rows[3]["bin_high"]) == (0.0, 10.0)


def test_bounds_truncate(spark):
    row = bounds(spark.createDataFrame([(18.9,), (70.2,)], "v double"), "v").first()
    assert tuple(row) == (18, 70)


def test_share_sums_to_one(loans):
    assert counts(loans, ["loan_intent"], share=True).agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_options_are_sorted_without_missing(people):
    rows = distinct_values(people, ["person_home_ownership"]).collect()
    assert [r["option"] for r in rows] == ["OWN", "RENT"]


def test_schema_report_counts_missing(people):
    rows = {r["column_name"]: (r["column_type"], r["n_rows"], r["n_missing"]) for r in schema_report(people).collect()}
    assert rows["person_age"] == ("int", 4, 1)
    assert rows["person_home_ownership"] == ("string", 4, 1)
