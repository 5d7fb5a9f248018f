"""Stored profiles merge without rows; kept models are loaded for the same table only; streamed reports add up."""

import pytest
from pyspark.sql import functions as F

from loanweave.operators import validate
from loanweave.operators.sketches import merge_profiles, profile_parts, rank_error, store_profiles, stored_profiles
from loanweave.plans.features import ForestParams, fit_labels, label_dictionary
from loanweave.plans.store import ModelStore
from loanweave.schema import KEY
from loanweave.sources import credit_dirty
from loanweave.streaming import merged_report, read_stream, tally_stream

from .conftest import SF

SMALL = ForestParams(num_trees=2, max_depth=2)


def test_parts_merge_to_the_whole(spark, tmp_path):
    values = [float(i * i % 1009) for i in range(5000)] + [None, float("nan")]
    df = spark.createDataFrame([(v, i % 13) for i, v in enumerate(values)], "x double, day int")
    path = str(tmp_path / "p")
    store_profiles(profile_parts(df.filter("day < 7"), ["x"], "day"), path)
    store_profiles(profile_parts(df.filter("day >= 6"), ["x"], "day"), path)  # day 6 once more: it is replaced, not added
    stored = stored_profiles(spark, path)
    assert stored.count() == 13
    row, known = merge_profiles(stored, [0.1, 0.5, 0.9]).first(), sorted(v for v in values if v is not None and v == v)
    assert (row["n"], row["n_missing"], row["low"], row["high"]) == (5000, 2, known[0], known[-1])
    mean = sum(known) / 5000
    assert row["mean"] == pytest.approx(mean)
    assert row["sd"] == pytest.approx((sum((v - mean) ** 2 for v in known) / 4999) ** 0.5)
    for p, q in zip((0.1, 0.5, 0.9), row["quantiles"]):
        below, upto = sum(v < q for v in known) / 5000, sum(v <= q for v in known) / 5000
        assert below <= p + rank_error() and upto >= p - rank_error()


def test_columns_and_parts_without_values(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 2.0, None)], "x double, y double, part string")
    rows = {r["column_name"]: r for r in merge_profiles(profile_parts(df, ["x", "y"], "part")).collect()}
    assert rows["x"]["n"] == 0 and rows["x"]["mean"] is None and list(rows["x"]["quantiles"]) == [None] * 3
    assert rows["y"]["n"] == 2 and rows["y"]["mean"] == 1.5
    assert merge_profiles(profile_parts(df.limit(0), ["x"], "part")).count() == 0


def test_no_profiles(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stored_profiles(spark, str(tmp_path / "none"))


def test_the_same_fit_is_loaded_and_a_changed_table_fitted_anew(spark, loans, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    first = store.forest(loans, SMALL)
    again = store.forest(loans.repartition(3), SMALL)
    assert not first.hit and again.hit and first.key == again.key
    p = lambda kept: sorted((r[KEY], float(r["probability"][1])) for r in kept.model.transform(loans).collect())
    assert p(first) == p(again)
    one_value = F.when(F.col(KEY) == loans.agg(F.min(KEY)).first()[0], F.lit(None)).otherwise(F.col("loan_int_rate"))
    assert not store.forest(loans.withColumn("loan_int_rate", one_value), SMALL).hit
    assert not store.forest(loans, ForestParams(num_trees=3, max_depth=2)).hit
    assert not store.forest(loans.unionByName(loans.limit(1)), SMALL).hit
    # What the fit does not read does not matter.
    assert store.forest(loans.withColumn("loan_percent_income", F.lit(0.0)), SMALL).hit


def test_changed_files_and_swapped_nulls(spark, loans, tmp_path):
    store, path = ModelStore(spark, str(tmp_path / "models")), str(tmp_path / "in")
    loans.write.parquet(path)
    assert not store.labels(spark.read.parquet(path)).hit
    kept = store.labels(spark.read.parquet(path))
    assert kept.hit and label_dictionary(kept.model) == label_dictionary(fit_labels(loans))
    loans.limit(10).write.mode("append").parquet(path)
    assert not store.labels(spark.read.parquet(path)).hit
    # A null in one column or in the other is not the same row.
    one = spark.createDataFrame([("RENT", None, "Y")], "person_home_ownership string, loan_intent string, cb_person_default_on_file string")
    two = spark.createDataFrame([(None, "RENT", "Y")], one.schema)
    from loanweave.plans.store import fingerprint

    assert fingerprint(one, one.columns, {}) != fingerprint(two, two.columns, {})


def test_a_fit_that_was_cut_off_is_not_loaded(spark, loans, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "models"))

    def fails(model, path):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patched:
        patched.setattr("loanweave.plans.store.save", fails)
        with pytest.raises(RuntimeError):
            store.labels(loans)
    assert not store.labels(loans).hit and store.labels(loans).hit


def test_streamed_tallies_equal_the_batch_report(spark, loans, tmp_path):
    labels = label_dictionary(fit_labels(loans))
    rows = credit_dirty(spark, SF)
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "out", "checkpoint"))
    for part in (rows.filter(f"{KEY} % 2 = 0"), rows.filter(f"{KEY} % 2 = 1")):
        part.write.mode("append").parquet(landing)
        tally_stream(read_stream(spark, landing, rows.schema), labels, out, checkpoint).awaitTermination()
    # A restart without new files adds nothing.
    tally_stream(read_stream(spark, landing, rows.schema), labels, out, checkpoint).awaitTermination()
    show = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert show(merged_report(spark, out, labels, rows.columns)) == show(validate(rows, labels, KEY))
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
    with pytest.raises(ValueError, match="loan_amnt"):
        tally_stream(read_stream(spark, landing, rows.drop("loan_amnt").schema), labels, out, checkpoint)
