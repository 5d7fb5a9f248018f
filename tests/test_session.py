"""Intermediate tables go when their scope ends; what was written before or outside stays."""

import os

import pytest

from loanweave.session import scratch_path, scratch_scope, written


def test_a_scope_removes_what_is_made_in_it(spark):
    kept = scratch_path(spark, "kept")
    with scratch_scope(spark):
        inner = written(spark.range(10), "inner")
        place = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(place)
        inner.filter("id > 5").write.parquet(kept)
        with scratch_scope(spark):
            deeper = scratch_path(spark, "deeper")
            spark.range(3).write.parquet(deeper)
        assert not os.path.exists(deeper) and os.path.isdir(place)
        scratch_path(spark, "never written")
    assert not os.path.exists(place)
    assert spark.read.parquet(kept).count() == 4


def test_a_scope_that_fails_cleans_up(spark):
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        path = scratch_path(spark, "failed")
        spark.range(3).write.parquet(path)
        raise ZeroDivisionError
    assert not os.path.exists(path)
    outside = scratch_path(spark, "outside")
    spark.range(3).write.parquet(outside)
    assert os.path.isdir(outside)
