"""Fitting, keeping and inspecting models."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import RFormula
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import with_key
from ..schema import CONTRACT, KEY, LABEL, NOT_A_FEATURE
from .features import SEED, ForestParams, build_pipeline

TRAINING_COLUMNS = (KEY, *[c for c in CONTRACT if c not in NOT_A_FEATURE], LABEL)


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for the passes of a fit; lost blocks are recomputed from lineage, full memory spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def balanced(df: DataFrame, key: str = KEY, partitions: int | None = None) -> DataFrame:
    """Training rows spread and ordered by key: one shuffle of a few narrow columns ahead of dozens of passes.

    It evens out what filters and joins left uneven, and it fixes which row comes where, so that the forest's per-row
    random draws are the same in every fit and in every task that is run again.
    """
    spread = df.repartition(key) if partitions is None else df.repartition(partitions, key)
    return spread.sortWithinPartitions(key)


def training_table(df: DataFrame) -> DataFrame:
    """What a fit of the whole pipeline reads."""
    return balanced(with_key(df).select(*TRAINING_COLUMNS))


def train(df: DataFrame, params: ForestParams = ForestParams(), relative_error: float = 0.001) -> PipelineModel:
    """Fit the whole pipeline on the columns it needs."""
    with persisted(training_table(df)) as rows:
        return build_pipeline(params, relative_error).fit(rows)


def fit_timed(pipeline: Pipeline, df: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """A pipeline fitted stage by stage, and the seconds each took: (stage, kind, seconds).

    A stage that only transforms takes its time in the next fit, which runs it.
    """
    fitted, times = [], []
    with persisted(df) as rows:
        rows.count()  # reading the table is no stage's time
        for i, stage in enumerate(pipeline.getStages()):
            start = time.perf_counter()
            model = stage.fit(rows) if isinstance(stage, Estimator) else stage
            times.append((i, type(model).__name__, time.perf_counter() - start))
            rows = model.transform(rows)
            fitted.append(model)
    return PipelineModel(fitted), df.sparkSession.createDataFrame(times, "stage int, kind string, seconds double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_linear(df: DataFrame, formula: str) -> PipelineModel:
    """Ordinary least squares from a formula, by the normal equations in one pass."""
    stages = [
        RFormula(formula=formula, featuresCol="terms", labelCol="target"),
        LinearRegression(featuresCol="terms", labelCol="target", solver="normal"),
    ]
    return Pipeline(stages=stages).fit(df)


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(term, coefficient) of a fitted linear model, intercept first."""
    fitted = model.stages[-1]
    names = model.stages[0].transform(df.limit(0)).schema["terms"].metadata["ml_attr"]["attrs"]
    terms = sorted((a["idx"], a["name"]) for group in names.values() for a in group)
    rows = [("(intercept)", float(fitted.intercept))]
    rows += [(name, float(fitted.coefficients[i])) for i, name in terms]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def fit_tree(df: DataFrame, vector: str, label: str, **params) -> PipelineModel:
    """Multi-class decision tree of ``label`` on all elements of an array column."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("inputs"), F.col(label))
    stages = [
        RFormula(formula=f"{label} ~ .", featuresCol="terms", labelCol="target"),
        DecisionTreeClassifier(featuresCol="terms", labelCol="target", seed=SEED, **params),
    ]
    with persisted(rows) as kept:
        return Pipeline(stages=stages).fit(kept)


def predict_tree(model: PipelineModel, df: DataFrame, vector: str) -> DataFrame:
    inputs = array_to_vector(F.col(vector).cast("array<double>"))
    return model.transform(df.withColumn("inputs", inputs)).drop("inputs", "terms", "target")
