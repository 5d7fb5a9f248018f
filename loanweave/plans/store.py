"""Fitted pipelines kept across calls, under a fingerprint of what they were fitted on and how.

The fingerprint covers the columns and types, the files and their sizes, the number of rows, two digests over all of them
that do not depend on their order, and the settings. The same fit is loaded; a table of which a single value changed is
fitted anew. A fit is listed only after it is written whole, so one that was cut off is never loaded.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORICAL
from .features import ForestParams, fit_labels
from .training import TRAINING_COLUMNS, load, save, train


@dataclass(frozen=True)
class Kept:
    model: PipelineModel
    hit: bool  # loaded, not fitted
    key: str


def files_of(df: DataFrame) -> list[tuple[str, int]]:
    """Input files and their sizes; their content is not read."""
    paths = sorted(df.inputFiles())
    if not paths:
        return []
    listed = df.sparkSession.read.format("binaryFile").load(paths).select("path", "length").collect()
    return sorted((r["path"], r["length"]) for r in listed)


def fingerprint(df: DataFrame, columns: Sequence[str], settings: dict) -> str:
    """One aggregation over the columns that the fit reads."""
    rows = df.select(*columns)
    digest = lambda seed: F.xxhash64(F.lit(seed), *rows.columns)
    summed = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(digest(1).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"),
        F.coalesce(F.bit_xor(digest(2)), F.lit(0)).alias("xor"),
        # Nulls leave a row digest as it was, so they are counted apart.
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null{i}") for i, c in enumerate(rows.columns)],
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), digest(3 + i).cast("decimal(38,0)"))), F.lit(0)).cast("string").alias(f"at{i}")
          for i, c in enumerate(rows.columns)],
    ).first()
    known = [rows.schema.jsonValue(), files_of(df), list(summed), settings]
    return hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()


class ModelStore:
    """A folder of fits that all executors and later sessions can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, key: str) -> str | None:
        """Folder of the kept model, if one was written whole."""
        try:
            found = self.spark.read.schema("folder string").json(f"{self.path}/{key}/listed").first()
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return found["folder"] if found else None

    def get(self, df: DataFrame, columns: Sequence[str], settings: dict, fit: Callable[[DataFrame], PipelineModel]) -> Kept:
        """The model that ``fit`` gives for the table, loaded if it was fitted before under the same settings."""
        key = fingerprint(df, columns, settings)
        if folder := self._listed(key):
            return Kept(load(f"{self.path}/{key}/{folder}"), True, key)
        model, folder = fit(df), f"model-{uuid.uuid4().hex}"
        save(model, f"{self.path}/{key}/{folder}")
        # Of two sessions that fit at a time, each lists its own; both fits are the same.
        entry = self.spark.createDataFrame([(folder,)], "folder string")
        entry.coalesce(1).write.mode("append").json(f"{self.path}/{key}/listed")
        return Kept(model, False, key)

    def forest(self, df: DataFrame, params: ForestParams = ForestParams(), relative_error: float = 0.001) -> Kept:
        """The whole pipeline, as ``train`` fits it."""
        settings = {"fit": "forest", **asdict(params), "relative_error": relative_error}
        columns = [c for c in TRAINING_COLUMNS if c in df.columns]
        return self.get(df, columns, settings, lambda rows: train(rows, params, relative_error))

    def labels(self, df: DataFrame) -> Kept:
        """The label indexer alone, for validation."""
        return self.get(df, CATEGORICAL, {"fit": "labels"}, fit_labels)
