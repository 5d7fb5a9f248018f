"""Scoring of applications as files of them arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.banding import ALERT_POLICY, BandPolicy
from ..plans.scoring import score
from ..plans.training import persisted
from ..schema import APPLICATION_SCHEMA


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = APPLICATION_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Applications from a landing folder; the trigger limit keeps a backlog from becoming one batch.

    A CSV file whose header differs from the schema stops the stream instead of being read into the wrong columns.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def score_stream(
    model: PipelineModel,
    applications: DataFrame,
    out: str,
    checkpoint: str,
    policy: BandPolicy = ALERT_POLICY,
    available_now: bool = True,
) -> StreamingQuery:
    """Start one query that reads the landing folder once and writes scored rows to ``out/scored`` and rejects to
    ``out/rejects``.

    No state is kept. Each batch has its own subfolder, which a repeated batch overwrites, so that each row appears
    exactly once across restarts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with persisted(batch) as rows:
            for part, name in zip(score(model, rows, policy), ("scored", "rejects")):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    writer = applications.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
