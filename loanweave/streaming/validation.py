"""Validation of applications as files of them arrive: fault tallies per batch, merged into one report when asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import TALLY_SCHEMA, check_columns, fault_tally, missing_columns_report, report_of
from ..schema import KEY

Labels = Mapping[str, Sequence[str]]


def tally_stream(
    applications: DataFrame, labels: Labels, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the faults of each batch, with their counts, to ``out``.

    A batch is a folder of its own, which a repeated batch overwrites: after a restart no row is counted twice or missed.
    The folder holds one entry per distinct fault, however many rows the batch had.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fault_tally(batch, labels).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    if check_columns(applications.columns).missing:
        raise ValueError(f"the stream lacks {check_columns(applications.columns).missing}")
    writer = applications.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def merged_report(spark: SparkSession, out: str, labels: Labels, columns: Sequence[str], key: str = KEY) -> DataFrame:
    """The report over all batches so far, as ``validate`` gives it for one table with these ``columns``."""
    check = check_columns(columns, key)
    tallies = spark.read.schema(f"{TALLY_SCHEMA}, batch bigint").parquet(out)
    summed = tallies.groupBy("kind", "column_name", "value").agg(F.sum("n").alias("n"))
    if check.missing:
        rows = F.coalesce(F.sum(F.when(F.col("kind") == "row", F.col("n"))), F.lit(0)).cast("bigint")
        return missing_columns_report(spark, check, summed.agg(rows.alias("n")))
    return report_of(summed, labels, check)
