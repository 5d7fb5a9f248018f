"""Validation and scoring in one read of the input.

Every row is scored or rejected, and written once together with its faults, a bit each. The report comes from that narrow
column of the committed files, so that a task which was run again counts once, and decides whether what was written is given
out. The text of unknown categories is looked up among the rejected rows.

(``Observation`` would gather the counters during the write, but once a session has used one, fitted forests, which hold
their session, can no longer be sent to its executors.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.banding import ALERT_POLICY, BandPolicy, decision, risk_band
from ..functions.vectors import vector_element
from ..operators.validation import (
    BAD_NUMBER,
    EXTRA_COLUMN,
    MISSING_VALUE,
    NEEDED,
    REPORT_SCHEMA,
    UNKNOWN_CATEGORY,
    as_text,
    check_columns,
    is_bad,
    listed,
    validate,
)
from ..schema import CATEGORICAL, KEY, NOT_A_FEATURE, NUMERIC
from ..session import scratch_path
from .features import label_dictionary
from .scoring import Labels, is_scorable, prepare, reasons

SCORED, REJECTED = "scored", "rejected"
FAULTS = "_faults"
ANSWER = ("prediction", "probability_default", "risk_level", "decision")


@dataclass(frozen=True)
class Gated:
    """``report`` as ``validate`` gives it; ``scored`` and ``rejects`` are None when the table is incompatible."""

    report: DataFrame
    scored: DataFrame | None
    rejects: DataFrame | None

    @property
    def compatible(self) -> bool:
        return self.scored is not None


def answered(model: PipelineModel, df: DataFrame, policy: BandPolicy = ALERT_POLICY) -> DataFrame:
    """Every input row with ``outcome``, the answer of the model and the ``reasons`` of a rejection, in one plan.

    The model cannot take a row that is not scorable, so it is shown a harmless one in its place, whose answer is dropped.
    """
    labels = label_dictionary(model)
    flagged = df.withColumn("_good", is_scorable(df, labels))
    good = F.col("_good")
    shown: dict[str, Column] = {c: F.when(good, F.col(c)).otherwise(F.lit(labels[c][0])) for c in CATEGORICAL if c in labels}
    kinds = prepare(df).schema
    shown |= {c: F.when(good, F.col(c)).otherwise(F.lit(0).cast(kinds[c].dataType)) for c in NUMERIC if c not in NOT_A_FEATURE}
    kept = [F.col(c).alias(f"_in_{c}") for c in df.columns]
    inputs = prepare(flagged.select(*kept, *df.columns, "_good")).withColumns(shown)
    predicted = model.transform(inputs)
    only = lambda column: F.when(good, column)
    raw = predicted.select(
        *[F.col(f"_in_{c}").alias(c) for c in df.columns],
        "_good",
        only(F.col("prediction").cast("int")).alias("prediction"),
        only(vector_element("probability", 1)).alias("probability_default"),
    )
    return raw.select(
        *df.columns,
        "prediction",
        "probability_default",
        only(risk_band(F.col("probability_default"), policy)).alias("risk_level"),
        only(decision(F.col("prediction"))).alias("decision"),
        F.when(~good, reasons(raw.select(*df.columns), labels)).alias("reasons"),
        F.when(good, SCORED).otherwise(REJECTED).alias("outcome"),
    )


def _faults(df: DataFrame, labels: Labels) -> dict[tuple[str, str], Column]:
    """(kind, column) -> whether a row has the fault; missing if it cannot be told."""
    found = {(BAD_NUMBER, c): is_bad(df, c) for c in NUMERIC}
    found |= {(MISSING_VALUE, c): as_text(df, c).isNull() for c in NEEDED}
    found |= {(UNKNOWN_CATEGORY, c): ~as_text(df, c).isin([str(v) for v in labels[c]]) for c in CATEGORICAL if labels.get(c)}
    return found


def _bits(faults: dict[tuple[str, str], Column]) -> Column:
    """The faults of a row, the i-th as bit i."""
    bits = [F.when(fault, F.lit(1 << i)).otherwise(F.lit(0)) for i, fault in enumerate(faults.values())]
    return sum(bits[1:], bits[0]).cast("int")


def gate_and_score(
    model: PipelineModel, df: DataFrame, key: str = KEY, policy: BandPolicy = ALERT_POLICY, path: str | None = None
) -> Gated:
    """Score a table and give the result out if the table is compatible with the model.

    All rows go to ``path`` (by default a new folder beside the checkpoints), by outcome; a table that turns out to be
    incompatible stays there, but is not given out.
    """
    spark, labels = df.sparkSession, label_dictionary(model)
    columns = check_columns(df.columns, key)
    if columns.missing:
        return Gated(validate(df, labels, key), None, None)
    kinds = _faults(df, labels)
    found = answered(model, df, policy)
    found = found.withColumn(FAULTS, _bits(_faults(found.select(*df.columns), labels)))
    path = path or scratch_path(spark, "gated")
    found.write.mode("errorifexists").partitionBy("outcome").parquet(path)
    everything = spark.read.schema(found.schema).parquet(path)
    rejects = everything.filter(F.col("outcome") == REJECTED).select(*df.columns, "reasons")

    has = [F.count(F.when(F.col(FAULTS).bitwiseAND(1 << i) != 0, 1)).alias(f"n{i}") for i in range(len(kinds))]
    n_rows, *counts = everything.agg(F.count("*").alias("n"), *has).first()
    faults = {at: n for at, n in zip(kinds, counts) if n}
    rows = [("error", BAD_NUMBER, c, None, None, n) for (kind, c), n in faults.items() if kind == BAD_NUMBER]
    rows += [("warning", MISSING_VALUE, c, None, None, n) for (kind, c), n in faults.items() if kind == MISSING_VALUE]
    rows += [("warning", EXTRA_COLUMN, c, None, None, 1) for c in columns.extra]
    unknown = [c for kind, c in faults if kind == UNKNOWN_CATEGORY]
    bad = bool(unknown) or any(kind == BAD_NUMBER for kind, _ in faults)
    rows.append(("verdict", "incompatible" if bad else "compatible", None, None, None, n_rows))
    report = spark.createDataFrame(rows, REPORT_SCHEMA)
    if unknown:
        report = report.unionByName(_unknown_values(rejects, labels, unknown))
    if bad:
        return Gated(report, None, None)
    scored = prepare(everything.filter(F.col("outcome") == SCORED).select(*df.columns, *ANSWER))
    return Gated(report, scored, rejects)


def _unknown_values(rejects: DataFrame, labels: Labels, columns: list[str]) -> DataFrame:
    """A row per unknown value; every one of them made its row a reject."""
    values = rejects.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    known = [(F.col("column_name") == c) & F.col("value").isin([str(v) for v in labels[c]]) for c in columns]
    is_known = known[0]
    for other in known[1:]:
        is_known = is_known | other
    tally = values.filter(F.col("value").isNotNull() & ~is_known).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    allowed = F.coalesce(*[F.when(F.col("column_name") == c, listed(labels[c])) for c in columns])
    return tally.select(
        F.lit("error").alias("level"), F.lit(UNKNOWN_CATEGORY).alias("kind"), "column_name", "value", allowed.alias("allowed"), "n"
    )
