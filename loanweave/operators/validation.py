"""Checks of a table against the model contract, in one pass over its rows.

A row emits one item per fault it has plus one that counts the row itself; the items are tallied with map-side
partial aggregation, so only distinct (fault, column, value) combinations are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import is_bad_number, nan_to_null
from ..schema import CATEGORICAL, CONTRACT, IMPUTED, LABEL, NOT_A_FEATURE, NUMERIC

# The kinds of finding, and which of them make a table incompatible.
MISSING_COLUMN = "colonnes_manquantes"
EXTRA_COLUMN = "colonnes_ignorées"
BAD_NUMBER = "type_incompatible"
UNKNOWN_CATEGORY = "categorie_inconnue"
MISSING_VALUE = "valeur_manquante"
ERRORS = (MISSING_COLUMN, BAD_NUMBER, UNKNOWN_CATEGORY)

TALLY_SCHEMA = "kind string, column_name string, value string, n bigint"
REPORT_SCHEMA = "level string, kind string, column_name string, value string, allowed string, n bigint"
NEEDED = tuple(c for c in CONTRACT if c not in IMPUTED and c not in NOT_A_FEATURE)


@dataclass(frozen=True)
class ColumnCheck:
    """Findings from the schema alone."""

    missing: list[str]
    extra: list[str]


def check_columns(columns: Sequence[str], key: str | None = None) -> ColumnCheck:
    allowed = {*CONTRACT, LABEL, key}
    return ColumnCheck([c for c in CONTRACT if c not in columns], [c for c in columns if c not in allowed])


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text, NaN as missing."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return (nan_to_null(F.col(column)) if floating else F.col(column)).cast("string")


def is_bad(df: DataFrame, column: str) -> Column:
    """Present but not a number; never so in a column that is numeric by type."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return F.lit(False) if numeric else is_bad_number(F.col(column).cast("string"))


def nonnumeric_counts(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Values per column that are present but not numbers."""
    bad = df.agg(*[F.count(F.when(is_bad(df, c), 1)).alias(c) for c in columns])
    return bad.unpivot([], list(columns), "column_name", "n_bad")


def label_frame(spark: SparkSession, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column_name, idx, label): a label dictionary as a table."""
    rows = [(c, i, str(v)) for c, values in labels.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "column_name string, idx int, label string")


def unknown_categories(df: DataFrame, dictionary: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Values (with row counts) that the dictionary lacks, for the columns it knows. Missing values are not faults."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    tally = values.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    # Both sides are small by now: distinct values against learned labels.
    known = dictionary.select("column_name", F.col("label").alias("value"))
    return tally.join(known.select("column_name").distinct(), "column_name", "left_semi").join(
        known, ["column_name", "value"], "left_anti"
    )


def listed(values: Sequence[str]) -> Column:
    return F.lit(", ".join(sorted(map(str, values))))


def validate(df: DataFrame, labels: Mapping[str, Sequence[str]], key: str | None = None) -> DataFrame:
    """The findings as rows (level, kind, column_name, value, allowed, n), with one ``verdict`` row that carries the row
    count.

    ``allowed`` lists the known categories beside an unknown one, and the contract's columns beside a missing one.
    ``n`` counts rows, or is 1 for a finding about the schema. Every unknown value has its own row. A category column
    without learned labels is not checked.
    """
    columns = check_columns(df.columns, key)
    if columns.missing:
        return missing_columns_report(df.sparkSession, columns, df.agg(F.count("*").alias("n")))
    return report_of(fault_tally(df, labels), labels, columns)


def missing_columns_report(spark: SparkSession, columns: ColumnCheck, rows: DataFrame) -> DataFrame:
    """The findings about a table that lacks columns; ``rows`` has its row count as ``n``."""
    none = F.lit(None).cast("string")
    verdict = rows.select(
        F.lit("verdict").alias("level"), F.lit("incompatible").alias("kind"), none.alias("column_name"),
        none.alias("value"), none.alias("allowed"), "n",
    )
    found = [("error", MISSING_COLUMN, c, None, ", ".join(CONTRACT), 1) for c in columns.missing]
    return spark.createDataFrame(found, REPORT_SCHEMA).unionByName(verdict)


def fault_tally(df: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(kind, column_name, value, n): how often each fault occurs, and under the kind ``row`` how many rows there are.

    Tallies of parts of a table add up to the tally of the whole.
    """

    def item(kind: str, column: str | None, when, value=None):
        fields = F.struct(
            F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column_name"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
        )
        return F.when(when, fields)

    text = {c: as_text(df, c) for c in CONTRACT}
    items = [item("row", None, F.lit(True))]
    items += [item(BAD_NUMBER, c, is_bad(df, c)) for c in NUMERIC]
    items += [item(MISSING_VALUE, c, text[c].isNull()) for c in NEEDED]
    items += [
        item(UNKNOWN_CATEGORY, c, ~text[c].isin([str(v) for v in labels[c]]), text[c])
        for c in CATEGORICAL
        if labels.get(c)
    ]
    # Empty items are dropped after the explode, which compiles; array_compact would be interpreted row by row.
    return (
        df.select(F.explode(F.array(*items)).alias("item"))
        .filter(F.col("item").isNotNull())
        .groupBy("item.kind", "item.column_name", "item.value")
        .agg(F.count("*").alias("n"))
    )


def report_of(tally: DataFrame, labels: Mapping[str, Sequence[str]], columns: ColumnCheck) -> DataFrame:
    """The report that a tally of faults amounts to."""
    spark = tally.sparkSession
    # Findings and verdict come from one further tally of the few entries, so the rows are looked at once.
    kind, is_error, none, zero = F.col("kind"), F.col("kind").isin(*ERRORS), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    finding = F.struct(
        F.when(is_error, "error").otherwise("warning").alias("level"), "kind", "column_name", "value", "n",
        zero.alias("errors"),
    )
    share = F.struct(
        F.lit("verdict").alias("level"), none.alias("kind"), none.alias("column_name"), none.alias("value"),
        F.when(kind == "row", F.col("n")).otherwise(zero).alias("n"),
        F.when(is_error, F.col("n")).otherwise(zero).alias("errors"),
    )
    parts = tally.select(F.explode(F.when(kind == "row", F.array(share)).otherwise(F.array(finding, share))).alias("part"))
    # A table without rows has a verdict too.
    none_yet = spark.createDataFrame(
        [("verdict", None, None, None, 0, 0)],
        "level string, kind string, column_name string, value string, n bigint, errors bigint",
    )
    summed = (
        parts.select("part.*").unionByName(none_yet).groupBy("level", "kind", "column_name", "value")
        .agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    )
    known = [
        F.when((kind == UNKNOWN_CATEGORY) & (F.col("column_name") == c), listed(labels[c])) for c in CATEGORICAL if labels.get(c)
    ]
    verdict = F.when(F.col("errors") == 0, "compatible").otherwise("incompatible")
    report = summed.select(
        "level", F.when(F.col("level") == "verdict", verdict).otherwise(kind).alias("kind"), "column_name", "value",
        F.coalesce(none, *known).alias("allowed"), "n",
    )
    if columns.extra:
        extra = spark.createDataFrame([("warning", EXTRA_COLUMN, c, None, None, 1) for c in columns.extra], REPORT_SCHEMA)
        report = report.unionByName(extra)
    return report


def is_compatible(report: DataFrame) -> bool:
    return report.filter("level = 'verdict'").first()["kind"] == "compatible"
