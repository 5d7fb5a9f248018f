"""Delimited files with broken rows: what has the right shape is read, the rest is set aside with file and reason.

A plain read pads a short row with nulls and cuts a long one off without a word. Here every line is looked at as it came:
quoted parts are taken out, and what is left tells the number of fields and whether a quote is open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import token_to_null
from ..schema import APPLICATION_SCHEMA
from .files import typed

TOO_FEW = "too_few_fields"
TOO_MANY = "too_many_fields"
OPEN_QUOTE = "unclosed_quote"

# No line holds it, so that a line is one field of the reader below.
_NEVER = "\u0001"
_QUOTED = '"[^"]*+"'  # a doubled quote is the border of two quoted parts, which come to the same


@dataclass(frozen=True)
class Quarantined:
    """``good``: every column as text. ``rejects``: (file, line, n_fields, reason). ``lines``: all, with their outcome."""

    good: DataFrame
    rejects: DataFrame
    lines: DataFrame


def bare(line: Column) -> Column:
    """The line without its quoted parts; null stays null."""
    return F.regexp_replace(line, _QUOTED, "")


def field_count(line: Column, sep: str = ",") -> Column:
    """Fields of a line; separators inside quotes do not count."""
    left = bare(line)
    return F.floor((F.length(left) - F.length(F.replace(left, F.lit(sep), F.lit("")))) / len(sep) + 1).cast("int")


def fault(line: Column, n_columns: int, sep: str = ",") -> Column:
    """Why a line is no row of ``n_columns`` fields; null if it is one. An odd number of quotes is told first, as it hides
    how many fields were meant."""
    n = field_count(line, sep)
    return (
        F.when(F.contains(bare(line), F.lit('"')), OPEN_QUOTE).when(n < n_columns, TOO_FEW).when(n > n_columns, TOO_MANY)
    )


def _names(spark: SparkSession, path: str, sep: str) -> tuple[str, list[str]]:
    """The header line of a file, and its columns."""
    try:
        plain = spark.read.options(header=True, sep=_NEVER, quote="", inferSchema=False).csv(path).columns
        return plain[0] if plain else "", spark.read.options(header=True, sep=sep, escape='"').csv(path).columns
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no application file at {path}") from exc
        raise


def quarantine(spark: SparkSession, path: str, sep: str = ",") -> Quarantined:
    """Read headed delimited files, one row a line, and set aside the lines that are no rows.

    Every line but blank ones and the header of each file is either good or rejected. Quotes inside a quoted field are
    doubled. A file whose header differs from the first one's stops the job. One scan of the files per result that is used;
    write ``lines`` first where several are.
    """
    header, columns = _names(spark, path, sep)
    # The reader sees one column, named by the whole header line, and so compares that line in every file.
    one = T.StructType([T.StructField(header, T.StringType())])
    options = dict(header=True, sep=_NEVER, quote="", enforceSchema=False, columnPruning=False)
    read = spark.read.schema(one).options(**options).csv(path)
    line = F.col(f"`{header}`") if "`" not in header else read[header]
    named = read.select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
    lines = named.select(
        "file", "line", field_count(F.col("line"), sep).alias("n_fields"), fault(F.col("line"), len(columns), sep).alias("reason")
    )
    return Quarantined(rows_of(lines, columns, sep), lines.filter(F.col("reason").isNotNull()), lines)


def read_checked(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType = APPLICATION_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(applications under their declared types, broken lines). What a plain read would pad or cut off is among the latter;
    a value that does not convert is null among the former, and a matter of validation."""
    found = quarantine(spark, path, sep)
    return typed(found.good, schema), found.rejects


def rows_of(lines: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """The good ones of ``lines`` as rows of text, missing markers as null."""
    fields = F.from_csv("line", _ddl(columns), {"sep": sep, "escape": '"'})
    parsed = lines.filter(F.col("reason").isNull()).select(fields.alias("row"))
    return parsed.select(*[token_to_null(F.col("row")[c]).alias(c) for c in columns])


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
