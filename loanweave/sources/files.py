"""Reading applications from delimited files or local rows, and exporting results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import blank_to_null, nan_to_null, to_number, token_to_null
from ..operators.filters import drop_outliers
from ..schema import APPLICATION_SCHEMA, CATEGORICAL, KEY


WHOLE = "^[+-]?[0-9]+$"


def read_text(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Headed delimited files with every column as text and missing markers as null. No inference pass over the data.

    Quotes inside a quoted field are doubled; ``multiline`` allows line breaks in it. A file whose header differs from
    the first one's stops the job instead of being read into the wrong columns.
    """
    options = dict(header=True, inferSchema=False, sep=sep, escape='"', multiLine=multiline)
    try:
        columns = spark.read.options(**options).csv(path).columns
        declared = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        text = spark.read.schema(declared).options(**options, enforceSchema=False).csv(path)
        return text.select(*[token_to_null(F.col(f"`{c}`")).alias(c) for c in columns])
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no application file at {path}") from exc
        raise


def typed(df: DataFrame, schema: T.StructType = APPLICATION_SCHEMA) -> DataFrame:
    """Known columns to their declared types; text that does not convert becomes null; other columns pass through."""
    declared = {field.name: field.dataType for field in schema}
    current = {field.name: field.dataType for field in df.schema}

    def cast(name: str):
        column, target = F.col(f"`{name}`"), declared.get(name)
        if target is None:
            return column
        if isinstance(target, T.StringType):
            return blank_to_null(column.cast("string")).alias(name)
        if isinstance(target, T.LongType):
            # Keys go straight to BIGINT: a detour through DOUBLE would merge keys above 2**53.
            return column.try_cast("bigint").alias(name)
        number = to_number(column) if isinstance(current[name], T.StringType) else column.cast("double")
        number = nan_to_null(number)
        if isinstance(target, T.IntegerType):
            # A fraction is no whole number: null, like other text that does not convert, rather than cut off.
            number = F.when(number == F.floor(number), number)
        return (number if isinstance(target, T.DoubleType) else number.try_cast(target)).alias(name)

    return df.select(*[cast(name) for name in df.columns])


def inferred(df: DataFrame) -> DataFrame:
    """Text columns to INT, BIGINT or DOUBLE where every value present converts, found in one aggregation."""
    whole = lambda kind: lambda c: F.when(F.trim(c).rlike(WHOLE), F.trim(c).try_cast(kind))
    kinds = {"int": whole("int"), "bigint": whole("bigint"), "double": to_number}
    fails = [
        F.count(F.when(F.col(f"`{c}`").isNotNull() & to(F.col(f"`{c}`")).isNull(), 1)).alias(f"{kind}:{c}")
        for c in df.columns
        for kind, to in kinds.items()
    ]
    found = df.agg(*fails, *[F.count(F.col(f"`{c}`")).alias(f"n:{c}") for c in df.columns]).first()

    def cast(c: str):
        kind = next((k for k in kinds if found[f"n:{c}"] and not found[f"{k}:{c}"]), None)
        return (kinds[kind](F.col(f"`{c}`")) if kind else F.col(f"`{c}`")).alias(c)

    return df.select(*[cast(c) for c in df.columns])


def read_applications(spark: SparkSession, path: str, sep: str = ",", infer: bool = False, name: str | None = None):
    """Applications from a headed delimited file, optionally registered as a view.

    Declared types by default; ``infer=True`` takes them from the values instead (whole number, number or text, missing
    markers left out), at the price of one more pass over the file.
    """
    text = read_text(spark, path, sep)
    if infer:
        df = inferred(text)
    else:
        df = typed(text)
    if name:
        df.createOrReplaceTempView(name)
    return df


def load_portfolio(spark: SparkSession, path: str) -> DataFrame:
    """The table behind the dashboard: applications without implausible ages and careers."""
    return drop_outliers(read_applications(spark, path))


def from_rows(spark: SparkSession, rows: Iterable, columns: Iterable[str] | None = None) -> DataFrame:
    """A handful of applications from the caller, under the declared types. Large inputs come from files."""
    names = list(columns) if columns is not None else [c for c in APPLICATION_SCHEMA.fieldNames() if c != KEY]
    return spark.createDataFrame(list(rows), T.StructType([APPLICATION_SCHEMA[c] for c in names]))


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Headed CSV part files, written by the executors."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)
    return path


def normalise(df: DataFrame) -> DataFrame:
    """NaN in floating columns and blank categories to null."""
    floating = {f.name: nan_to_null(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    blanks = {c: blank_to_null(F.col(c)) for c in CATEGORICAL if c in df.columns}
    return df.withColumns({**floating, **blanks})
