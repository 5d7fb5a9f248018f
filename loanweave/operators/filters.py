"""Row filters. Each builds one predicate, so that Catalyst can push it below joins and into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    """A set of filters that must all hold.

    ``members``: column -> allowed values (missing values never match, and an empty list matches nothing).
    ``ranges``: column -> inclusive bounds.
    ``equals``: column -> value compared as text; ``None`` means "all", and a column the table lacks is ignored.
    """

    members: Mapping[str, Sequence] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)
    equals: Mapping[str, str | None] = field(default_factory=dict)


def _conjunction(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def predicate(columns: Sequence[str], spec: FilterSpec) -> Column:
    """The filter set as one expression; Catalyst turns a long list of values into a set."""
    return _conjunction(
        [F.col(c).isin(list(values)) for c, values in spec.members.items()]
        + [F.col(c).between(low, high) for c, (low, high) in spec.ranges.items()]
        + [F.col(c).cast("string") == v for c, v in spec.equals.items() if v is not None and c in columns]
    )


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.filter(predicate(df.columns, spec))


def keep_members(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is among those of a one-column table, for lists too long to be part of a plan."""
    values = allowed.select(F.col(allowed.columns[0]).cast(df.schema[column].dataType).alias(column))
    return df.join(values, column, "left_semi").select(*df.columns)


def drop_outliers(df: DataFrame, max_age: float = 100, max_emp_length: float = 50) -> DataFrame:
    """Keep plausible ages and career lengths; a missing value in either drops the row."""
    return df.filter((F.col("person_age") <= max_age) & (F.col("person_emp_length") <= max_emp_length))
