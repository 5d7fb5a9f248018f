"""ML vectors back to plain columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_element(vector: str | Column, index: int) -> Column:
    """Element of a vector; null for a missing or shorter vector."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.get(vector_to_array(column), F.lit(index))


def separate_vector(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Append one column per leading vector element."""
    values = vector_to_array(F.col(vector))
    return df.withColumns({name: F.get(values, F.lit(i)) for i, name in enumerate(names)})
