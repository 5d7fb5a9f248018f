"""Coercion of text to numbers and one canonical form of a missing value (null, never NaN)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number. Guards the cast, which alone would accept Java suffixes such as '12d'.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Spellings a CSV reader should take for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def to_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not a number becomes null instead of failing the job."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def is_bad_number(text: Column) -> Column:
    """Present but not a number. Blank text counts: it is a value that does not convert."""
    return text.isNotNull() & to_number(text).isNull()


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def token_to_null(text: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    return F.when(~F.trim(text).isin(*tokens), text)
