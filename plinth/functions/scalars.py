"""Column expressions for table scalars and their canonical JSON text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of numbers and dates.
NUMBER_PATTERN = r"^[-+]?(?:0|[1-9]\d*)(?:[.,]\d+)?$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ].*)?$"
PERCENT_PATTERN = "percent|percentage|процент|доля|%"


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def squeeze(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"(?U)\s+", " "))


def value_type(raw: Column) -> Column:
    """null / bool / number / text, decided on the stripped text."""
    text = strip(raw)
    return (
        F.when(text.isNull() | (text == ""), F.lit("null"))
        .when(F.lower(text).isin("true", "false"), F.lit("bool"))
        .when(text.rlike(NUMBER_PATTERN), F.lit("number"))
        .otherwise(F.lit("text"))
    )


def number_value(raw: Column) -> Column:
    return F.replace(strip(raw), F.lit(","), F.lit(".")).try_cast("double")


def json_string(text: Column) -> Column:
    """A JSON string literal that keeps non-ASCII characters as they are."""
    escaped = F.to_json(F.array(text))
    literal = F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    # Control characters whose escape holds a letter are written in lower case.
    codes = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
    return reduce(
        lambda value, code: F.replace(value, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}")),
        codes,
        literal,
    )


def canonical_number(raw: Column) -> Column:
    """Shortest text of a parsed number: no plus sign, decimal point, no trailing zeros."""
    text = F.regexp_replace(F.replace(strip(raw), F.lit(","), F.lit(".")), r"^\+", "")
    trimmed = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    with_digit = F.regexp_replace(trimmed, r"\.$", ".0")
    return F.when(with_digit == "-0", F.lit("0")).otherwise(with_digit)


def json_scalar(raw: Column) -> Column:
    kind = value_type(raw)
    return (
        F.when(kind == "null", F.lit("null"))
        .when(kind == "bool", F.lower(strip(raw)))
        .when(kind == "number", canonical_number(raw))
        .otherwise(json_string(strip(raw)))
    )


def has_percent(column: Column) -> Column:
    return F.lower(column).rlike(PERCENT_PATTERN)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column that is used several times, or inside a function of array elements, is otherwise computed at each use and for
    each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
