"""Assertions on columns: each gives its value back, or fails the query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("null"))


def _fail(value: Column, why: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{why}: "), _text(value)))


def sure_eq(actual: Column, expected: Column, message: str = "") -> Column:
    """`actual`, if it equals `expected` or both are null."""
    why = F.concat(F.lit(f"{message}: expected "), _text(expected), F.lit(" but actual is "), _text(actual))
    return F.when(actual.eqNullSafe(expected), actual).otherwise(F.raise_error(why))


def sure_like(value: Column, pattern: str) -> Column:
    """The value, if it is like the pattern, or null."""
    return F.when(F.coalesce(value.like(pattern), F.lit(True)), value).otherwise(_fail(value, f"not like {pattern}"))


def sure_nonnull(value: Column) -> Column:
    return F.when(value.isNotNull(), value).otherwise(_fail(value, "null"))


def sure_range(value: Column, low: object = None, high: object = None) -> Column:
    """The value, if it is within the bounds that are given, or null."""
    inside = F.lit(True)
    inside = inside & (value >= low) if low is not None else inside
    inside = inside & (value <= high) if high is not None else inside
    return F.when(F.coalesce(inside, F.lit(True)), value).otherwise(_fail(value, f"not from {low} to {high}"))


def sure_values(value: Column, accepted: list) -> Column:
    """The value, if it is one of some, or null."""
    return F.when(F.coalesce(value.isin(accepted), F.lit(True)), value).otherwise(_fail(value, f"not of {accepted}"))
