"""Alignments: which source partitions feed which destination partition.

Each takes a table of spans (`first`, `last`: dates, both included) and gives (destination, sources).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _days(spans: DataFrame) -> DataFrame:
    return spans.select(F.explode(F.sequence("first", "last")).alias("day"))


def day_id(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def day_to_day(spans: DataFrame) -> DataFrame:
    """Each day from itself."""
    return _days(spans).select(day_id(F.col("day")).alias("destination"), F.array(day_id(F.col("day"))).alias("sources"))


def day_to_day_padded(spans: DataFrame, days: int = 1) -> DataFrame:
    """Each day from itself and its neighbours, for sources in another time zone."""
    around = [day_id(F.date_add("day", k)) for k in range(-days, days + 1)]
    return _days(spans).select(day_id(F.col("day")).alias("destination"), F.array(*around).alias("sources"))


def day_to_week(spans: DataFrame) -> DataFrame:
    """Each week, named by its Sunday, from its days within the span."""
    sunday = day_id(F.date_sub("day", F.dayofweek("day") - 1))
    return _days(spans).groupBy(sunday.alias("destination")).agg(F.array_sort(F.collect_set(day_id(F.col("day")))).alias("sources"))
