"""Gaps between partitions, and the range that one refresh covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import NULL_PARTITION

#: Length of a partition id, its unit, its format and the format of bounds.
UNITS = {10: ("hour", "yyyyMMddHH", "yyyy-MM-dd HH:mm:ss"), 8: ("day", "yyyyMMdd", "yyyy-MM-dd"), 6: ("month", "yyyyMM", "yyyy-MM-dd"), 4: ("year", "yyyy", "yyyy-MM-dd")}


def unit_of(partition_id: str) -> str:
    if partition_id == NULL_PARTITION:
        return "none"
    if len(partition_id) not in UNITS or not partition_id.isdigit():
        raise ValueError(f"not a partition id: {partition_id}")
    return UNITS[len(partition_id)][0]


def instant_of(partition_id: Column) -> Column:
    """The start of a partition; null where the id is no time."""
    by_length = [F.when(F.length(partition_id) == n, F.try_to_timestamp(partition_id, F.lit(f))) for n, (_, f, _) in UNITS.items()]
    return F.coalesce(*by_length)


def ordinal(partition_id: Column) -> Column:
    """Partitions of one unit counted without gaps, so that neighbours differ by 1."""
    at = instant_of(partition_id)
    months = F.year(at) * 12 + F.month(at)
    return (
        F.when(F.length(partition_id) == 10, F.floor(F.unix_timestamp(at) / 3600))
        .when(F.length(partition_id) == 8, F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long"))
        .when(F.length(partition_id) == 6, months.cast("long"))
        .when(F.length(partition_id) == 4, F.year(at).cast("long"))
    )


def gaps(partitions: DataFrame, direction: str = "backward") -> DataFrame:
    """`partitions` (partition_id) with `has_gap`: the neighbour on the side where the run starts is not adjacent.

    The list of a table's partitions is small beside its rows, so it is ordered as one.
    """
    at = F.col("_at")
    order = Window.orderBy(at.desc_nulls_first() if direction == "backward" else at.asc_nulls_first())
    far = F.abs(F.lag(at).over(order) - at) > 1
    return partitions.withColumn("_at", ordinal(F.col("partition_id"))).withColumn("has_gap", F.coalesce(far, F.lit(True))).drop("_at")


def contiguous_run(partitions: DataFrame, direction: str = "backward") -> DataFrame:
    """The newest (or, forward, the oldest) run of adjacent partitions."""
    at = ordinal(F.col("partition_id"))
    order = Window.orderBy(at.desc_nulls_first() if direction == "backward" else at.asc_nulls_first())
    run = F.sum(F.col("has_gap").cast("int")).over(order)
    return gaps(partitions, direction).withColumn("_run", run).filter("_run = 1").select("partition_id")


def refresh_range(partitions: DataFrame, max_months: int = 1, direction: str = "backward") -> DataFrame:
    """(first, last): the run's partitions that one refresh may cover, at most `max_months` from its starting end."""
    run = contiguous_run(partitions, direction).withColumn("_at", instant_of(F.col("partition_id")))
    ends = run.agg(F.min("partition_id").alias("low"), F.max("partition_id").alias("high"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    fmt = lambda c, like: F.coalesce(*[F.when(F.length(like) == n, F.date_format(c, f)) for n, (_, f, _) in UNITS.items()])
    if direction == "backward":
        limit = fmt(F.add_months("_high", -max_months).cast("timestamp"), F.col("high"))
        return ends.select(F.when(limit.isNull(), F.col("low")).otherwise(F.greatest("low", limit)).alias("first"), F.col("high").alias("last"))
    limit = fmt(F.add_months("_low", max_months).cast("timestamp"), F.col("low"))
    return ends.select(F.col("low").alias("first"), F.when(limit.isNull(), F.col("high")).otherwise(F.least("high", limit)).alias("last"))


def bounds(first: str, last: str) -> tuple[str, str] | None:
    """Partition ids as the literals that a query's :begin and :end take; None for an unpartitioned table."""
    from datetime import datetime

    if unit_of(first) == "none":
        return None
    if unit_of(first) != unit_of(last):
        raise ValueError("both ends of a range have one unit")
    known = {"hour": ("%Y%m%d%H", "%Y-%m-%d %H:%M:%S"), "day": ("%Y%m%d", "%Y-%m-%d"), "month": ("%Y%m", "%Y-%m-%d"), "year": ("%Y", "%Y-%m-%d")}
    read, write = known[unit_of(first)]
    return tuple(datetime.strptime(p, read).strftime(write) for p in (first, last))
