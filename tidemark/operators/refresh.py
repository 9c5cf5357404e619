"""Refresh of the stale partitions of a table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import NULL_PARTITION, RefreshOptions
from tidemark.operators.ranges import bounds, refresh_range, unit_of
from tidemark.operators.staleness import stale_partitions
from tidemark.plans.joblog import JobLog, noted
from tidemark.sources.published import Published


class SchemaChanged(Exception):
    """The query no longer gives the destination's columns."""


class NothingWritten(Exception):
    """A refresh that had something to do neither wrote nor deleted a row."""


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the range of partitions, and the rows now in it."""

    first: str
    last: str
    rows: int | None


def partition_id(column: Column, unit: str) -> Column:
    formats = {"hour": "yyyyMMddHH", "day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}
    return F.coalesce(F.date_format(column, formats[unit]), F.lit(NULL_PARTITION))


def in_range(id_column: Column, first: str, last: str) -> Column:
    return F.lit(True) if first == NULL_PARTITION else id_column.between(first, last)


def replace_range(target: DataFrame, fresh: DataFrame, id_column: Column, first: str, last: str) -> DataFrame:
    """`target` with the partitions of a range replaced by the rows of `fresh`, which must lie within it.

    A partition of the range without fresh rows ends up empty.
    """
    inside = F.coalesce(in_range(id_column, first, last), F.lit(False))
    problem = F.raise_error(F.concat(F.lit("row outside of the range: "), F.coalesce(id_column, F.lit("null"))))
    checked = fresh.filter(F.when(inside, True).otherwise(problem.cast("boolean")))
    return target.filter(~inside).unionByName(checked)


class TableMissing(Exception):
    """The destination is not there."""


def table_at(spark: SparkSession, path: str) -> Published:
    """The table that a refresh writes at `path`; its partitions are in `partition_id`."""
    return Published(spark, path, "partition_id")


def write_range(table: Published, fresh: DataFrame, first: str, last: str, anew: bool = False) -> tuple[int, int]:
    """Put `fresh` (with its ids in `partition_id`) in place of the partitions of a range; the rows written, and their bytes.

    The rows are written once, as folders of a new version, so a query may read the table itself; a partition of the
    range that has no rows any more is left out of the new version.  A row outside of the range is an error, and so is a
    range that has no row before or after.  With `anew`, no other partition stays.
    """
    inside = F.coalesce(in_range(F.col("partition_id").cast("string"), first, last), F.lit(False))
    old = table.version()
    draft = table.stage(fresh, outside=F.count_if(~inside))
    if draft.metrics["outside"]:
        raise ValueError(f"the query gave rows outside of {first} to {last}")
    within = lambda key: first == NULL_PARTITION or (key is not None and first <= key <= last)
    if not draft.metrics["rows"] and not any(within(f.key) for f in (old.folders if old else [])):
        raise NothingWritten(f"no row for {first} to {last}")
    table.publish(draft, None if anew else lambda key: not within(key))
    return draft.metrics["rows"], draft.version.bytes


def same_columns(stored: T.StructType, fresh: T.StructType) -> bool:
    shape = lambda schema: {f.name: f.dataType.simpleString() for f in schema if f.name != "partition_id"}
    return shape(stored) == shape(fresh)


def update_partitions(
    spark: SparkSession,
    path: str,
    metadata: DataFrame,
    destination: str,
    sources: list[str],
    alignments: DataFrame,
    query: str,
    id_of: Column,
    now: datetime,
    log: JobLog | None = None,
    **options: object,
) -> Refreshed | None:
    """Refresh the table at `path` where it is stale; None if nothing is.

    `query` is SQL that may use :begin and :end; `id_of` gives a row's partition id.  A table that is not there is an
    error, or (`replace_if_changed`) is made.  If the query gives other columns, that is an error, or the table begins
    anew with the refreshed range; the version before can still be read by its number.  With `log`, the run is noted.
    """
    chosen = RefreshOptions.of(options)
    stale = stale_partitions(metadata, destination, sources, alignments, now, chosen.tolerate_staleness, chosen.force_expired_at)
    span = refresh_range(stale, chosen.max_update_months, chosen.backfill_direction).first()
    if span is None or span["last"] is None:
        return None
    first, last = span["first"], span["last"]
    if chosen.dry_run:
        return Refreshed(first, last, None)
    unit_of(first)
    args = bounds(first, last)
    fresh = spark.sql(query, args={"begin": args[0], "end": args[1]} if args else {}).withColumn("partition_id", id_of)
    table = table_at(spark, path)
    stored = table.version()
    replace = chosen.auto_recreate == "replace_if_changed"
    if stored is None and not replace:
        raise TableMissing(path)
    changed = stored is not None and not same_columns(stored.columns, fresh.schema)
    if changed and not replace:
        raise SchemaChanged(f"{stored.columns.simpleString()} and {fresh.schema.simpleString()}")
    with noted(log, destination, fresh, query) as run:
        run.rows, run.bytes = write_range(table, fresh, first, last, anew=changed)
    return Refreshed(first, last, run.rows)
