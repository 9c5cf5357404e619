"""Which destination partitions are older than their sources."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import ANY_PARTITION, INFORMATION_SCHEMA, NULL_PARTITION


def pseudo_partitions(metadata: DataFrame, alignments: DataFrame) -> DataFrame:
    """`metadata` (table_name, partition_id, last_modified) under each partition name that an alignment may use.

    An unpartitioned table (null id) stands for every partition that an alignment names; a family's member answers to no
    partition too.
    """
    named = alignments.select(F.explode(F.concat(F.array("destination"), "sources")).alias("id")).distinct()
    named = named.filter(~F.col("id").isin(NULL_PARTITION, ANY_PARTITION)).agg(F.collect_list("id").alias("named"))
    both = F.array(F.lit(NULL_PARTITION), F.lit(ANY_PARTITION))
    ids = (
        F.when(F.col("table_name").endswith("*"), F.concat(both, F.array("partition_id")))
        .when(F.col("partition_id").isNull(), F.concat(both, "named"))
        .when(F.col("partition_id") == NULL_PARTITION, both)
        .otherwise(F.array(F.lit(ANY_PARTITION), F.col("partition_id")))
    )
    # `named` is one row.
    return metadata.join(F.broadcast(named)).withColumn("partition_id", F.explode(ids)).drop("named")


def with_families(metadata: DataFrame, tables: list[str]) -> DataFrame:
    """`metadata` with the tables of each family `<prefix>*` of `tables` as its partitions.

    A member's partition is what its name has after the prefix, whatever partitions it has of its own.
    """
    out = metadata
    for family in (t for t in tables if t.endswith("*")):
        members = metadata.filter(F.col("table_name").startswith(family[:-1]))
        suffix = F.substr("table_name", F.lit(len(family)))
        of = members.groupBy("table_name").agg(F.max("last_modified").alias("last_modified")).select(F.lit(family).alias("table_name"), suffix.alias("suffix"), "last_modified")
        out = out.unionByName(of.select("table_name", F.col("suffix").alias("partition_id"), "last_modified"))
    return out


def stale_partitions(
    metadata: DataFrame,
    destination: str,
    sources: list[str],
    alignments: DataFrame,
    now: datetime,
    tolerate: timedelta = timedelta(minutes=30),
    force_expired_at: datetime | None = None,
    strict_rows: bool = False,
) -> DataFrame:
    """(partition_id) of the stale destination partitions.

    A partition is judged once all its sources are there: each named source partition in each source table; with
    `strict_rows`, rows are counted in place of partitions.  It is stale if it is missing, was modified at or before
    `force_expired_at`, is behind a source by `tolerate`, or is not ahead of a source and older than `tolerate`.
    A table `<prefix>*` is the family of those that begin so, with the rest of their names as partitions.
    Where the sources say nothing (none are given, or a row is missing) the answer is stale.
    """
    real = [s for s in sources if INFORMATION_SCHEMA not in s]
    expanded = pseudo_partitions(with_families(metadata, [destination, *real]), alignments)
    wanted = alignments.select(F.col("destination").alias("partition_id"), F.size("sources").alias("n_sources"), F.explode("sources").alias("source_id"))
    ours = expanded.filter(F.col("table_name") == destination).select("partition_id", F.col("last_modified").alias("own"))
    theirs = expanded.filter(F.col("table_name").isin(real)).select(F.col("partition_id").alias("source_id"), F.col("table_name").alias("source"), F.col("last_modified").alias("theirs"))
    rows = wanted.join(ours, "partition_id", "left").join(theirs, "source_id", "left")
    same = Window.partitionBy("partition_id")
    if strict_rows:
        seen = F.count("source").over(same)
    else:
        seen = F.size(F.collect_set(F.when(F.col("source").isNotNull(), F.struct("source", "source_id"))).over(same))
    ready = F.lit(len(real)) * F.col("n_sources") == seen
    instant = lambda t: F.lit(t).cast("timestamp")
    own, their = F.col("own").cast("timestamp"), F.col("theirs").cast("timestamp")
    late = F.expr(f"interval '{tolerate.total_seconds():.6f}' second")
    forced = F.coalesce(own <= instant(force_expired_at), F.lit(False)) if force_expired_at else F.lit(False)
    behind = own.isNull() | forced | (their - own >= late) | ((their >= own) & (instant(now) - own >= late))
    stale = F.coalesce(ready, F.lit(True)) & F.coalesce(behind, F.lit(True))
    return rows.withColumn("stale", stale).filter("stale").select("partition_id").distinct()


def detect_staleness(*args: object, **options: object) -> list[str] | None:
    """The stale ids in order, or None; one per destination partition, which the caller named."""
    ids = [r[0] for r in stale_partitions(*args, **options).orderBy("partition_id").collect()]
    return ids or None
