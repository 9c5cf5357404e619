"""A profile of a partitioned table that is kept by increments.

Each partition of the table has one row of statistics and sketches.  A refresh profiles the partitions that have changed
and no others, replaces their rows, and drops those of partitions that are gone; the profile of the whole table is merged
from the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.sources.published import Published


@dataclass(frozen=True)
class StoredProfile:
    """The profile at `path` of a table whose partitions are in its column `partition`."""

    spark: SparkSession
    path: str
    partition: str
    columns: list[str] | None = None

    @property
    def table(self) -> Published:
        return Published(self.spark, self.path, "partition_key")

    def rows(self) -> DataFrame:
        """A row for each partition, with its sketches."""
        return self.table.read()

    def merged(self) -> DataFrame:
        """The profile of the whole table, in one row."""
        return profile.shown(profile.merge(self.rows()))

    def stale(self, metadata: DataFrame) -> tuple[list[str], list[str]]:
        """(partitions to profile, partitions that are gone), from (partition_id, last_modified) of the table."""
        ours = {f.key: f.last_modified for f in version.folders} if (version := self.table.version()) else {}
        theirs = {r["partition_id"]: r["last_modified"] for r in metadata.groupBy("partition_id").agg(F.max("last_modified").alias("last_modified")).collect()}
        return sorted(k for k, at in theirs.items() if k is not None and (k not in ours or ours[k] < at)), sorted(set(ours) - set(theirs))

    def of(self, source: DataFrame, keys: list[str]) -> DataFrame:
        """The profile of some partitions.  The filter is on the partition column, so a scan of `source` lists no others."""
        chosen = source.filter(F.col(self.partition).isin(keys))
        columns = self.columns or [n for n, _, _ in profile.leaf_columns(source.schema) if n != self.partition]
        return profile.profile(chosen, partition=F.col(self.partition), columns=columns, sketches=True).drop("group_keys")

    def refresh(self, source: DataFrame, metadata: DataFrame) -> list[str]:
        """Bring the profile up to date with a table; the partitions that were profiled."""
        changed, gone = self.stale(metadata)
        if changed or gone:
            left = {*changed, *gone}
            self.table.publish(self.table.stage(self.of(source, changed)), keep=lambda key: key not in left)
        return changed
