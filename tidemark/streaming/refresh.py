"""Keeping derived tables up to date from a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators.scd2 import HistoryTable


def touched_partitions(batch: DataFrame, id_of: Column) -> list[str]:
    """The partitions that a micro-batch has rows of: a list as long as their number."""
    return sorted(r[0] for r in batch.select(id_of.alias("id")).distinct().collect() if r[0] is not None)


def refresh_on_arrival(stream: DataFrame, id_of: Column, refresh: Callable[[str, str], None], checkpoint: str) -> DataStreamWriter:
    """Call `refresh(first, last)` with the range of partitions that each micro-batch touches.

    A batch that is tried again refreshes the same range, which replaces its rows, so the table ends up the same.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        if ids := touched_partitions(batch, id_of):
            refresh(ids[0], ids[-1])

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def keep_history(stream: DataFrame, table: HistoryTable, key: str, at: str, checkpoint: str) -> DataStreamWriter:
    """Lay each micro-batch over a history as a partial snapshot: the latest row of each key wins, missing keys stay."""
    from tidemark.operators.scd2 import overlay, snapshot

    def on_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        if table.exists():
            table.update(overlay(table.current(), snapshot(newest, key, datetime.now(), "batch")), allow_unchanged=True)
        else:
            table.init(newest)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of an event stream by day and type, closed once the watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyyMMdd").alias("day"), "event_type", "n")


def run_to_end(writer: DataStreamWriter) -> StreamingQuery:
    """Run a stream over all that there is now, and wait."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
