"""Labels that say which partitions tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.model import TableRef
from tidemark.operators.ranges import ordinal
from tidemark.sources import catalog


def partition_labels(metadata: DataFrame) -> DataFrame:
    """(table_name, partition_min, partition_max, partition_skip) from (table_name, partition_id).

    `partition_skip` counts the places where partitions are missing.
    """
    at = ordinal(F.col("partition_id"))
    order = Window.partitionBy("table_name").orderBy(at.desc_nulls_first())
    gap = F.coalesce(F.abs(F.lag("_at").over(order) - F.col("_at")) > 1, F.lit(True))
    rows = metadata.select("table_name", "partition_id").distinct().withColumn("_at", at).withColumn("_gap", gap)
    skip = F.count_if("_gap") - 1
    return rows.groupBy("table_name").agg(F.min("partition_id").alias("partition_min"), F.max("partition_id").alias("partition_max"), skip.alias("partition_skip"))


def view_labels(labels: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Labels of views from those of the tables that they read: what all of them have.

    `dependencies` is (view_name, table_name).
    """
    both = dependencies.join(labels, "table_name")
    out = both.groupBy("view_name").agg(F.max("partition_min").alias("partition_min"), F.min("partition_max").alias("partition_max"), F.max("partition_skip").alias("partition_skip"))
    return out.select(F.col("view_name").alias("table_name"), "partition_min", "partition_max", "partition_skip")


def merged_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, key, value): new labels over old ones; keys that only the old have stay."""
    both = old.withColumnRenamed("value", "_old").join(new, ["table_name", "key"], "full")
    return both.select("table_name", "key", F.coalesce("value", "_old").alias("value"))


def update_labels(spark: SparkSession, database: str) -> dict[str, dict[str, str]]:
    """Label the tables of a database by their partitions, and its views by those of all tables that they read; the
    labels by table.

    What views read is taken from their definitions, through views on views; a table of another database counts with
    the partitions that it has there.  Labels are as many as tables; other labels of a table stay.
    """
    reads = catalog.dependencies(spark, database)
    metadata = catalog.partition_metadata(spark, database)
    others = {r["table_name"].split(".")[0] for r in reads.filter(F.col("table_name").contains(".") & ~F.col("table_name").contains("/")).select("table_name").distinct().collect()}
    for other in others:
        theirs = catalog.partition_metadata(spark, other).withColumn("table_name", F.concat(F.lit(f"{other}."), "table_name"))
        metadata = metadata.unionByName(theirs)
    found = partition_labels(metadata)
    found = found.filter(~F.col("table_name").contains(".")).unionByName(view_labels(found, reads))
    out, views = {}, set(catalog.views(spark, database))
    for r in found.collect():
        out[r["table_name"]] = {"partition-min": r["partition_min"], "partition-max": r["partition_max"], "partition-skip": str(r["partition_skip"])}
        catalog.set_labels(spark, TableRef(database, r["table_name"]), out[r["table_name"]], view=r["table_name"] in views)
    return out
