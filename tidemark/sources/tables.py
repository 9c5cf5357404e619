"""Tables as sources: Parquet, date-sharded families, and their partition metadata."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names, or else below its warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tidemark/{uuid.uuid4().hex}"


def shards(spark: SparkSession, folder: str, prefix: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """All tables `<prefix>YYYYMMDD` of a folder as one, with their date in `table_suffix`.

    With both ends of a range, only folders of its months are listed; the days are a filter on the file's path.
    """
    names = f"{prefix}*"
    if first is not None and last is not None and first <= last:
        (y, m), (to_y, to_m) = ((int(d[:4]), int(d[4:6])) for d in (first, last))
        months = [f"{i // 12}{i % 12 + 1:02d}" for i in range(y * 12 + m - 1, to_y * 12 + to_m)]
        names = f"{prefix}{{{','.join(months)}}}*"
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{names}")
    df = df.withColumn("table_suffix", F.regexp_extract(F.col("_metadata.file_path"), prefix + r"(\d{8})", 1))
    if first is not None:
        df = df.filter(F.col("table_suffix") >= first)
    return df if last is None else df.filter(F.col("table_suffix") <= last)


def file_metadata(spark: SparkSession, path: str, table_name: str, partition_column: str | None = None) -> DataFrame:
    """(table_name, partition_id, last_modified) of a Parquet table, by its files' times.  Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("modificationTime").alias("at"))
    found = F.url_decode(F.regexp_extract("path", f"/{partition_column}=([^/]*)/", 1))
    part = F.when(found != "__HIVE_DEFAULT_PARTITION__", found) if partition_column else F.lit(None).cast("string")
    return files.groupBy(part.alias("partition_id")).agg(F.max("at").alias("last_modified")).select(F.lit(table_name).alias("table_name"), "partition_id", "last_modified")


def data_metadata(df: DataFrame, table_name: str, partition_id: Column, at: Column) -> DataFrame:
    """(table_name, partition_id, last_modified) of a table whose rows carry their own time of arrival."""
    return df.groupBy(partition_id.alias("partition_id")).agg(F.max(at).alias("last_modified")).select(F.lit(table_name).alias("table_name"), "partition_id", "last_modified")


def row_counts(spark: SparkSession, path: str, partition_column: str | None = None) -> DataFrame:
    """(partition_id, n_rows) of a Parquet table, from the footers of its files: the source counts, and no row is read.

    A session of its own has the settings that this needs; it gives back a row for each partition.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = _pushed_counts(own, path, partition_column).collect()
    return spark.createDataFrame([(str(r["p"]) if r["p"] is not None else None, r["n"]) for r in counts], "partition_id string, n_rows long")


def _pushed_counts(session: SparkSession, path: str, partition_column: str | None) -> DataFrame:
    # Partitions are counted by what their folders say, as it stands.
    session.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    table = session.read.parquet(path)
    if partition_column:
        return table.groupBy(F.col(partition_column).alias("p")).agg(F.count("*").alias("n"))
    return table.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("p"), "n")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, size) of the Parquet files below a place, which are listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"))


def storage_profile(spark: SparkSession, path: str, table_name: str, partition_column: str | None = None) -> DataFrame:
    """(table_name, partition_id, n_rows, n_files, n_bytes, first_modified, last_modified) of each partition.

    Names that end in a date are shown as their family.  Rows are counted from footers, files are listed.
    """
    found = F.url_decode(F.regexp_extract("path", f"/{partition_column}=([^/]*)/", 1))
    part = F.when(found != "__HIVE_DEFAULT_PARTITION__", found) if partition_column else F.lit(None).cast("string")
    totals = listed(spark, path).groupBy(part.alias("partition_id")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.min("at").alias("first_modified"), F.max("at").alias("last_modified"))
    counts = row_counts(spark, path, partition_column).withColumnRenamed("partition_id", "_p")
    both = totals.join(counts, F.col("partition_id").eqNullSafe(F.col("_p")), "left")
    name = F.regexp_replace(F.lit(table_name), r"\d{8}$", "*")
    return both.select(name.alias("table_name"), "partition_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_files", "n_bytes", "first_modified", "last_modified")


#: Days after its last change until a partition counts as kept for long.
ACTIVE_DAYS = 90


def dataset_profile(profiles: DataFrame, now: datetime, days: int = 365, active_days: int = ACTIVE_DAYS) -> DataFrame:
    """Rows of `storage_profile` with `creation_delay`, the time from a partition's day to its last change, and
    `storage_tier`: ACTIVE, or LONG_TERM where nothing has changed for `active_days`.

    Partitions whose name is a date that is more than so many days old are left out.
    """
    day = F.try_to_timestamp(F.when(F.col("partition_id").rlike(r"^\d{8}$"), F.col("partition_id")), F.lit("yyyyMMdd"))
    at = F.lit(now).cast("timestamp")
    recent = F.coalesce(day > at - F.expr(f"interval {days} days"), F.lit(True))
    tier = F.when(F.col("last_modified") > at - F.expr(f"interval {active_days} days"), "ACTIVE").otherwise("LONG_TERM")
    return profiles.filter(recent).withColumns({"creation_delay": F.col("last_modified") - day, "storage_tier": tier})


def sampled(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """About so many percent of the rows; all are read."""
    return df.sample(percent / 100, seed)


def sampled_blocks(spark: SparkSession, path: str, percent: float, seed: int = 0) -> DataFrame:
    """The rows of about so many percent of a table's files, drawn by a hash of their place; no other file is opened.

    All rows of a file come or none, so what is near in the table comes together.  100 is the whole table; at any smaller
    percentage the files of a larger one have those of a smaller.
    """
    table = spark.read.parquet(path)
    draw = F.pmod(F.xxhash64(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(seed)), F.lit(1_000_000)) < F.lit(round(percent * 10_000))
    chosen = [r["path"] for r in listed(spark, path).filter(draw).select("path").collect()]
    if not chosen:
        return table.limit(0)
    return spark.read.schema(table.schema).option("basePath", path).parquet(*chosen)
