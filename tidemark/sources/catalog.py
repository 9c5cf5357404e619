"""The catalog: partition columns, labels, descriptions, temporary databases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import TableRef
from tidemark.plans.columns import references


def partition_columns(spark: SparkSession, table: TableRef) -> list[tuple[str, str]]:
    """(name, type) of a table's partition columns."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(str(table)) if c.isPartition]


def labels(spark: SparkSession, table: TableRef) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_labels(spark: SparkSession, table: TableRef, values: dict[str, str], view: bool = False) -> None:
    """Set labels of a table or view; others stay."""
    if values:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in values.items())
        spark.sql(f"ALTER {'VIEW' if view else 'TABLE'} {table} SET TBLPROPERTIES ({pairs})")


def description(spark: SparkSession, database: str) -> str:
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").filter(F.col("info_name") == "Comment").collect()
    return rows[0]["info_value"] if rows else ""


def set_description(spark: SparkSession, database: str, text: str) -> None:
    spark.sql(f"COMMENT ON DATABASE `{database}` IS {_quoted(text)}")


def tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{database}`").filter("not isTemporary")


def table_description(spark: SparkSession, table: TableRef) -> str | None:
    """A table's comment."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(F.col("col_name") == "Comment").collect()
    return rows[0]["data_type"] if rows else None


def partition_metadata(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, partition_id) of the tables of a database that are partitioned by one column."""
    out = spark.createDataFrame([], "table_name string, partition_id string")
    known_views = views(spark, database)
    for row in tables(spark, database).collect():
        ref = TableRef(database, row["tableName"])
        if row["tableName"] in known_views:
            continue
        if len(partition_columns(spark, ref)) == 1:
            value = F.url_decode(F.regexp_replace("partition", "^[^=]*=", ""))
            out = out.unionByName(spark.sql(f"SHOW PARTITIONS {ref}").select(F.lit(row["tableName"]).alias("table_name"), value.alias("partition_id")))
    return out


def views(spark: SparkSession, database: str) -> list[str]:
    """The views of a database."""
    return sorted(t.name for t in spark.catalog.listTables(database) if t.tableType == "VIEW")


def dependencies(spark: SparkSession, database: str) -> DataFrame:
    """(view_name, table_name) of the tables that each view of a database reads, through other views too.

    Tables of the database go by their name, others by their database and name.
    """
    rows = []
    for view in views(spark, database):
        for name in references(spark.table(str(TableRef(database, view)))):
            parts = name.split(".")
            own = len(parts) > 1 and "/" not in name and parts[-2] == database
            rows.append((view, parts[-1] if own else ".".join(parts[-2:]) if "/" not in name else name))
    return spark.createDataFrame(rows, "view_name string, table_name string")


def view_definitions(spark: SparkSession, database: str) -> DataFrame:
    """(view_name, view_definition) of the views of a database."""
    rows = []
    for view in views(spark, database):
        text = spark.sql(f"DESCRIBE TABLE EXTENDED {TableRef(database, view)}").filter(F.col("col_name") == "View Text").first()
        rows.append((view, text["data_type"] if text else None))
    return spark.createDataFrame(rows, "view_name string, view_definition string")


def routines(spark: SparkSession, database: str) -> DataFrame:
    """(routine_name, description) of the functions that a database has of its own."""
    rows = [(f.name, f.description) for f in spark.catalog.listFunctions(database) if f.namespace and f.namespace[-1] == database]
    return spark.createDataFrame(rows, "routine_name string, description string")


def copy_table(spark: SparkSession, source: TableRef, target: TableRef) -> None:
    """A new table with the source's layout, properties and rows."""
    spark.sql(f"CREATE TABLE {target} LIKE {source}")
    spark.table(str(source)).write.insertInto(str(target))


def recreate(spark: SparkSession, table: TableRef, df: DataFrame, backup: TableRef | None = None) -> None:
    """Put a table of the rows and columns of `df` in a table's place, by name.

    The description, labels, partition columns, buckets and their order, and the comments of columns that are still
    there are kept.  The new table
    is written beside the old one before the names change; the old one stays as `backup`, or is dropped.
    """
    parts = [c for c, _ in partition_columns(spark, table) if c in df.columns]
    about, kept = table_description(spark, table), {k: v for k, v in labels(spark, table).items() if not k.startswith(("spark.", "transient_", "numFiles", "totalSize"))}
    fresh = TableRef(table.schema, f"{table.table}__{uuid.uuid4().hex[:12]}", table.catalog)
    writer = with_comments(spark.table(str(table)), df).write.format("parquet")
    n, by, order = buckets(spark, table)
    if by and set(by) <= set(df.columns):
        writer = writer.bucketBy(n, *by)
        writer = writer.sortBy(*order) if order and set(order) <= set(df.columns) else writer
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(str(fresh))
    if about:
        spark.sql(f"COMMENT ON TABLE {fresh} IS {_quoted(about)}")
    set_labels(spark, fresh, kept)
    spark.sql(f"ALTER TABLE {table} RENAME TO {backup}" if backup else f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    if parts:
        # Some catalogs keep the places that partitions had under the old name.
        for renamed in [table, backup] if backup else [table]:
            spark.sql(f"REPAIR TABLE {renamed} DROP PARTITIONS")
            spark.sql(f"REPAIR TABLE {renamed} ADD PARTITIONS")


def buckets(spark: SparkSession, table: TableRef) -> tuple[int, list[str], list[str]]:
    """(number, columns, order within) of a table's buckets."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    names = lambda key: [c.strip(" `[]") for c in about.get(key, "").split(",") if c.strip(" `[]")]
    return int(about.get("Num Buckets") or 0), names("Bucket Columns"), names("Sort Columns")


def with_comments(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` with the column comments and other metadata that columns of the same name had in `old`."""
    kept = {f.name: f.metadata for f in old.schema if f.metadata}
    return new.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=kept.get(f.name, f.metadata)) for f in new.schema])


@contextmanager
def temporary_database(spark: SparkSession) -> Iterator[str]:
    """A database that exists within the block."""
    name = f"tmp_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE `{name}`")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE `{name}` CASCADE")
