"""Tables that change as a whole: rows in folders of their own version, and one pointer that is written last.

A version's rows lie in `<path>/<column>=<value>/_version=<number>-<draft>`.  Its pointer is one small file below
`<path>__pointer/_version=<number>`, a row for each folder that the table then has; the newest pointer is the table.  Of
two writers that reach for the same number, the one whose file came first has it, and the other has an error.
Nothing that a pointer names is ever overwritten, and a file appears when Spark commits it, so a reader sees the old
table or the new one, and a writer that is lost in between leaves rows that no pointer names.  Such folders may be
deleted (`unreferenced` lists them); so may old pointers, which are the table's earlier versions.

A table has one partition column.  Its folders are as many as its partitions, or parts of them, and are listed on the
driver, as Spark does too.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "_version"

#: A row of a pointer.  A table without rows has one row without a folder.
POINTER = "token string, at timestamp, base string, folder string, key string, bytes long, files long, last_modified timestamp, columns string"

#: What Spark calls the folder of a null.
_NULL = "__HIVE_DEFAULT_PARTITION__"

Keys = Callable[[str | None], bool]


class Conflict(Exception):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Folder:
    """One folder of a version: its place below the base, and what its files are."""

    folder: str
    key: str | None
    bytes: int
    files: int
    last_modified: datetime


@dataclass(frozen=True)
class Version:
    number: int
    base: str
    columns: T.StructType
    folders: list[Folder]

    @property
    def bytes(self) -> int:
        return sum(f.bytes for f in self.folders)


@dataclass(frozen=True)
class Draft:
    """Rows that are written and not published, and what was observed while they were."""

    version: Version
    metrics: dict


@dataclass(frozen=True)
class Published:
    """A table at `path`, partitioned by `key`."""

    spark: SparkSession
    path: str
    key: str

    @property
    def pointer(self) -> str:
        return f"{self.path}__pointer"

    def numbers(self) -> list[int]:
        """The versions that there are, the oldest first.  Files are listed, not read."""
        files = _listed(self.spark, self.pointer)
        found = files.select(F.regexp_extract("path", rf"/{VERSION}=(\d+)/", 1).cast("long").alias("n")).distinct() if files is not None else None
        return sorted(r["n"] for r in found.collect()) if found is not None else []

    def exists(self) -> bool:
        return bool(self.numbers())

    def version(self, number: int | None = None) -> Version | None:
        """A version, or the newest; None if there is none."""
        if number is None:
            number = max(self.numbers(), default=None)
            if number is None:
                return None
        rows = self._rows(number)
        folders = [Folder(r["folder"], r["key"], r["bytes"], r["files"], r["last_modified"]) for r in rows if r["folder"] is not None]
        return Version(number, rows[0]["base"], T.StructType.fromJson(json.loads(rows[0]["columns"])), folders)

    def _rows(self, number: int) -> list[Row]:
        """The rows of a pointer; of several files, those of the first."""
        rows = self.spark.read.schema(POINTER).parquet(f"{self.pointer}/{VERSION}={number}").select("*", F.col("_metadata.file_modification_time").alias("written")).collect()
        first = min((r["written"], r["token"]) for r in rows)
        return [r for r in rows if (r["written"], r["token"]) == first]

    def read(self, number: int | None = None, keep: Keys | None = None) -> DataFrame:
        """The rows of a version, or of the newest, from the folders whose key is to be kept."""
        version = self.version(number)
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        paths = [f"{version.base}/{f.folder}" for f in version.folders if keep is None or keep(f.key)]
        if not paths:
            return self.spark.createDataFrame([], version.columns)
        full = T.StructType([*version.columns.fields, T.StructField(VERSION, T.StringType())])
        return self.spark.read.schema(full).option("basePath", version.base).parquet(*paths).drop(VERSION)

    def metadata(self, table_name: str) -> DataFrame:
        """(table_name, partition_id, last_modified, n_files, n_bytes) of the newest version, from its pointer alone."""
        version = self.version()
        rows = [(table_name, f.key, f.last_modified, f.files, f.bytes) for f in version.folders] if version else []
        each = self.spark.createDataFrame(rows, "table_name string, partition_id string, last_modified timestamp, n_files long, n_bytes long")
        return each.groupBy("table_name", "partition_id").agg(F.max("last_modified").alias("last_modified"), F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))

    def stage(self, rows: DataFrame, sort: list[str] = (), drop: list[str] = (), **metrics: Column) -> Draft:
        """Write rows as the next version's, in one pass, with aggregates observed on the way; nobody sees them yet.

        Large partitions are split over tasks and small ones put together by Spark's rebalancing.
        """
        number = max(self.numbers(), default=0) + 1
        # A draft that was lost has folders of its own, in which no later one writes.
        own = f"{number}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        plain = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]]
        # Observed behind the exchange, in the stage that writes: a stage that is run again for a lost executor counts once.
        laid = rows.hint("rebalance", self.key).observe(seen, *plain).drop(*drop)
        columns = T.StructType([*[f for f in laid.schema if f.name != self.key], T.StructField(self.key, T.StringType())])
        laid = laid.withColumn(self.key, F.col(self.key).cast("string")).withColumn(VERSION, F.lit(own))
        if sort:
            laid = laid.sortWithinPartitions(self.key, VERSION, *sort)
        laid.write.mode("append").partitionBy(self.key, VERSION).parquet(self.path)
        found = seen.get
        files = _listed(self.spark, f"{self.path}/*/{VERSION}={own}") if found["rows"] else None
        return Draft(Version(number, self.path, columns, self._folders(files) if files is not None else []), found)

    def _folders(self, files: DataFrame) -> list[Folder]:
        place = F.regexp_extract("path", rf"/([^/]*/{VERSION}=[^/]*)/[^/]*$", 1)
        rows = files.groupBy(place.alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.max("modificationTime").alias("at")).collect()
        return [Folder(r["folder"], _value(r["folder"]), r["bytes"], r["files"], r["at"]) for r in rows]

    def publish(self, draft: Draft, keep: Keys | None = None) -> Version:
        """Make a draft the table, with those folders of the newest version whose key is to be kept (by default, all of none)."""
        kept = []
        if keep is not None and (old := self.version()) is not None:
            kept = [f for f in old.folders if keep(f.key)]
        version = Version(draft.version.number, draft.version.base, draft.version.columns, [*kept, *draft.version.folders])
        self._point(version)
        return version

    def adopt(self, version: Version) -> None:
        """Make this table, which is not there yet, show another table's version.  No row is copied."""
        self._point(Version(1, version.base, version.columns, version.folders))

    def _point(self, version: Version) -> None:
        token, at, columns = uuid.uuid4().hex, datetime.now(), version.columns.json()
        rows = [(token, at, version.base, f.folder, f.key, f.bytes, f.files, f.last_modified, columns) for f in version.folders]
        rows = rows or [(token, at, version.base, None, None, None, None, None, columns)]
        place = f"{self.pointer}/{VERSION}={version.number}"
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(place)
        if self._rows(version.number)[0]["token"] != token:
            raise Conflict(place)

    def unreferenced(self) -> DataFrame:
        """(folder) of the folders that no pointer names."""
        files = _listed(self.spark, self.path)
        if files is None:
            return self.spark.createDataFrame([], "folder string")
        there = {f.folder for f in self._folders(files)}
        named = {f.folder for n in self.numbers() for f in self.version(n).folders}
        return self.spark.createDataFrame([(f"{self.path}/{x}",) for x in sorted(there - named)], "folder string")


def _listed(spark: SparkSession, place: str) -> DataFrame | None:
    """(path, modificationTime, length) of the Parquet files below a place; None if there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(place)
    except AnalysisException:
        return None
    return files.select("path", "modificationTime", "length")


def _value(folder: str) -> str | None:
    """The key in a folder's name, in which Spark escapes some characters."""
    value = re.match(r"[^=]*=([^/]*)/", folder)[1]
    return None if value == _NULL else unquote(value)
