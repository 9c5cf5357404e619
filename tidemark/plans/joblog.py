"""A log of the jobs that build tables: what each read and wrote, and at what cost.  Lineage is read from it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.columns import references

NODE = "struct<project:string,dataset:string,table:string>"

#: A row of the log; `lineage.edges` and `lineage.attributes` read it.
LOG = (
    f"job_id string, state string, error string, created timestamp, user string, statement_type string, query string, destination {NODE}, referenced array<{NODE}>, "
    "bytes long, rows long, processed_ms long, wait_ms long, slot_ms long, labels map<string,string>"
)


def node(name: str, project: str = "", dataset: str = "") -> tuple[str, str, str]:
    """A table's name or path as (project, dataset, table): of a path, its last folder and that above it."""
    parts = [p for p in name.replace("`", "").split("/" if "/" in name else ".") if p]
    parts = [project, dataset, *parts][-3:] if "/" not in name else [project, *([dataset, *parts][-2:])]
    return tuple(parts)


@dataclass
class Run:
    """One job while it runs; what it sets is logged when it ends."""

    destination: str
    query: str = ""
    read: list[str] = field(default_factory=list)
    rows: int | None = None
    bytes: int | None = None
    statement_type: str = "MERGE"
    labels: dict[str, str] = field(default_factory=dict)


@dataclass
class JobLog:
    """A log in files of a folder: each job appends one row."""

    spark: SparkSession
    path: str
    project: str = "local"
    dataset: str = "default"

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def _append(self, run: Run, created: datetime, seconds: float, error: str | None) -> None:
        sc = self.spark.sparkContext
        own = lambda name: node(name, self.project, self.dataset)
        ms = int(1000 * seconds)
        labels = run.labels | ({"tag": tag} if (tag := sc.getLocalProperty("spark.job.description")) else {})
        row = (sc.applicationId + f"_{created:%Y%m%d%H%M%S%f}", "DONE", error, created, sc.sparkUser(), run.statement_type, run.query, own(run.destination), [own(r) for r in sorted(set(run.read))], run.bytes, run.rows, ms, None, None, labels)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def run(self, destination: str, rows: DataFrame | None = None, query: str = "", **labels: str) -> Iterator[Run]:
        """Log the block as one job that writes a table; the tables that `rows` reads are those that it reads.

        A block that fails is logged with its error, which goes on.
        """
        run = Run(destination, query, references(rows) if rows is not None else [], labels=labels)
        created, began = datetime.now(), time.monotonic()
        try:
            yield run
        except Exception as e:
            self._append(run, created, time.monotonic() - began, f"{type(e).__name__}: {e}"[:1000])
            raise
        self._append(run, created, time.monotonic() - began, None)


@contextmanager
def noted(log: JobLog | None, destination: str, rows: DataFrame, query: str = "") -> Iterator[Run]:
    """`log.run`, or nothing without a log."""
    if log is None:
        yield Run(destination)
    else:
        with log.run(destination, rows, query) as run:
            yield run


def users(log: DataFrame) -> DataFrame:
    """(user, n_jobs, n_failed, rows, bytes, ms) of a log."""
    return log.groupBy("user").agg(F.count("*").alias("n_jobs"), F.count("error").alias("n_failed"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("processed_ms").alias("ms"))
