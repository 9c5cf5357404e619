"""History of a query's result by validity intervals (slowly changing dimension, type II).

A history has rows (unique_key, revision_hash, valid_from, valid_to, entity): `entity` is the whole row, `valid_to` is
null while it is current.  Intervals are half open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import ANY_PARTITION, NULL_PARTITION
from tidemark.operators.staleness import detect_staleness
from tidemark.plans.joblog import JobLog, noted
from tidemark.sources.published import Draft, Published

COLUMNS = ["unique_key", "revision_hash", "valid_from", "valid_to", "entity"]


def instant(at: datetime | str | Column | None) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def snapshot(df: DataFrame, key: str | Column, at: datetime | str, revision: str) -> DataFrame:
    """One revision of a table, as open rows."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias("unique_key"), F.lit(revision).alias("revision_hash"), instant(at).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.struct(*df.columns).alias("entity"))


def latest(history: DataFrame) -> DataFrame:
    return history.filter("valid_to is null").select("entity.*")


def as_of(history: DataFrame, at: datetime | str | None) -> DataFrame:
    """The rows that held at an instant; the current ones for None."""
    if at is None:
        return latest(history)
    return history.filter((F.col("valid_from") <= instant(at)) & F.coalesce(instant(at) < F.col("valid_to"), F.lit(True))).select("entity.*")


def timeline(history: DataFrame, instants: list[datetime | str | None]) -> DataFrame:
    """The rows that held at each instant, with the instant in `_at`; no instants are the current rows, as `_at` null.

    Each row lists the instants that it covers, so nothing is joined.
    """
    wanted = F.array(*[instant(i) for i in instants or [None]])
    covers = lambda at: F.when(at.isNull(), F.col("valid_to").isNull()).otherwise((F.col("valid_from") <= at) & F.coalesce(at < F.col("valid_to"), F.lit(True)))
    return history.withColumn("_at", F.explode(F.filter(wanted, covers))).select("_at", "entity.*")


def compared(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Current rows beside fresh ones, with `action`: CHANGED, UNCHANGED, NEW or DELETE.

    A key that is null on both sides, or twice in the fresh rows, is an error.
    """
    once = fresh.withColumn("_times", F.count("*").over(Window.partitionBy("unique_key")))
    problem = F.when(F.col("_times") > 1, "a key occurs twice").when(F.col("unique_key").isNull(), "a key is null")
    ok = F.when(problem.isNull(), True).otherwise(F.raise_error(F.coalesce(problem, F.lit(""))).cast("boolean"))
    side = lambda df, n: df.select(F.col("unique_key").alias("unique_key"), F.struct("revision_hash", "valid_from", "valid_to", "entity").alias(n))
    both = side(history.filter("valid_to is null"), "old").join(side(once.filter(ok), "new"), "unique_key", "full")
    action = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "DELETE").when(F.col("old.entity").eqNullSafe(F.col("new.entity")), "UNCHANGED").otherwise("CHANGED")
    return both.withColumn("action", action)


def rewritten(history: DataFrame, fresh: DataFrame, at: datetime | str) -> DataFrame:
    """What an update makes of the current rows, with `action`: kept rows, rows closed at an instant, and new rows.

    One join; a changed row gives two.
    """
    row = lambda side, valid_to: F.struct(F.col(f"{side}.revision_hash"), F.col(f"{side}.valid_from"), valid_to.cast("timestamp").alias("valid_to"), F.col(f"{side}.entity"))
    kept, closed, opened = row("old", F.lit(None)), row("old", instant(at)), row("new", F.lit(None))
    out = F.when(F.col("action") == "UNCHANGED", F.array(kept)).when(F.col("action") == "NEW", F.array(opened)).when(F.col("action") == "DELETE", F.array(closed)).otherwise(F.array(closed, opened))
    return compared(history, fresh).select("unique_key", "action", F.explode(out).alias("row")).select("unique_key", "row.*", "action").select(*COLUMNS, "action")


def changes(history: DataFrame, fresh: DataFrame, at: datetime | str) -> DataFrame:
    """The rows that an update writes: old rows closed at an instant, and new rows."""
    return rewritten(history, fresh, at).filter("action <> 'UNCHANGED'")


def update(history: DataFrame, fresh: DataFrame, at: datetime | str) -> DataFrame:
    """The history after an update."""
    return history.filter("valid_to is not null").unionByName(rewritten(history, fresh, at).drop("action"))


def leaves(schema: T.StructType, base: str) -> list[tuple[str, Column]]:
    """(dotted path, value as text) of every field that is no struct."""
    out = []
    for f in schema:
        path = f"{base}.`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += [(f"{f.name}.{p}", c) for p, c in leaves(f.dataType, path)]
        else:
            text = F.col(path).cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(F.col(path))
            out.append((f.name, text))
    return out


def diff(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """(action, unique_key, entity_changes, entity_comparison) of the keys that differ.

    Changes are (key, before, after) by field; the comparison has the rows before and after, as far as they are there.
    """
    schema = history.schema["entity"].dataType
    fields = [
        F.struct(F.lit(path).alias("key"), before.alias("before"), after.alias("after"))
        for (path, before), (_, after) in zip(leaves(schema, "old.entity"), leaves(schema, "new.entity"), strict=True)
    ]
    differ = F.filter(F.array(*fields), lambda x: ~x["before"].eqNullSafe(x["after"]))
    rows = F.array_compact(F.array("old.entity", "new.entity"))
    return compared(history, fresh).filter("action <> 'UNCHANGED'").select("action", "unique_key", differ.alias("entity_changes"), rows.alias("entity_comparison"))


def validate(history: DataFrame) -> DataFrame:
    """(unique_key, n_overlaps, n_gaps) of each key: rows that begin before the one ahead of them ends, or after."""
    order = Window.partitionBy("unique_key").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    following = F.lead("valid_from").over(order)
    rows = history.withColumn("_next", following)
    overlap = F.col("_next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_next")))
    return rows.groupBy("unique_key").agg(F.count_if(overlap).alias("n_overlaps"), F.count_if(F.col("valid_to") < F.col("_next")).alias("n_gaps"))


def monitor_revisions(history: DataFrame, exact: bool = False) -> DataFrame:
    """Per revision: when it came, its keys, those still current, quartiles of the lifetime of its closed rows."""
    keys = F.count_distinct("unique_key") if exact else F.approx_count_distinct("unique_key")
    seconds = F.unix_timestamp("valid_to") - F.unix_timestamp("valid_from")
    quartiles = F.percentile_approx(seconds, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]), 1_000_000 if exact else 10_000)
    return history.groupBy("revision_hash").agg(F.min("valid_from").alias("snapshot_at"), keys.alias("n_keys"), F.count_if(F.col("valid_to").isNull()).alias("n_alive"), quartiles.alias("lifetime_quartiles"))


def monitor_entities(history: DataFrame, exact: bool = False) -> DataFrame:
    """Per key: first and last change, and its revisions."""
    revisions = F.count_distinct("revision_hash") if exact else F.approx_count_distinct("revision_hash")
    return history.groupBy("unique_key").agg(F.min("valid_from").alias("first_changed_at"), F.max("valid_from").alias("last_changed_at"), revisions.alias("n_revisions"))


def overlay(history: DataFrame, partial: DataFrame) -> DataFrame:
    """The current rows with a partial snapshot laid over them: keys that it lacks are kept."""
    live = history.filter("valid_to is null").select("unique_key", F.col("entity").alias("old"))
    both = live.join(partial.select("unique_key", F.col("entity").alias("new")), "unique_key", "full")
    return both.select(F.coalesce("new", "old").alias("entity")).select("entity.*")


def reconstruct(history: DataFrame) -> DataFrame:
    """A repaired history: a row that shares its start with the next one goes, and so does one equal to the row that it
    continues; each row ends where the next begins, and a key's last row keeps its own end."""
    order = Window.partitionBy("unique_key").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    ordered = history.withColumn("_next", F.lead("valid_from").over(order)).filter(~F.coalesce(F.col("_next") == F.col("valid_from"), F.lit(False)))
    # Of equal rows that follow each other, the first stands for all.
    ordered = ordered.withColumn("_before", F.lag(F.struct("valid_to", "entity")).over(order))
    joined = F.coalesce(F.col("_before.entity").eqNullSafe(F.col("entity")) & (F.col("_before.valid_to") == F.col("valid_from")), F.lit(False))
    last_end = F.last("valid_to").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = ordered.withColumn("_end", last_end).withColumn("_joined", joined).filter("not _joined")
    ends = F.coalesce(F.lead("valid_from").over(order), F.col("_end"))
    return kept.withColumn("valid_to", ends).select(*COLUMNS)


class NothingChanged(Exception):
    """An update that found no difference."""


@dataclass
class HistoryTable:
    """A history stored as a published table: current rows in one partition, closed rows by the day that they end, each
    ordered by `valid_from`.

    Only current rows are read and rewritten by an update: it writes its rows once, as folders of a new version, and its
    pointer last.  So an update that stops leaves the history as it was, and readers may read at any time.
    """

    spark: SparkSession
    path: str
    key: str
    clock: Callable[[], datetime] = datetime.now
    new_id: Callable[[], str] = lambda: uuid.uuid4().hex
    #: Where each init and update is noted, if anywhere.
    log: JobLog | None = None

    OPEN = "open"

    @property
    def table(self) -> Published:
        return Published(self.spark, self.path, "closed_on")

    def exists(self) -> bool:
        return self.table.exists()

    def read(self) -> DataFrame:
        return self.table.read().select(*COLUMNS)

    def current(self) -> DataFrame:
        """The open rows, of their partition alone."""
        return self.table.read(keep=lambda day: day == self.OPEN).select(*COLUMNS)

    def as_of(self, at: datetime | str | None) -> DataFrame:
        """The rows that held at an instant, from the partitions that end later."""
        if at is None:
            return latest(self.current())
        # A day of slack, should the session's time zone differ from the writer's.
        later = F.col("closed_on") >= F.date_format(instant(at) - F.expr("interval 1 day"), "yyyyMMdd")
        return as_of(self.table.read().filter(later), at)

    def init(self, df: DataFrame) -> int:
        if self.exists():
            raise ValueError(f"there is a history at {self.path}")
        with noted(self.log, self.path, df) as run:
            run.rows = self._begin(snapshot(df, self.key, self.clock(), self.new_id()))
        return run.rows

    def _stage(self, rows: DataFrame, **options: object) -> Draft:
        day = F.coalesce(F.date_format("valid_to", "yyyyMMdd"), F.lit(self.OPEN))
        return self.table.stage(rows.withColumn("closed_on", day), sort=["valid_from"], **options)

    def _begin(self, rows: DataFrame) -> int:
        draft = self._stage(rows)
        self.table.publish(draft)
        return draft.metrics["rows"]

    def same_columns(self, df: DataFrame) -> bool:
        stored = self.table.version().columns["entity"].dataType
        return [(f.name, f.dataType) for f in stored] == [(f.name, f.dataType) for f in df.schema]

    def update(self, df: DataFrame, allow_unchanged: bool = False, on_other_columns: str = "error", dry_run: bool = False) -> int:
        """Rows closed plus rows opened; with `dry_run`, those that would be, and nothing is written.

        If the columns have changed, that is an error, or (`recreate`) the history is kept as a table named by the
        instant and begins anew.
        """
        if on_other_columns not in ("error", "recreate"):
            raise ValueError("on_other_columns is error or recreate")
        at, revision = self.clock(), self.new_id()
        fresh = snapshot(df, self.key, at, revision)
        same = self.same_columns(df)
        if not same and (on_other_columns == "error" or dry_run):
            raise ValueError("the columns have changed: move the history away and begin a new one")
        if dry_run:
            return changes(self.current(), fresh, at).count()
        with noted(self.log, self.path, df) as run:
            if same:
                run.rows = self._replace(fresh, at, allow_unchanged)
            else:
                self.backup(at).adopt(self.table.version())
                run.rows = self._begin(fresh)
        return run.rows

    def _replace(self, fresh: DataFrame, at: datetime, allow_unchanged: bool) -> int:
        draft = self._stage(rewritten(self.current(), fresh, at), drop=["action"], written=F.count_if(F.col("action") != "UNCHANGED"))
        written = draft.metrics["written"]
        if written:
            self.table.publish(draft, keep=lambda day: day != self.OPEN)
        elif not allow_unchanged:
            raise NothingChanged(self.path)
        return written

    def backup(self, at: datetime) -> Published:
        """The history as it was before it began anew at an instant; its rows are not copied."""
        return Published(self.spark, f"{self.path}__{at:%Y%m%d%H%M%S}", "closed_on")

    def update_if_stale(self, df: DataFrame, metadata: DataFrame, destination: str, sources: list[str], now: datetime, tolerate: timedelta = timedelta(0), force_expired_at: datetime | None = None, **options: object) -> int | None:
        """`update` where the history is older than a source; None where it is not, and nothing is read."""
        whole = self.spark.createDataFrame([(NULL_PARTITION, [ANY_PARTITION])], "destination string, sources array<string>")
        if not detect_staleness(metadata, destination, sources, whole, now, tolerate, force_expired_at):
            return None
        return self.update(df, **options)

    def views(self, name: str) -> None:
        """Temporary views of the current rows, of the history and of both monitors, and table functions for SQL:
        `<name>__as_of(instant)` and `<name>__timeline(array of instants)`."""
        latest(self.current()).createOrReplaceTempView(name)
        self.read().createOrReplaceTempView(f"{name}__history")
        row = self.current().select("entity.*").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row)
        named = ", ".join(f"h.entity.`{f.name}`" for f in row)
        holds = lambda at: f"h.valid_from <= {at} AND (h.valid_to IS NULL OR {at} < h.valid_to)"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}__as_of(instant TIMESTAMP) RETURNS TABLE({columns}) RETURN SELECT {named} FROM {name}__history h WHERE {holds('instant')}")
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}__timeline(instants ARRAY<TIMESTAMP>) RETURNS TABLE(at TIMESTAMP, {columns}) "
            f"RETURN SELECT t.at, {named} FROM {name}__history h LATERAL VIEW explode(instants) t AS at WHERE {holds('t.at')}"
        )
        monitor_revisions(self.read()).createOrReplaceTempView(f"monitor__{name}__snapshot_job")
        monitor_entities(self.read()).createOrReplaceTempView(f"monitor__{name}__entity")


def assert_golden(store: HistoryTable, df: DataFrame, update_golden: bool = False) -> None:
    """Fail if a result differs from the stored one; a first call, or an update, stores it."""
    if not store.exists():
        store.init(df)
    elif update_golden:
        store.update(df, allow_unchanged=True)
    else:
        found = diff(store.current(), snapshot(df, store.key, store.clock(), "check"))
        if rows := found.limit(20).collect():
            raise AssertionError(f"the result differs from the stored one: {rows}")
