"""The registered queries of the data-build operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.assertions import sure_eq, sure_like, sure_nonnull, sure_range, sure_values
from tidemark.functions.text import format_quantiles, json_entries, parse_labels
from tidemark.operators import checks, profile, scd2
from tidemark.operators.alignment import day_to_day, day_to_day_padded, day_to_week
from tidemark.operators.labels import merged_labels, partition_labels, view_labels
from tidemark.operators.ranges import contiguous_run, gaps, refresh_range
from tidemark.operators.refresh import partition_id, replace_range, table_at, update_partitions
from tidemark.operators.profile_store import StoredProfile
from tidemark.operators.staleness import stale_partitions
from tidemark.plans.columns import recorded
from tidemark.plans.joblog import JobLog
from tidemark.plans.lineage import attributes, edges, lineage, mermaid
from tidemark.sources.published import Published
from tidemark.sources.tables import data_metadata, parquet, scratch, storage_profile

Query = Callable[[SparkSession, str], DataFrame]

NOW, FORCED = datetime(2024, 3, 1), datetime(2024, 1, 15)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))


def _joined(alignments: DataFrame) -> DataFrame:
    return alignments.select("destination", F.array_join("sources", ",").alias("sources"))


_DAYS = "days as (select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day))::date as d from events)"


@query(f"with {_DAYS} select strftime(d, '%Y%m%d') as destination, strftime(d, '%Y%m%d') as sources from days")
def alignment_day2day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(day_to_day(_span(spark, sf_dir)))


@query(f"with {_DAYS} select strftime(d, '%Y%m%d') as destination, strftime(d - 1, '%Y%m%d') || ',' || strftime(d, '%Y%m%d') || ',' || strftime(d + 1, '%Y%m%d') as sources from days")
def alignment_day2day_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(day_to_day_padded(_span(spark, sf_dir)))


@query(f"with {_DAYS} select strftime(d - dayofweek(d)::int, '%Y%m%d') as destination, string_agg(strftime(d, '%Y%m%d'), ',' order by d) as sources from days group by 1")
def alignment_day2week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(day_to_week(_span(spark, sf_dir)))


def _day() -> Column:
    return F.date_format("ts", "yyyyMMdd")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source days by their last event; destination days an hour ahead of it, every third day an hour behind, every seventh missing."""
    events = parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = data_metadata(events, "events", _day(), F.col("ts"))
    day = F.dayofmonth("last_modified")
    lag = F.when(day % 3 == 0, F.expr("interval -1 hour")).otherwise(F.expr("interval 1 hour"))
    ours = source.filter(day % 7 != 0).select(F.lit("daily").alias("table_name"), "partition_id", (F.col("last_modified") + lag).alias("last_modified"))
    return source.unionByName(ours)


_META = f"""with {_DAYS}, src as (select strftime(ts, '%Y%m%d') as id, max(ts) as lm from events group by 1),
dst as (select id, lm + case when day(lm) % 3 = 0 then interval (-1) hour else interval 1 hour end as lm from src where day(lm) % 7 <> 0)"""
_BEHIND = "(dst.lm is null or {forced} or s.lm - dst.lm >= interval 30 minute or (s.lm >= dst.lm and timestamp '2024-03-01' - dst.lm >= interval 30 minute))"


@query(f"{_META} select strftime(d, '%Y%m%d') as partition_id from days join src s on s.id = strftime(d, '%Y%m%d') left join dst on dst.id = s.id where {_BEHIND.format(forced='false')}")
def staleness_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_partitions(_metadata(spark, sf_dir), "daily", ["events"], day_to_day(_span(spark, sf_dir)), NOW)


@query(f"{_META} select strftime(d, '%Y%m%d') as partition_id from days join src s on s.id = strftime(d, '%Y%m%d') left join dst on dst.id = s.id where {_BEHIND.format(forced="coalesce(dst.lm <= timestamp '2024-01-15', false)")}")
def staleness_force_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_partitions(_metadata(spark, sf_dir), "daily", ["events"], day_to_day(_span(spark, sf_dir)), NOW, force_expired_at=FORCED)


@query(f"{_META} select distinct strftime(d, '%Y%m%d') as partition_id from days cross join src s left join dst on dst.id = strftime(d, '%Y%m%d') where {_BEHIND.format(forced='false')}")
def staleness_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    anything = day_to_day(_span(spark, sf_dir)).withColumn("sources", F.array(F.lit("__ANY__")))
    return stale_partitions(_metadata(spark, sf_dir), "daily", ["events"], anything, NOW)


@query(f"{_META} select strftime(d, '%Y%m%d') as partition_id from days cross join (select max(lm) - interval 10 day as lm from src) s left join dst on dst.id = strftime(d, '%Y%m%d') where {_BEHIND.format(forced='false')}")
def staleness_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source has no partitions, so it stands for each that is asked for."""
    both = _metadata(spark, sf_dir)
    whole = both.filter("table_name = 'events'").agg(F.lit("events").alias("table_name"), F.lit(None).cast("string").alias("partition_id"), (F.max("last_modified") - F.expr("interval 10 day")).alias("last_modified"))
    return stale_partitions(both.filter("table_name = 'daily'").unionByName(whole), "daily", ["events"], day_to_day(_span(spark, sf_dir)), NOW)


@query(f"{_META} select strftime(d, '%Y%m%d') as partition_id from days where (select count(*) from src where src.id in (strftime(d - 1, '%Y%m%d'), strftime(d, '%Y%m%d'), strftime(d + 1, '%Y%m%d'))) = 3 and exists (select 1 from src s left join dst on dst.id = strftime(d, '%Y%m%d') where s.id in (strftime(d - 1, '%Y%m%d'), strftime(d, '%Y%m%d'), strftime(d + 1, '%Y%m%d')) and {_BEHIND.format(forced='false')})")
def staleness_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are judged only where the days around them are there too."""
    return stale_partitions(_metadata(spark, sf_dir), "daily", ["events"], day_to_day_padded(_span(spark, sf_dir)), NOW)


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events").filter(F.dayofmonth("ts") % 5 != 0).select(_day().alias("partition_id")).distinct()


_HOLED = "holed as (select distinct ts::date as d from events where day(ts) % 5 <> 0)"


@query(f"with {_HOLED} select strftime(d, '%Y%m%d') as partition_id, coalesce(abs(datediff('day', lag(d) over (order by d desc), d)) > 1, true) as has_gap from holed")
def partition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(_holed(spark, sf_dir))


@query(
    f"""with {_HOLED}, runs as (select d, datediff('day', date '1970-01-01', d) - row_number() over (order by d) as run from holed),
ends as (select run, min(d) as lo, max(d) as hi from runs group by run)
select 'backward' as direction, strftime(lo, '%Y%m%d') as first, strftime(hi, '%Y%m%d') as last from ends where hi = (select max(hi) from ends)
union all select 'forward', strftime(lo, '%Y%m%d'), strftime(hi, '%Y%m%d') from ends where lo = (select min(lo) from ends)"""
)
def first_contiguous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda d: contiguous_run(_holed(spark, sf_dir), d).agg(F.lit(d).alias("direction"), F.min("partition_id").alias("first"), F.max("partition_id").alias("last"))
    return one("backward").unionByName(one("forward"))


@query(
    f"""{_META}, stale as (select s.id, strptime(s.id, '%Y%m%d')::date as d from src s left join dst on dst.id = s.id where {_BEHIND.format(forced='false')}),
runs as (select *, datediff('day', date '1970-01-01', d) - row_number() over (order by d) as run from stale),
chosen as (select min(id) as first, max(id) as last from runs where run = (select max_by(run, d) from runs))
select strftime(ts, '%Y%m%d') as partition_id, event_type, count(*) as n from events, chosen where strftime(ts, '%Y%m%d') between first and last group by 1, 2"""
)
def refresh_daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type for the newest run of stale days."""
    span = refresh_range(staleness_basic(spark, sf_dir))
    rows = parquet(spark, sf_dir, "events").select(_day().alias("partition_id"), "event_type")
    # `span` is one row.
    within = rows.join(F.broadcast(span), F.col("partition_id").between(F.col("first"), F.col("last")))
    return within.groupBy("partition_id", "event_type").agg(F.count("*").alias("n"))


@query(ORACLES["refresh_daily_event_counts"])
def refresh_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by a refresh that writes a table; the table is read back."""
    path, view = f"{scratch(spark)}/daily", f"events_{uuid.uuid4().hex}"
    parquet(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).createOrReplaceTempView(view)
    counts = f"SELECT day, event_type, count(*) AS n FROM {view} WHERE day BETWEEN :begin AND :end GROUP BY day, event_type"
    try:
        update_partitions(spark, path, _metadata(spark, sf_dir), "daily", ["events"], day_to_day(_span(spark, sf_dir)), counts, partition_id(F.col("day"), "day"), NOW, auto_recreate="replace_if_changed")
    finally:
        spark.catalog.dropTempView(view)
    return table_at(spark, path).read().select("partition_id", "event_type", "n")


@query(
    """with last as (select max(o_orderdate) as d from orders), first as (select strftime(d - interval 1 month, '%Y%m') as m from last)
select strftime(o_orderdate, '%Y%m') as partition_id, count(*) as n, round(sum(o_totalprice), 2) as total, 2 as version, (select count(distinct strftime(o_orderdate, '%Y%m')) from orders where strftime(o_orderdate, '%Y%m') >= (select m from first)) as before
from orders where strftime(o_orderdate, '%Y%m') >= (select m from first) group by 1"""
)
def refresh_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh whose query gives another column: the table begins anew with the refreshed months, and its version
    before can still be read."""
    path, view = f"{scratch(spark)}/monthly", f"orders_{uuid.uuid4().hex}"
    orders = parquet(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    orders.createOrReplaceTempView(view)
    newest = orders.agg(F.max("month")).first()[0]
    months = spark.createDataFrame([((newest.replace(day=1) - timedelta(days=1)).strftime("%Y%m"),), (newest.strftime("%Y%m"),)], "id string")
    aligned = months.select(F.col("id").alias("destination"), F.array("id").alias("sources"))
    meta = months.select(F.lit("orders").alias("table_name"), F.col("id").alias("partition_id"), F.lit(NOW).alias("last_modified"))
    of = lambda columns: f"SELECT month, {columns} FROM {view} WHERE month BETWEEN :begin AND :end GROUP BY month"
    go = lambda columns: update_partitions(spark, path, meta, "monthly", ["orders"], aligned, of(columns), partition_id(F.col("month"), "month"), NOW, auto_recreate="replace_if_changed")
    try:
        go("count(*) AS n")
        go("count(*) AS n, round(sum(o_totalprice), 2) AS total")
    finally:
        spark.catalog.dropTempView(view)
    table = table_at(spark, path)
    found = table.read().select("partition_id", "n", "total", F.lit(table.version().number).cast("int").alias("version"))
    return found.withColumn("before", F.lit(table.read(number=1).select("partition_id").distinct().count()).cast("long"))


@query(
    """with d as (select max(ts)::date as d from events) select 'daily' as dst, 'events' as src, 1 as n_jobs, 0 as depth,
(select count(*) from (select distinct ts::date, event_type from events, d where ts::date >= d - interval 1 day)) as rows"""
)
def refresh_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh notes itself in a log, from which the table's lineage is read."""
    base, view = scratch(spark), f"events_{uuid.uuid4().hex}"
    log = JobLog(spark, f"{base}/log")
    events = parquet(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    events.createOrReplaceTempView(view)
    newest = events.agg(F.max("day")).first()[0]
    span = spark.createDataFrame([(newest - timedelta(days=1), newest)], "first date, last date")
    meta = span.select(F.explode(F.array("first", "last")).alias("d")).select(F.lit("events").alias("table_name"), F.date_format("d", "yyyyMMdd").alias("partition_id"), F.lit(NOW).alias("last_modified"))
    counts = f"SELECT day, event_type, count(*) AS n FROM {view} WHERE day BETWEEN :begin AND :end GROUP BY day, event_type"
    try:
        update_partitions(spark, f"{base}/daily", meta, "daily", ["events"], day_to_day(span), counts, partition_id(F.col("day"), "day"), NOW, log=log, auto_recreate="replace_if_changed")
    finally:
        spark.catalog.dropTempView(view)
    found = edges(log.read()).select("dst", "src", "n_jobs")
    rows = log.read().agg(F.sum("rows").alias("rows"))
    # One row.
    plain = found.join(lineage(edges(log.read())).select("dst", "src", "depth"), ["dst", "src"]).join(F.broadcast(rows))
    return plain.select(F.col("dst.table").alias("dst"), F.regexp_replace("src.table", r"\.parquet$", "").alias("src"), F.col("n_jobs").cast("int").alias("n_jobs"), "depth", "rows")


@query(
    """select * from (values ('open', 'lineitem', 'l_extendedprice,l_orderkey,l_returnflag'), ('open', 'orders', 'o_orderkey,o_orderstatus'), ('o_orderstatus', 'lineitem', 'l_orderkey,l_returnflag'),
('o_orderstatus', 'orders', 'o_orderkey,o_orderstatus')) t(column_name, table_name, fields) join (select 'lineitem' as table_name, count(*) as n_rows from lineitem union all select 'orders', count(*) from orders) using (table_name)"""
)
def column_lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields of which tables make each column of a query, with the rows that their tables have."""
    names = {t: f"{t}_{uuid.uuid4().hex}" for t in ("orders", "lineitem")}
    for t, view in names.items():
        parquet(spark, sf_dir, t).createOrReplaceTempView(view)
    query_text = (
        f"WITH l AS (SELECT l_orderkey AS k, named_struct('price', l_extendedprice, 'tax', l_tax) AS s FROM {names['lineitem']} WHERE l_returnflag = 'N') "
        f"SELECT o_orderstatus, sum(l.s.price) AS open FROM {names['orders']} JOIN l ON l.k = o_orderkey GROUP BY o_orderstatus"
    )
    try:
        log = recorded(spark, "open_orders", query_text, "v1", NOW)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    each = log.select(F.col("column").alias("column_name"), F.regexp_extract("location", r"([^/]*)\.parquet$", 1).alias("table_name"), F.array_join("fields", ",").alias("fields"))
    rows = storage_profile(spark, f"{sf_dir}/lineitem.parquet", "lineitem").unionByName(storage_profile(spark, f"{sf_dir}/orders.parquet", "orders"))
    return each.join(rows.select("table_name", "n_rows"), "table_name")


@query(
    f"""{_META}, n as (select id, lm from src union all select '__ANY__', max(lm) from src)
select 'day' as kind, strftime(d, '%Y%m%d') as partition_id from days join src s on s.id = strftime(d, '%Y%m%d') left join dst on dst.id = s.id where {_BEHIND.format(forced='false')}
union all select 'any', '__NULL__' from (select max(lm) + interval 1 hour as lm from src) dst where exists (select 1 from src s where {_BEHIND.format(forced='false')})"""
)
def staleness_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source day is a table of its own, and the source is all that begin alike."""
    both = _metadata(spark, sf_dir)
    source = both.filter("table_name = 'events'").select(F.concat(F.lit("events_"), "partition_id").alias("table_name"), F.lit(None).cast("string").alias("partition_id"), "last_modified")
    ours = both.filter("table_name = 'daily'")
    whole = source.agg(F.lit("whole").alias("table_name"), F.lit(None).cast("string").alias("partition_id"), (F.max("last_modified") + F.expr("interval 1 hour")).alias("last_modified"))
    days = stale_partitions(source.unionByName(ours), "daily", ["events_*"], day_to_day(_span(spark, sf_dir)), NOW)
    anything = _span(spark, sf_dir).select(F.lit("__NULL__").alias("destination"), F.array(F.lit("__ANY__")).alias("sources"))
    any_of = stale_partitions(source.unionByName(whole), "whole", ["events_*"], anything, NOW)
    return days.select(F.lit("day").alias("kind"), "partition_id").unionByName(any_of.select(F.lit("any").alias("kind"), "partition_id"))


_MONTHS = "select strftime(o_orderdate, '%Y%m') as partition_id, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where {0} group by 1, 2"


@query(f"select * from ({_MONTHS.format('o_orderkey % 10 <> 0')}) where partition_id not between '199601' and '199606' union all select * from ({_MONTHS.format('true')}) where partition_id between '199601' and '199606' and partition_id <> '199603'")
def range_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of a monthly table is replaced; a month without fresh rows is empty after that."""
    orders = parquet(spark, sf_dir, "orders").withColumn("partition_id", partition_id(F.col("o_orderdate"), "month"))
    built = lambda df: df.groupBy("partition_id", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    fresh = built(orders.filter("partition_id between '199601' and '199606' and partition_id <> '199603'"))
    return replace_range(built(orders.filter("o_orderkey % 10 <> 0")), fresh, F.col("partition_id"), "199601", "199606")


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = parquet(spark, sf_dir, "orders").filter(F.month("o_orderdate") % 4 != 0).select(F.lit("orders").alias("table_name"), F.date_format("o_orderdate", "yyyyMM").alias("partition_id"))
    shipped = parquet(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("table_name"), F.date_format("l_shipdate", "yyyyMM").alias("partition_id"))
    return _holed(spark, sf_dir).select(F.lit("events").alias("table_name"), "partition_id").unionByName(months).unionByName(shipped)


_LABELS = """parts as (select distinct 'events' as t, strftime(ts, '%Y%m%d') as id, datediff('day', date '1970-01-01', ts::date) as n from events where day(ts) % 5 <> 0
union select distinct 'orders', strftime(o_orderdate, '%Y%m'), year(o_orderdate) * 12 + month(o_orderdate) from orders where month(o_orderdate) % 4 <> 0
union select distinct 'lineitem', strftime(l_shipdate, '%Y%m'), year(l_shipdate) * 12 + month(l_shipdate) from lineitem),
gapped as (select *, coalesce(lag(n) over (partition by t order by n desc) - n > 1, true) as gap from parts),
labels as (select t as table_name, min(id) as partition_min, max(id) as partition_max, count(*) filter (gap) - 1 as partition_skip from gapped group by t)"""


@query(f"with {_LABELS} select * from labels")
def partition_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_labels(_partitions(spark, sf_dir))


@query(f"with {_LABELS} select 'shipping' as table_name, max(partition_min) as partition_min, min(partition_max) as partition_max, max(partition_skip) as partition_skip from labels where table_name in ('orders', 'lineitem')")
def view_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = partition_labels(_partitions(spark, sf_dir))
    reads = labels.filter(F.col("table_name").isin("orders", "lineitem")).select(F.lit("shipping").alias("view_name"), "table_name")
    return view_labels(labels, reads)


@query(
    f"""with {_LABELS}, new as (select table_name, 'partition-max' as key, partition_max as value from labels union all select table_name, 'partition-min', partition_min from labels),
old as (select 'orders' as table_name, o_orderpriority as key, count(*)::varchar as value from orders group by o_orderpriority union all select 'orders', 'partition-max', 'none')
select coalesce(o.table_name, n.table_name) as table_name, coalesce(o.key, n.key) as key, coalesce(n.value, o.value) as value from old o full join new n on o.table_name = n.table_name and o.key = n.key"""
)
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New labels over those that a table has."""
    labels = partition_labels(_partitions(spark, sf_dir))
    new = labels.select("table_name", F.explode(F.array(F.struct(F.lit("partition-max").alias("key"), F.col("partition_max").alias("value")), F.struct(F.lit("partition-min").alias("key"), F.col("partition_min").alias("value")))).alias("x")).select("table_name", "x.*")
    orders = parquet(spark, sf_dir, "orders")
    old = orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit("orders").alias("table_name"), "key", "value")
    old = old.unionByName(orders.agg(F.lit("orders").alias("table_name"), F.lit("partition-max").alias("key"), F.lit("none").alias("value")))
    return merged_labels(old, new)


T0, T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def _customers(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Three states of the customers: some are missing, added and changed from one to the next."""
    df = parquet(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    if step == 0:
        return df.filter("c_custkey % 23 <> 0")
    changed = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return changed.filter("c_custkey % 17 <> 0") if step == 1 else changed.withColumn("c_name", F.when(F.col("c_custkey") % 29 == 0, F.upper("c_name")).otherwise(F.col("c_name")))


def _fresh(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    return scd2.snapshot(_customers(spark, sf_dir, step), "c_custkey", (T0, T1, T2)[step], f"r{step}")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = scd2.update(_fresh(spark, sf_dir, 0), _fresh(spark, sf_dir, 1), T1)
    return scd2.update(once, _fresh(spark, sf_dir, 2), T2)


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _flat(history: DataFrame) -> DataFrame:
    return history.select("unique_key", "revision_hash", _time("valid_from"), _time("valid_to"), "entity.c_name", "entity.c_acctbal")


_STATES = """s0 as (select c_custkey as k, c_name as n, c_acctbal as b from customer where c_custkey % 23 <> 0),
s1 as (select c_custkey as k, c_name as n, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as b from customer where c_custkey % 17 <> 0),
s2 as (select c_custkey as k, case when c_custkey % 29 = 0 then upper(c_name) else c_name end as n, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as b from customer),
every as (select 0 as i, * from s0 union all select 1, * from s1 union all select 2, * from s2),
begun as (select e.*, p.k is null as fresh from every e left join every p on p.k = e.k and p.i = e.i - 1 and p.n is not distinct from e.n and p.b is not distinct from e.b),
starts as (select * from begun where fresh),
hist as (select s.k, s.n, s.b, s.i, (select min(x.i) from (select 1 as i union all select 2 union all select 3) x where x.i > s.i
    and not exists (select 1 from begun y where y.k = s.k and y.i = x.i and not y.fresh and x.i < 3)) as till from starts s),
history as (select k as unique_key, 'r' || i as revision_hash, ['2024-01-01', '2024-02-01', '2024-03-01'][i + 1] as valid_from,
    case when till < 3 then ['2024-01-01', '2024-02-01', '2024-03-01'][till + 1] end as valid_to, n as c_name, b as c_acctbal from hist)"""


@query("select c_custkey as unique_key, 'r0' as revision_hash, '2024-01-01' as valid_from, null::varchar as valid_to, c_name, c_acctbal from customer where c_custkey % 23 <> 0")
def scd2_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_fresh(spark, sf_dir, 0))


@query(f"with {_STATES} select * from history")
def scd2_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_history(spark, sf_dir))


@query(
    f"""with {_STATES}, both_sides as (select coalesce(a.k, b.k) as k, a.k is null as isnew, b.k is null as gone, a.n as n0, b.n as n1, a.b as b0, b.b as b1 from s0 a full join s1 b on a.k = b.k)
select case when isnew then 'NEW' when gone then 'DELETE' else 'CHANGED' end as action, k as unique_key,
  (case when isnew or gone then 'c_custkey,c_name,c_acctbal' else 'c_acctbal' end) as changed from both_sides where isnew or gone or b0 is distinct from b1"""
)
def scd2_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scd2.diff(_fresh(spark, sf_dir, 0), _fresh(spark, sf_dir, 1))
    return found.select("action", "unique_key", F.array_join(F.col("entity_changes.key"), ",").alias("changed"))


@query(f"with {_STATES} select k as c_custkey, n as c_name, b as c_acctbal from s2")
def scd2_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.latest(_history(spark, sf_dir))


@query(f"with {_STATES} select k as c_custkey, n as c_name, b as c_acctbal from s1")
def scd2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.as_of(_history(spark, sf_dir), "2024-02-10 00:00:00")


@query(f"with {_STATES} select '2024-01-10' as at, k as c_custkey, n as c_name, b as c_acctbal from s0 union all select '2024-02-10', * from s1 union all select null, * from s2")
def scd2_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scd2.timeline(_history(spark, sf_dir), ["2024-01-10 00:00:00", "2024-02-10 00:00:00", None])
    return rows.select(F.date_format("_at", "yyyy-MM-dd").alias("at"), "c_custkey", "c_name", "c_acctbal")


@query(
    f"""with {_STATES}, nexts as (select *, lead(valid_from) over (partition by unique_key order by valid_from) as nxt from history)
select unique_key, count(*) filter (nxt is not null and (valid_to is null or valid_to > nxt)) as n_overlaps, count(*) filter (valid_to < nxt) as n_gaps from nexts group by unique_key"""
)
def scd2_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.validate(_history(spark, sf_dir))


@query(
    f"""with {_STATES} select revision_hash, min(valid_from) as snapshot_at, count(distinct unique_key) as n_keys, count(*) filter (valid_to is null) as n_alive,
  min(datediff('second', valid_from::timestamp, valid_to::timestamp))::bigint as shortest, max(datediff('second', valid_from::timestamp, valid_to::timestamp))::bigint as longest from history group by revision_hash"""
)
def scd2_monitor_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scd2.monitor_revisions(_history(spark, sf_dir), exact=True)
    q = F.col("lifetime_quartiles")
    return rows.select("revision_hash", _time("snapshot_at"), "n_keys", "n_alive", F.get(q, F.lit(0)).alias("shortest"), F.get(q, F.lit(4)).alias("longest"))


@query(f"with {_STATES} select unique_key, min(valid_from) as first_changed_at, max(valid_from) as last_changed_at, count(distinct revision_hash) as n_revisions from history group by unique_key")
def scd2_monitor_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.monitor_entities(_history(spark, sf_dir), exact=True).select("unique_key", _time("first_changed_at"), _time("last_changed_at"), "n_revisions")


@query(f"with {_STATES} select coalesce(p.k, o.k) as c_custkey, case when p.k is null then o.n else p.n end as c_name, case when p.k is null then o.b else p.b end as c_acctbal from s0 o full join (select * from s1 where k % 3 = 0) p on p.k = o.k")
def scd2_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.overlay(_fresh(spark, sf_dir, 0), _fresh(spark, sf_dir, 1).filter("unique_key % 3 = 0"))


@query(f"with {_STATES} select unique_key, revision_hash, valid_from, coalesce(lead(valid_from) over (partition by unique_key order by valid_from), valid_to) as valid_to, c_name, c_acctbal from history")
def scd2_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history whose rows were cut in two is whole once repaired; what was deleted for a while counts as there."""
    history = _history(spark, sf_dir)
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp")
    cut = (F.col("valid_from") < middle) & (F.coalesce(F.col("valid_to"), F.lit("9999-01-01").cast("timestamp")) > middle)
    halves = F.when(cut, F.array(F.struct("valid_from", middle.alias("valid_to")), F.struct(middle.alias("valid_from"), "valid_to"))).otherwise(F.array(F.struct("valid_from", "valid_to")))
    broken = history.withColumn("_h", F.explode(halves)).select("unique_key", "revision_hash", F.col("_h.valid_from").alias("valid_from"), F.col("_h.valid_to").alias("valid_to"), "entity")
    return _flat(scd2.reconstruct(broken))


def _table(spark: SparkSession, sf_dir: str, steps: int = 3) -> scd2.HistoryTable:
    """A history that is stored, of the first states."""
    ids, times = iter(f"r{i}" for i in range(steps + 1)), iter(datetime.fromisoformat(t) for t in (T0, T1, T2, T2))
    table = scd2.HistoryTable(spark, f"{scratch(spark)}/history", "c_custkey", clock=lambda: next(times), new_id=lambda: next(ids))
    table.init(_customers(spark, sf_dir, 0))
    for step in range(1, steps):
        table.update(_customers(spark, sf_dir, step))
    return table


@query(f"with {_STATES} select * from history")
def scd2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a table that two updates have written."""
    return _flat(_table(spark, sf_dir).read())


@query(f"with {_STATES} select k as c_custkey, n as c_name, b as c_acctbal from s1")
def scd2_table_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state, from the partitions that end later."""
    return _table(spark, sf_dir).as_of("2024-02-10 00:00:00")


@query(
    f"""with {_STATES} select 'old' as place, k as unique_key, '2024-01-01' as valid_from, null::varchar as valid_to, n as c_name from s0
union all select 'new', k, '2024-02-01', null, n from s1"""
)
def scd2_begin_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other columns: the history of the first state is kept under another name, and one of the second begins."""
    table = _table(spark, sf_dir, steps=1)
    table.update(_customers(spark, sf_dir, 1).withColumn("more", F.lit(1)), on_other_columns="recreate")
    old = table.backup(datetime.fromisoformat(T1)).read()
    flat = lambda df, place: df.select(F.lit(place).alias("place"), "unique_key", _time("valid_from"), _time("valid_to"), "entity.c_name")
    return flat(old, "old").unionByName(flat(table.read(), "new"))


def _suppliers(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    df = parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return df.filter("s_suppkey % 11 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 0, F.lower("s_name")).otherwise(F.col("s_name"))) if changed else df


def _golden(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    store = scd2.snapshot(_suppliers(spark, sf_dir, False), "s_suppkey", T0, "golden")
    return scd2.diff(store, scd2.snapshot(_suppliers(spark, sf_dir, changed), "s_suppkey", T1, "now"))


@query("select count(*) as n_differences from supplier a full join supplier b using (s_suppkey) where a.s_name is distinct from b.s_name or a.s_acctbal is distinct from b.s_acctbal")
def golden_diff_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir, False).agg(F.count("*").alias("n_differences"))


@query("select case when s_suppkey % 11 = 0 then 'DELETE' else 'CHANGED' end as action, s_suppkey as unique_key from supplier where s_suppkey % 11 = 0 or (s_suppkey % 4 = 0 and lower(s_name) <> s_name)")
def golden_diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir, True).select("action", "unique_key")


_UNIQUE = "select 'unique' as group_name, 'unique: l_orderkey, l_linenumber = ' || l_orderkey || ', ' || l_linenumber as name, count(*)::varchar as actual, '1' as expected from lineitem group by l_orderkey, l_linenumber"
_NONNULL = """select 'nonnull' as group_name, 'non-null: ' || c || ' [' || printf('%4.1f', 100.0 * n / total) || '%]' as name, n::varchar as actual, '0' as expected
from (select 'l_returnflag' as c, count(*) filter (l_returnflag = 'R') as n, count(*) as total from lineitem union all select 'l_tax', count(*) filter (l_tax is null), count(*) from lineitem)"""
_ACCEPTED = """select 'accepted_values' as group_name, 'accepted values: l_linestatus' as name,
'surplus (' || coalesce(string_agg(v, ', ' order by v) filter (v not in ('F', 'X')), '') || '), missing (' || case when count(*) filter (v = 'F') = 0 then 'F, X' else 'X' end || ')' as actual,
'surplus (), missing ()' as expected from (select distinct l_linestatus as v from lineitem where l_linestatus is not null)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))


@query(_UNIQUE)
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique_cases(_items(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query(_NONNULL)
def check_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.nonnull_cases(_items(spark, sf_dir), ["l_returnflag", "l_tax"])


@query(_ACCEPTED)
def check_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.accepted_cases(_items(spark, sf_dir), "l_linestatus", ["F", "X"])


@query(
    f"""with cases as ({_UNIQUE} union all {_NONNULL} union all {_ACCEPTED}), failed as (select *, row_number() over (partition by group_name order by name) as i from cases where actual <> expected),
errors as (select group_name, string_agg(e, ' | ' order by e) as errors from (select group_name, name || '; Expected ' || expected || ' but actual is ' || actual as e from failed where i <= 20) group by group_name)
select 'lineitem' as target_table, c.group_name, count(*) as n_cases, count(*) filter (actual = expected) as n_cases_passed, count(*) filter (actual <> expected) as n_cases_failed, coalesce(any_value(e.errors), '') as errors
from cases c left join errors e using (group_name) group by c.group_name"""
)
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.spec({"lineitem": _items(spark, sf_dir)}, {"lineitem": {"unique": [["l_orderkey", "l_linenumber"]], "nonnull": ["l_returnflag", "l_tax"], "accepted": {"l_linestatus": ["F", "X"]}}})
    return found.withColumn("errors", F.array_join("errors", " | "))


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query(
    """select null::varchar as partition_key, null::varchar as group_keys, count(*) as count, count(o_custkey) as o_custkey__nonnull, count(distinct o_custkey) as o_custkey__unique, sum(o_custkey)::bigint as o_custkey__sum,
round(sum(o_custkey::double * o_custkey::double), 2) as o_custkey__sum2, round(avg(o_custkey), 2) as o_custkey__avg, min(o_custkey) as o_custkey__min, max(o_custkey) as o_custkey__max,
count(o_totalprice) as o_totalprice__nonnull, round(sum(o_totalprice), 2) as o_totalprice__sum, round(avg(o_totalprice), 2) as o_totalprice__avg, round(min(o_totalprice), 2) as o_totalprice__min, round(max(o_totalprice), 2) as o_totalprice__max from orders"""
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.profile(parquet(spark, sf_dir, "orders"), columns=["o_custkey", "o_totalprice"], exact=True))


@query(
    """select null::varchar as partition_key, null::varchar as group_keys, count(*) as count, count(p_name) as p_name__nonnull, count(distinct p_name) as p_name__unique, round(avg(length(p_name)), 2) as p_name__avg_len,
min(length(p_name))::int as p_name__min_len, max(length(p_name))::int as p_name__max_len, count(p_type) as p_type__nonnull, count(distinct p_type) as p_type__unique, round(avg(length(p_type)), 2) as p_type__avg_len,
min(length(p_type))::int as p_type__min_len, max(length(p_type))::int as p_type__max_len from part"""
)
def profile_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.profile(parquet(spark, sf_dir, "part"), columns=["p_name", "p_type"], exact=True))


@query(
    """select strftime(o_orderdate, '%Y') as partition_key, null::varchar as group_keys, count(*) as count, count(o_orderdate) as o_orderdate__nonnull,
strftime(min(o_orderdate), '%Y-%m-%d') as o_orderdate__min, strftime(max(o_orderdate), '%Y-%m-%d') as o_orderdate__max from orders group by 1"""
)
def profile_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.profile(parquet(spark, sf_dir, "orders"), partition=F.date_format("o_orderdate", "yyyy"), columns=["o_orderdate"], exact=True)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("o_orderdate__min", "o_orderdate__max")})


@query(
    """select null::varchar as partition_key, '{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}' as group_keys, count(*) as count, count(l_quantity) as l_quantity__nonnull, round(sum(l_quantity), 2) as l_quantity__sum,
round(avg(l_quantity), 2) as l_quantity__avg, round(min(l_quantity), 2) as l_quantity__min, round(max(l_quantity), 2) as l_quantity__max from lineitem group by l_returnflag, l_linestatus"""
)
def profile_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.profile(parquet(spark, sf_dir, "lineitem"), group_by=["l_returnflag", "l_linestatus"], columns=["l_quantity"], exact=True))


@query(
    """with q as (select quantile_disc(l_extendedprice, 0.25) as a, quantile_disc(l_extendedprice, 0.75) as b, count(*) as n from lineitem), s as (select a - 1.5 * (b - a) as base, (b - a) / 5 as step, n from q),
put as (select greatest(0, least(21, floor((l_extendedprice - base) / step) + 1))::int as bucket, base, step, n from lineitem, s)
select bucket, round(case when bucket > 0 then base + step * (bucket - 1) else -1e308 end, 4) as low, round(case when bucket <= 20 then base + step * bucket else 1e308 end, 4) as high, count(*) as count, round(count(*) / n, 4) as ratio from put group by bucket, base, step, n"""
)
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.histogram(parquet(spark, sf_dir, "lineitem"), "l_extendedprice", exact=True)
    finite = lambda c: F.round(F.greatest(F.lit(-1e308), F.least(F.lit(1e308), F.col(c))), 4).alias(c)
    return df.select("bucket", finite("low"), finite("high"), "count", "ratio")


@query(
    """with c as (select l_returnflag, l_quantity as value, count(*) as count from lineitem group by all), r as (select *, row_number() over (partition by l_returnflag order by count desc, value) as i from c)
select null::varchar as partition_key, '{"l_returnflag":"' || l_returnflag || '"}' as group_keys, value, count from r where i <= 5"""
)
def profile_top_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_count(parquet(spark, sf_dir, "lineitem"), "l_quantity", group_by=["l_returnflag"])


_PICKS = "[0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]"


@query(
    f"""with q as (select l_returnflag, quantile_disc(l_extendedprice, {_PICKS}) as v from lineitem group by l_returnflag)
select null::varchar as partition_key, '{{"l_returnflag":"' || l_returnflag || '"}}' as group_keys, unnest([0.0, 1.0, 10.0, 25.0, 50.0, 75.0, 90.0, 99.0, 100.0])::double as key, round(unnest(v), 6) as value from q"""
)
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quantiles(parquet(spark, sf_dir, "lineitem"), "l_extendedprice", group_by=["l_returnflag"], exact=True)


@query(
    """with c as (select l_returnflag as g, l_linenumber as v, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by g order by n desc, v::varchar) as i from c), tops as (select g, string_agg(v || ':' || n, ',' order by i) as top_count from r where i <= 5 group by g),
q as (select l_returnflag as g, quantile_disc(l_linenumber, [0.0, 0.5, 1.0]) as q, quantile_disc(l_linenumber, 0.25) as a, quantile_disc(l_linenumber, 0.75) as b, count(*) as count from lineitem group by 1),
put as (select g, greatest(0, least(21, floor((v - (a - 1.5 * (b - a))) / ((b - a) / 5.0)) + 1))::int as bucket, sum(c.n) as n from c join q using (g) group by 1, 2),
bars as (select g, string_agg(bucket || ':' || n::bigint, ',' order by bucket) as histogram from put group by g)
select '{"l_returnflag":"' || g || '"}' as group_keys, count, top_count, q[1]::double as least, q[2]::double as median, q[3]::double as most, histogram from q join tops using (g) join bars using (g)"""
)
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each group, with its most frequent values, quantiles and histogram."""
    rows = profile.full(parquet(spark, sf_dir, "lineitem"), group_by=["l_returnflag"], columns=["l_linenumber"], exact=True)
    shown = lambda c, a: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x["count"].cast("string"))), ",")
    at = lambda i: F.col("l_linenumber__quantiles")[i]["value"]
    return rows.select("group_keys", "count", shown("l_linenumber__top_count", "value").alias("top_count"), at(0).alias("least"), at(4).alias("median"), at(8).alias("most"), shown("l_linenumber__histogram", "bucket").alias("histogram"))


@query(
    """select count(*) as count, count(l_linenumber) as l_linenumber__nonnull, sum(l_linenumber)::bigint as l_linenumber__sum, round(sum(l_linenumber::double * l_linenumber), 2) as l_linenumber__sum2, round(avg(l_linenumber), 2) as l_linenumber__avg,
min(l_linenumber) as l_linenumber__min, max(l_linenumber) as l_linenumber__max, count(distinct l_linenumber) as l_linenumber__unique from lineitem"""
)
def profile_partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of months, with sketches, merged into one."""
    months = profile.profile(parquet(spark, sf_dir, "lineitem"), partition=F.date_format("l_shipdate", "yyyyMM"), columns=["l_linenumber"], sketches=True)
    out = profile.merge(months)
    out = out.drop(*[c for c in out.columns if c.endswith(("__hll", "__kll", "__top")) or "__sum2_limb" in c])
    return _rounded(out.withColumn("l_linenumber__unique", F.col("l_linenumber__unique").cast("long")))


@query(
    """with q as (select unnest([0.0, 1.0, 10.0, 25.0, 50.0, 75.0, 90.0, 99.0, 100.0]) as key), n as (select count(*) as n, count(distinct l_returnflag) as flags from lineitem)
select key, n, true as within_one_percent from q, n"""
)
def profile_merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches of months that were merged: each has the rank that it should, by a count of all rows, within one percent."""
    table = parquet(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    months = profile.profile(table, partition=F.date_format("l_shipdate", "yyyyMM"), columns=["l_extendedprice"], sketches=True)
    points = profile.shown(profile.merge(months)).select(F.explode("l_extendedprice__quantiles").alias("q")).select("q.*")
    # Nine points.
    beside = table.select("l_extendedprice").join(F.broadcast(points))
    ranks = beside.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") < F.col("value")).alias("below"), F.count_if(F.col("l_extendedprice") <= F.col("value")).alias("up_to"))
    wanted = F.col("key") / 100 * F.col("n")
    near = (F.col("below") - 0.01 * F.col("n") <= wanted) & (wanted <= F.col("up_to") + 0.01 * F.col("n"))
    return ranks.select("key", "n", near.alias("within_one_percent"))


@query(
    """with c as (select l_returnflag as value, count(*) as count from lineitem group by 1 union all select l_linenumber::varchar, count(*) from lineitem where l_linenumber is not null group by 1)
select case when value in ('A', 'N', 'R') then 'l_returnflag' else 'l_linenumber' end as column_name, value, count from
  (select *, row_number() over (partition by value in ('A', 'N', 'R') order by count desc, value) as i from c) where value in ('A', 'N', 'R') or i <= 7"""
)
def profile_merged_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent values from sketches of months that were merged."""
    months = profile.profile(parquet(spark, sf_dir, "lineitem"), partition=F.date_format("l_shipdate", "yyyyMM"), columns=["l_returnflag", "l_linenumber"], sketches=True)
    found = profile.shown(profile.merge(months), top_numbers=7)
    of = lambda c: found.select(F.lit(c).alias("column_name"), F.explode(f"{c}__top_count").alias("x")).select("column_name", "x.value", "x.count")
    return of("l_returnflag").unionByName(of("l_linenumber"))


def _event_days(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Events by day; changed, those of one day are ten times as large."""
    events = parquet(spark, sf_dir, "events").select("user_id", "value", F.date_format("ts", "yyyyMMdd").alias("day"))
    newest = events.agg(F.max("day")).first()[0]
    return events.filter(F.col("day") == newest).withColumn("user_id", F.col("user_id") * 10) if changed else events


@query(
    """with e as (select case when strftime(ts, '%Y%m%d') = (select max(strftime(ts, '%Y%m%d')) from events) then user_id * 10 else user_id end as user_id from events)
select count(*) as count, sum(user_id)::bigint as total, sum(user_id::hugeint * user_id)::varchar as squares, min(user_id) as least, max(user_id) as most, 1 as days_profiled from e"""
)
def profile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored profile of all days, brought up to date after one day has changed; only that day is profiled again."""
    base = scratch(spark)
    source, kept = Published(spark, f"{base}/events", "day"), StoredProfile(spark, f"{base}/profile", "day", ["user_id"])
    source.publish(source.stage(_event_days(spark, sf_dir, False)))
    kept.refresh(source.read(), source.metadata("events"))
    draft = source.stage(_event_days(spark, sf_dir, True))
    days = {f.key for f in draft.version.folders}
    source.publish(draft, keep=lambda day: day not in days)
    again = kept.refresh(source.read(), source.metadata("events"))
    out = kept.merged()
    return out.select("count", F.col("user_id__sum").alias("total"), F.col("user_id__sum2_exact").alias("squares"), F.col("user_id__min").alias("least"), F.col("user_id__max").alias("most"), F.lit(len(again)).alias("days_profiled"))


@query("select 'orders' as table_name, o_orderstatus as partition_id, count(*) as n_rows from orders group by 2")
def storage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each partition from the footers of its files."""
    path = f"{scratch(spark)}/orders"
    parquet(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return storage_profile(spark, path, "orders", "o_orderstatus").select("table_name", "partition_id", "n_rows")


def _jobs(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    """A job log made of the events: each is a job that reads one table and writes another."""
    ms = (F.col("event_id") % 997).cast("long")
    statement = F.when(F.col("event_id") % 5 == 4, "CALL").otherwise("MERGE")
    others = [F.col("event_type").alias("query"), statement.alias("statement_type"), *[ms.alias(c) for c in ("processed_ms", "wait_ms", "slot_ms")]] if more else []
    node = lambda n: F.struct(F.lit("p").alias("project"), F.concat(F.lit("d"), F.floor(n / 4).cast("string")).alias("dataset"), F.concat(F.lit("t"), n.cast("string")).alias("table"))
    n = F.col("user_id") % 7
    return parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.lit("DONE").alias("state"),
        F.when(F.col("event_id") % 13 == 0, "failed").alias("error"),
        F.col("ts").cast("timestamp").alias("created"),
        F.col("user_id").alias("user"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"),
        node(n).alias("destination"),
        F.array(node(n + 1 + F.col("event_id") % 2)).alias("referenced"),
        *others,
    )


_JOBS = "jobs as (select user_id % 7 as d, user_id % 7 + 1 + event_id % 2 as s, user_id, ts, floor(value * 100)::bigint as bytes from events where event_id % 13 <> 0 and ts >= (select max(ts) - interval 30 day from events))"


@query(f"with {_JOBS} select 't' || d as dst, 't' || s as src, count(*) as n_jobs, count(distinct user_id) as n_users, sum(bytes)::bigint as total_bytes from jobs group by d, s")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(_jobs(spark, sf_dir)).select(F.col("dst.table").alias("dst"), F.col("src.table").alias("src"), "n_jobs", "n_users", "total_bytes")


@query(
    f"""with {_JOBS.replace("as bytes from", "as bytes, event_type as query, event_id % 5 as kind, event_id % 997 as ms from")}, kept as (select * from jobs where kind <> 4),
weights as (select d, s, query, sum(epoch(ts)::bigint) as w from kept group by d, s, query), top as (select d, s, query, row_number() over (partition by d, s order by w desc, query desc) as i from weights),
rest as (select d, s, count(distinct query) as n_queries, sum(ms)::bigint as slot_ms, quantile_disc(ms, [0.0, 0.5, 1.0]) as q from kept group by d, s)
select 't' || d as dst, 't' || s as src, query, n_queries, slot_ms, q[1] as fastest, q[2] as median, q[3] as slowest from rest join top using (d, s) where i = 1"""
)
def lineage_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each edge, the query that made it most and lately, and deciles of time; one kind of statement makes none."""
    log = _jobs(spark, sf_dir, more=True)
    rows = attributes(log, exact=True)
    q = F.col("processed_ms__quantiles")
    return rows.select(F.col("dst.table").alias("dst"), F.col("src.table").alias("src"), "query", "n_queries", "slot_ms", q[0].alias("fastest"), q[5].alias("median"), q[10].alias("slowest"))


_LINEAGE = f"""with recursive {_JOBS}, e as (select distinct d, s from jobs),
walk as (select d as root, 0 as depth, d, s from e union all select w.root, w.depth + 1, e.d, e.s from walk w join e on e.d = w.s where w.d // 4 = w.s // 4),
compact as (select root, d, s, max(depth) as depth from walk group by root, d, s),
far as (select a.root, b.d, b.s, max(a.depth + 1 + b.depth) as depth from compact a join compact b on b.root = a.s where a.d // 4 <> a.s // 4 group by a.root, b.d, b.s),
lines as (select root, d, s, max(depth) as depth from (select * from compact union all select * from far) group by root, d, s)"""


@query(f"{_LINEAGE} select 'p.d' || (root // 4) || '.t' || root as destination, depth, 't' || d as dst, 't' || s as src from lines")
def lineage_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage(edges(_jobs(spark, sf_dir)))
    return rows.select("destination", "depth", F.col("dst.table").alias("dst"), F.col("src.table").alias("src"))


@query(
    f"""{_LINEAGE}, names as (select distinct n, 'p.d' || (n // 4) || '.t' || n as name from (select unnest([d, s]) as n from lines)),
ids as (select n, substr(base64(unhex(md5(name))), 1, 4) as id from names),
boxes as (select n // 4 as ds, string_agg(chr(9) || id || '(fa:fa-table t' || n || ')', chr(10) order by chr(9) || id || '(fa:fa-table t' || n || ')') as boxes from ids group by 1),
sets as (select 'subgraph "fa:fa-database d' || ds || '"' || chr(10) || boxes || chr(10) || 'end' as box from boxes),
arrows as (select distinct b.id || ' --> ' || a.id as arrow from lines l join ids a on a.n = l.d join ids b on b.n = l.s)
select 'graph LR' || chr(10) || (select string_agg(box, chr(10) order by box) from sets) || chr(10) || (select string_agg(arrow, chr(10) order by arrow) from arrows) as diagram"""
)
def lineage_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mermaid(lineage(edges(_jobs(spark, sf_dir))), "p")


@query("select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events")
def json_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_entries(parquet(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query("with q as (select o_orderpriority, quantile_disc(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) as v from orders group by 1) select o_orderpriority, unnest([0.0, 50.0, 100.0])::double as key, round(unnest([v[1], v[3], v[5]]), 1) as value from q")
def quantile_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", F.array(*[F.lit(x / 4) for x in range(5)]), 1_000_000).alias("q"))
    return points.select("o_orderpriority", F.explode(format_quantiles(F.col("q"), [0, 2, 4], 1)).alias("x")).select("o_orderpriority", "x.*")


@query("select o_orderkey, 'status' as key, o_orderstatus as value from orders union all select o_orderkey, 'priority', o_orderpriority from orders")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('[STRUCT("status", "%s"), STRUCT("priority", "%s")]', "o_orderstatus", "o_orderpriority")
    return parquet(spark, sf_dir, "orders").select("o_orderkey", F.explode(parse_labels(text)).alias("x")).select("o_orderkey", "x.*")


@query("select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_custkey from orders")
def sure_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parquet(spark, sf_dir, "orders")
    return df.select(
        sure_nonnull(F.col("o_orderkey")).alias("o_orderkey"),
        sure_values(F.col("o_orderstatus"), ["O", "F", "P"]).alias("o_orderstatus"),
        sure_range(F.col("o_totalprice"), 0).alias("o_totalprice"),
        sure_like(F.col("o_orderpriority"), "_-%").alias("o_orderpriority"),
        sure_eq(F.col("o_custkey"), F.col("o_custkey") + 0).alias("o_custkey"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a refresh writes for the newest stale days."""
    return refresh_daily_event_counts(spark, sf_dir)
