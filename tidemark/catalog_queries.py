"""Registered queries over tables of the catalog, partitioned folders, stored results and files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import TableRef
from tidemark.operators import checks, scd2
from tidemark.operators.alignment import day_to_day
from tidemark.operators.labels import update_labels
from tidemark.operators.staleness import detect_staleness
from tidemark.plans.lineage import edges
from tidemark.queries import _BEHIND, _LABELS, _META, _STATES, NOW, T0, T1, _jobs, _metadata, _span, _suppliers, _table, query
from tidemark.sources import catalog
from tidemark.sources.tables import dataset_profile, parquet, sampled_blocks, scratch, shards, storage_profile


def _kept(df: DataFrame) -> DataFrame:
    """A result in files of the shared folder, for a database that goes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(f"{_META} select strftime(d, '%Y%m%d') as partition_id, row_number() over (order by d)::int as place from days join src s on s.id = strftime(d, '%Y%m%d') left join dst on dst.id = s.id where {_BEHIND.format(forced='false')}")
def staleness_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stale partitions as the caller gets them, in order."""
    ids = detect_staleness(_metadata(spark, sf_dir), "daily", ["events"], day_to_day(_span(spark, sf_dir)), NOW) or []
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "partition_id string, place int")


@query("select strftime(ts, '%Y%m%d') as table_suffix, count(*) as n from events where ts::date between (select max(ts)::date - 40 from events) and (select max(ts)::date - 3 from events) group by 1")
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each day, read as one for a range of days."""
    folder, events = scratch(spark), parquet(spark, sf_dir, "events")
    events.withColumn("log", F.date_format("ts", "yyyyMMdd")).write.partitionBy("log").parquet(folder)
    ends = events.agg(F.date_format(F.date_sub(F.max("ts"), 40), "yyyyMMdd"), F.date_format(F.date_sub(F.max("ts"), 3), "yyyyMMdd")).first()
    return shards(spark, folder, "log=", *ends).groupBy("table_suffix").agg(F.count("*").alias("n"))


@query(
    f"""with {_LABELS} select 'monthly' as table_name, partition_min, partition_max, partition_skip from labels where table_name = 'orders' union all
select 'shipped', partition_min, partition_max, partition_skip from labels where table_name = 'lineitem' union all
select 'both', max(partition_min), min(partition_max), max(partition_skip) from labels where table_name in ('orders', 'lineitem')"""
)
def label_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tables of the catalog by their partitions, and of a view on a view by what it reads."""
    orders = parquet(spark, sf_dir, "orders").filter(F.month("o_orderdate") % 4 != 0).select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("p")).dropDuplicates(["p"])
    shipped = parquet(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyyMM").alias("p")).dropDuplicates(["p"])
    with catalog.temporary_database(spark) as name:
        orders.write.partitionBy("p").saveAsTable(f"{name}.monthly")
        shipped.write.partitionBy("p").saveAsTable(f"{name}.shipped")
        spark.sql(f"CREATE VIEW {name}.both AS SELECT p FROM {name}.monthly JOIN {name}.shipped USING (p)")
        found = update_labels(spark, name)
    rows = [(t, v["partition-min"], v["partition-max"], int(v["partition-skip"])) for t, v in found.items()]
    return spark.createDataFrame(rows, "table_name string, partition_min string, partition_max string, partition_skip long")


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, 'x' as team, 'o_orderstatus' as partition_column, (select count(*) from orders) as before from orders where o_orderkey % 2 = 0 group by 1")
def catalog_recreation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalog in whose place another one comes: its layout and labels stay, and it is kept as a backup."""
    orders = parquet(spark, sf_dir, "orders")
    with catalog.temporary_database(spark) as name:
        ref, old = TableRef(name, "t"), TableRef(name, "t_old")
        orders.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").saveAsTable(f"{name}.t")
        catalog.set_labels(spark, ref, {"team": "x"})
        catalog.recreate(spark, ref, orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus"), old)
        totals = spark.table(str(ref)).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        about = [catalog.labels(spark, ref)["team"], catalog.partition_columns(spark, ref)[0][0], spark.table(str(old)).count()]
        return _kept(totals.select("*", *[F.lit(v).alias(c) for c, v in zip(("team", "partition_column", "before"), about, strict=True)]))


@query(
    """with s as (select s_suppkey, s_name from supplier)
select s_suppkey, 'upper(s_name)' as signature, '{"v":"' || upper(s_name) || '"}' as result from s union all select s_suppkey, 'length(s_name)', '{"v":' || length(s_name) || '}' from s
union all select s_suppkey, 'reverse(s_name)', 'kept' from s where s_suppkey % 3 = 0"""
)
def outcomes_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions over every row of a table, beside stored results: fresh ones win, others stay."""
    suppliers = parquet(spark, sf_dir, "supplier")
    stored = suppliers.select("s_suppkey", F.lit("upper(s_name)").alias("signature"), F.lit("old").alias("result")).unionByName(
        suppliers.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("reverse(s_name)").alias("signature"), F.lit("kept").alias("result"))
    )
    return checks.outcomes(suppliers, ["upper(s_name)", "length(s_name)"], stored, key=["s_suppkey"])


@query("select c_mktsegment as segment, count(*) as n, round(sum(o_totalprice), 2) as total from (select * from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0) join customer on c_custkey = o_custkey group by 1")
def remade_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of named stages, of which one is replaced by other rows."""
    orders = parquet(spark, sf_dir, "orders")
    stages = {
        "orders": lambda _: orders,
        "finished": lambda b: b["orders"].filter("o_orderstatus = 'F'"),
        "with_customer": lambda b: b["finished"].join(parquet(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")),
        "totals": lambda b: b["with_customer"].groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    }
    return checks.remade(stages, "totals", {"orders": orders.filter("o_orderkey % 5 = 0")})


@query(
    """select 'orders' as target_table, bool_and(n = 1) as passed from (select count(*) as n from orders group by o_orderkey) union all
select 'lineitem', (select bool_and(n = 1) from (select count(*) as n from lineitem group by l_orderkey)) and (select count(*) = count(l_linenumber) from lineitem)"""
)
def checks_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all checks of each table passed."""
    tables = {t: parquet(spark, sf_dir, t) for t in ("orders", "lineitem")}
    return checks.passed(checks.spec(tables, {"orders": {"unique": [["o_orderkey"]]}, "lineitem": {"unique": [["l_orderkey"]], "nonnull": ["l_linenumber"]}}))


@query("select 'events' as table_name, strftime(ts, '%Y%m%d') as partition_id, count(*) as n_rows, 'ACTIVE' as storage_tier from events where ts::date > date '2024-03-01' - 40 group by 2")
def dataset_profile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the days of a table that are not too old, and how they are kept."""
    path = f"{scratch(spark)}/events"
    parquet(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")).write.partitionBy("day").parquet(path)
    found = dataset_profile(storage_profile(spark, path, "events", "day"), datetime(2024, 3, 1), days=40)
    return found.select("table_name", "partition_id", "n_rows", "storage_tier")


@query("select 'all' as what, count(*) as n from orders union all select 'none', 0 union all select 'of 30 percent not in 60', 0")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of whole files: a larger one has the files of a smaller."""
    path = f"{scratch(spark)}/orders"
    parquet(spark, sf_dir, "orders").repartition(24, "o_orderkey").write.parquet(path)
    of = lambda percent: sampled_blocks(spark, path, percent, seed=3).select("o_orderkey")
    rows = {"all": of(100), "none": of(0), "of 30 percent not in 60": of(30).join(of(60), "o_orderkey", "left_anti")}
    counts = [df.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, df in rows.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"with {_STATES} select 'as of' as how, k as c_custkey, n as c_name, b as c_acctbal from s1 union all select 'now', k, n, b from s2")
def scd2_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history by SQL: its view of current rows, and its table function of an instant."""
    name = f"history_{uuid.uuid4().hex}"
    _table(spark, sf_dir).views(name)
    columns = "c_custkey, c_name, c_acctbal"
    return spark.sql(f"SELECT 'as of' AS how, {columns} FROM {name}__as_of(timestamp '2024-02-10 00:00:00') UNION ALL SELECT 'now', {columns} FROM {name}")


@query(
    """with s as (select s_suppkey as k, s_name as n, s_acctbal as b from supplier), f as (select k, case when k % 4 = 0 then lower(n) else n end as n, case when k % 6 = 0 then null else b end as b from s where k % 11 <> 0)
select 'CHANGED' as action, count(*) as n from s join f using (k) where s.n is distinct from f.n or s.b is distinct from f.b union all select 'DELETE', count(*) from s where k % 11 = 0"""
)
def golden_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from a stored result, of rows that come in another order and with nulls."""
    times = iter(datetime.fromisoformat(t) for t in (T0, T1))
    store = scd2.HistoryTable(spark, f"{scratch(spark)}/golden", "s_suppkey", clock=lambda: next(times))
    scd2.assert_golden(store, _suppliers(spark, sf_dir, False))
    fresh = _suppliers(spark, sf_dir, True).withColumn("s_acctbal", F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal"))).orderBy(F.desc("s_suppkey"))
    found = scd2.diff(store.current(), scd2.snapshot(fresh, "s_suppkey", T1, "check"))
    return found.groupBy("action").agg(F.count("*").alias("n"))


@query(
    """with jobs as (select user_id % 7 as d, case when event_id % 3 <> 0 then user_id % 7 + 1 + event_id % 2 end as s, user_id from events where event_id % 13 <> 0 and ts >= (select max(ts) - interval 30 day from events))
select 't' || d as dst, 't' || s as src, count(*) as n_jobs, count(distinct user_id) as n_users from jobs group by d, s"""
)
def lineage_edges_of_all_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that read no table have an edge without a source."""
    log = _jobs(spark, sf_dir)
    found = log.withColumn("referenced", F.when(F.col("job_id") % 3 != 0, F.col("referenced")).otherwise(F.filter("referenced", lambda _: F.lit(False))))
    return edges(found).select(F.col("dst.table").alias("dst"), F.col("src.table").alias("src"), "n_jobs", "n_users")


@query(
    """select view_name, table_name, n_rows from (values ('late', 'o'), ('late_lines', 'o'), ('late_lines', 'l')) t(view_name, table_name)
join (select 'o' as table_name, count(*) as n_rows from orders union all select 'l', count(*) from lineitem) using (table_name)"""
)
def view_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that views read, through views too, with the rows that they have."""
    with catalog.temporary_database(spark) as name:
        parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").write.saveAsTable(f"{name}.o")
        parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").write.saveAsTable(f"{name}.l")
        spark.sql(f"CREATE VIEW {name}.late AS SELECT * FROM {name}.o WHERE o_orderdate > '1997-01-01'")
        spark.sql(f"CREATE VIEW {name}.late_lines AS SELECT l.* FROM {name}.l JOIN {name}.late ON l_orderkey = o_orderkey")
        reads = catalog.dependencies(spark, name).collect()
        rows = {t: spark.table(f"{name}.{t}").count() for t in ("o", "l")}
    return spark.createDataFrame([(r["view_name"], r["table_name"], rows[r["table_name"]]) for r in reads], "view_name string, table_name string, n_rows long")
