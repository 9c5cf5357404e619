"""Lineage of tables from a log of jobs, and its diagram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.catalog import description, set_description
from tidemark.sources.tables import scratch

NODE = "struct<project:string,dataset:string,table:string>"
USER = "(User)"

#: Markers of the diagram within a description.
BEGIN, END = "<!--- LINEAGE: BEGIN -->", "<!--- LINEAGE: END -->"


def shard_family(table: Column) -> Column:
    """Tables whose name ends in a date as one family."""
    return F.regexp_replace(table, r"\d{8}$", "*")


#: Kinds of statements that make an edge.
STATEMENTS = (
    "ALTER_TABLE ALTER_VIEW ASSERT CREATE_CLONE_TABLE CREATE_MATERIALIZED_VIEW CREATE_MODEL CREATE_SNAPSHOT_TABLE CREATE_TABLE CREATE_TABLE_AS_SELECT CREATE_VIEW DELETE "
    "DROP_MATERIALIZED_VIEW DROP_TABLE DROP_VIEW EXPORT_DATA INSERT MERGE SELECT TRUNCATE UPDATE"
).split()

#: Days of a log that are read where no window is given.
DAYS = 30


def _reads(jobs: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    """One row for each table that a finished job of the window reads, with its `dst` and `src`.

    Without a window, the last DAYS days of the log.  A log that has `statement_type` is held to STATEMENTS.
    """
    done = jobs.filter((F.col("state") == "DONE") & F.col("error").isNull() & F.col("destination").isNotNull())
    if "statement_type" in jobs.columns:
        done = done.filter(F.col("statement_type").isin(STATEMENTS))
    if begin is None or end is None:
        # One row.
        span = jobs.agg(F.max("created").alias("_newest"))
        done = done.join(F.broadcast(span)).filter(F.col("created") >= F.col("_newest") - F.expr(f"interval {DAYS} days")).drop("_newest")
    else:
        done = done.filter(F.col("created").between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")))
    node = lambda n: F.struct(n["project"].alias("project"), n["dataset"].alias("dataset"), shard_family(n["table"]).alias("table"))
    # A job that reads no table keeps one row, without a source.
    flat = done.withColumn("ref", F.explode_outer("referenced"))
    dst = F.when(F.col("destination.dataset").startswith("_"), F.struct(F.lit(USER).alias("project"), F.lit(USER).alias("dataset"), F.lit(USER).alias("table"))).otherwise(node(F.col("destination")))
    return flat.withColumns({"dst": dst, "src": F.when(F.col("ref").isNotNull(), node(F.col("ref")))})


def edges(jobs: DataFrame, begin: str | None = None, end: str | None = None) -> DataFrame:
    """(dst, src, n_jobs, n_users, total_bytes, job_latest) from a job log.

    The log has (state, error, created, user, bytes, destination, referenced); destination is a node and referenced an
    array of nodes (project, dataset, table).  A result without a name is the user's.
    """
    return _reads(jobs, begin, end).groupBy("dst", "src").agg(F.count("*").alias("n_jobs"), F.count_distinct("user").alias("n_users"), F.sum("bytes").alias("total_bytes"), F.max("created").alias("job_latest"))


def attributes(jobs: DataFrame, begin: str | None = None, end: str | None = None, exact: bool = False) -> DataFrame:
    """(dst, src, query, n_queries, slot_ms, and deciles of processed_ms, wait_ms and slot_ms) of each edge.

    The log has query, processed_ms, wait_ms and slot_ms besides.  `query` is the one with the largest sum of creation
    times, so one run often and lately; each query is summed up before they are compared.
    """
    reads = _reads(jobs, begin, end)
    sums = reads.groupBy("dst", "src", "query").agg(F.sum(F.unix_timestamp("created")).alias("weight"))
    top = sums.groupBy("dst", "src").agg(F.max_by("query", F.struct("weight", "query")).alias("query"))
    deciles = lambda c: F.percentile_approx(c, F.array(*[F.lit(i / 10) for i in range(11)]), 1_000_000 if exact else 10_000).alias(f"{c}__quantiles")
    queries = F.count_distinct("query") if exact else F.approx_count_distinct("query")
    rest = reads.groupBy("dst", "src").agg(queries.alias("n_queries"), F.sum("slot_ms").alias("slot_ms"), *[deciles(c) for c in ("processed_ms", "wait_ms", "slot_ms")])
    top = top.select(F.col("dst").alias("_dst"), F.col("src").alias("_src"), "query")
    return rest.join(top, (F.col("dst") == F.col("_dst")) & F.col("src").eqNullSafe(F.col("_src"))).drop("_dst", "_src")


def name(node: Column) -> Column:
    return F.concat_ws(".", node["project"], node["dataset"], node["table"])


def _settled(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """A table computed once, in files of the shared folder, with its `rows` and other aggregates observed on the way."""
    path, seen = scratch(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def reach(steps: DataFrame) -> DataFrame:
    """(a, b) of all nodes b that some steps (a, b) lead to from a.  Each round doubles the steps; it ends when no pair is added."""
    found, seen = _settled(steps.select("a", "b").distinct())
    while True:
        longer = found.select(F.col("a"), F.col("b").alias("m")).join(found.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        more, now = _settled(found.unionByName(longer).distinct())
        if now == seen:
            return more
        found, seen = more, now


def cycles(steps: DataFrame) -> DataFrame:
    """(node, part, size): the strongly connected part of each node of some steps (a, b), by its smallest node.

    Nodes are in one part if each leads to the other; a node on no cycle is a part of its own.
    """
    pairs = reach(steps)
    mutual = pairs.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    nodes = steps.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = nodes.join(mutual, "node", "left").select("node", F.least("node", F.coalesce("least", "node")).alias("part"))
    return _settled(parts.withColumn("size", F.count("*").over(Window.partitionBy("part"))))[0]


def depths(steps: DataFrame) -> DataFrame:
    """(a, b, depth) of all nodes that some steps (a, b) lead to: the steps of the longest way.

    A cycle counts as its tables one after the other, all of them as far away as the last.  So cycles are contracted, and
    the longest ways over the rest are found by rounds that double them.
    """
    parts = cycles(steps)
    of = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part"), F.col("size").alias(f"{side}_size"))
    between = steps.join(of("a"), "a").join(of("b"), "b").filter("a_part <> b_part")
    far = between.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"), F.col("b_size").alias("depth")).distinct()
    far, seen = _settled(far, total=F.sum("depth"))
    while seen["rows"]:
        ahead = far.select(F.col("a").alias("m"), "b", F.col("depth").alias("more"))
        longer = far.withColumnRenamed("b", "m").join(ahead, "m").select("a", "b", (F.col("depth") + F.col("more")).alias("depth"))
        far, now = _settled(far.unionByName(longer).groupBy("a", "b").agg(F.max("depth").alias("depth")), total=F.sum("depth"))
        if now == seen:
            break
        seen = now
    starts, ends = of("from"), of("to")
    apart = far.join(starts, F.col("a") == F.col("from_part")).join(ends, F.col("b") == F.col("to_part"))
    apart = apart.select(F.col("from").alias("a"), F.col("to").alias("b"), (F.col("depth") + F.col("from_size") - 1).alias("depth"))
    inside = starts.join(ends, F.col("from_part") == F.col("to_part")).filter("from <> to").select(F.col("from").alias("a"), F.col("to").alias("b"), (F.col("from_size") - 1).alias("depth"))
    return apart.unionByName(inside)


def lineage(edges: DataFrame, max_depth: int = 50) -> DataFrame:
    """(destination, depth, dst, src) of every table: its own edges at depth 0, then those of its sources.

    Steps go on within a dataset, and the depth of an edge is that of the longest way to its table (`depths`), at most
    `max_depth`.  Then each edge's source brings its own lineage from other datasets, once.  Users' queries are at depth
    -1 of what they read.  Edges may have a null source.
    """
    plain = edges.select("dst", "src")
    own = plain.filter((F.col("dst.table") != USER) & ~F.col("dst.dataset").startswith("_"))
    same = (F.col("dst.project") == F.col("src.project")) & (F.col("dst.dataset") == F.col("src.dataset"))
    steps = own.filter(same & (F.col("dst") != F.col("src"))).select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    below = depths(steps).select("a", F.col("b").alias("dst"), F.least("depth", F.lit(max_depth)).cast("int").alias("depth"))
    near = own.select(name(F.col("dst")).alias("destination"), F.lit(0).alias("depth"), "dst", "src")
    deeper = below.join(own, "dst").select(name(F.col("a")).alias("destination"), "depth", "dst", "src")
    compact = near.unionByName(deeper).groupBy("destination", "dst", "src").agg(F.max("depth").alias("depth"))
    compact, _ = _settled(compact)
    across = compact.filter(F.col("src").isNotNull() & ((F.col("dst.project") != F.col("src.project")) | (F.col("dst.dataset") != F.col("src.dataset"))))
    theirs = compact.select(F.col("destination").alias("via"), F.col("dst").alias("d2"), F.col("src").alias("s2"), F.col("depth").alias("more"))
    far = across.join(theirs, name(F.col("src")) == F.col("via")).groupBy("destination", F.col("d2").alias("dst"), F.col("s2").alias("src")).agg(F.max(F.col("depth") + 1 + F.col("more")).alias("depth"))
    users = plain.filter(F.col("dst.table") == USER).select(name(F.col("src")).alias("destination"), "dst", "src", F.lit(-1).alias("depth"))
    parts = [x.select("destination", "depth", "dst", "src") for x in (compact, far, users)]
    return reduce(DataFrame.unionByName, parts).groupBy("destination", "dst", "src").agg(F.max("depth").alias("depth")).select("destination", "depth", "dst", "src")


def node_id(node: Column) -> Column:
    """A short name of a node: four characters of the base64 of its MD5."""
    return F.substring(F.base64(F.unhex(F.md5(name(node)))), 1, 4)


def mermaid(lines: DataFrame, project: str, group_by: list[str] = ()) -> DataFrame:
    """(diagram) of lineage rows: nodes in boxes of their dataset, and of their project if it is another; then edges."""
    used = lines.filter("depth >= 0")
    nodes = used.select(*group_by, F.explode(F.array("dst", "src")).alias("node")).filter("node.table is not null").distinct()
    box = F.concat(F.lit("\t"), node_id(F.col("node")), F.lit("(fa:fa-table "), F.col("node.table"), F.lit(")"))
    sets = nodes.groupBy(*group_by, "node.project", "node.dataset").agg(F.array_join(F.array_sort(F.collect_set(box)), "\n").alias("boxes"))
    inner = F.concat(F.lit('subgraph "fa:fa-database '), F.col("dataset"), F.lit('"\n'), F.col("boxes"), F.lit("\nend"))
    outer = F.when(F.col("project") == project, inner).otherwise(F.concat(F.lit('subgraph "fa:fa-sitemap '), F.col("project"), F.lit('"\n'), inner, F.lit("\nend")))
    boxes = sets.groupBy(*group_by).agg(F.array_join(F.array_sort(F.collect_list(outer)), "\n").alias("nodes"))
    arrow = F.concat(node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst")))
    arrows = used.filter("src.table is not null").groupBy(*group_by).agg(F.array_join(F.array_sort(F.collect_set(arrow)), "\n").alias("edges"))
    both = boxes.join(arrows, list(group_by), "left") if group_by else boxes.join(F.broadcast(arrows))
    return both.select(*group_by, F.concat(F.lit("graph LR\n"), F.col("nodes"), F.lit("\n"), F.coalesce("edges", F.lit(""))).alias("diagram"))


def spliced(description: str | None, diagram: str) -> str:
    """A description with the diagram between its markers, which are added at the end where they are missing."""
    block = f"{BEGIN}\n```mermaid\n{diagram}\n```\n{END}"
    text = description or ""
    head, found, rest = text.partition(BEGIN)
    if not found:
        return f"{text}\n{block}" if text else block
    return head + block + rest.partition(END)[2]


def describe(spark: SparkSession, jobs: DataFrame, project: str, databases: list[str], begin: str | None = None, end: str | None = None, max_depth: int = 50) -> dict[str, str]:
    """Put the diagram of each database's lineage, from a job log, into its description; the new texts by database.

    One diagram for each database named comes to the driver.
    """
    lines = lineage(edges(jobs, begin, end), max_depth).withColumn("described", F.split("destination", r"\.")[1])
    out = {}
    for r in mermaid(lines.filter(F.col("described").isin(databases)), project, ["described"]).collect():
        out[r["described"]] = spliced(description(spark, r["described"]), r["diagram"])
        set_description(spark, r["described"], out[r["described"]])
    return out
