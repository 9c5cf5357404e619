"""The data-build operators."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import assertions, text
from tidemark.functions.retry import until_success
from tidemark.model import RefreshOptions, TableRef, parse_interval
from tidemark.operators import checks, profile, ranges, refresh, scd2
from tidemark.operators.alignment import day_to_day, day_to_day_padded, day_to_week
from tidemark.operators.labels import partition_labels, update_labels, view_labels
from tidemark.operators.profile_store import StoredProfile
from tidemark.operators.staleness import detect_staleness
from tidemark.plans import columns, joblog, lineage
from tidemark.plans.joblog import JobLog
from tidemark.sources import catalog, tables
from tidemark.sources.published import Conflict, Published
from tidemark.streaming import refresh as streaming

NOW = datetime(2024, 1, 1, 12)


def span(spark, first, last):
    return spark.createDataFrame([(date.fromisoformat(first), date.fromisoformat(last))], "first date, last date")


def test_alignments_of_a_month(spark):
    month = span(spark, "2022-01-01", "2022-01-31")
    days, padded, weeks = day_to_day(month).collect(), day_to_day_padded(month).collect(), day_to_week(month).collect()
    assert (len(days), len(padded), len(weeks)) == (31, 31, 6)
    assert padded[0].sources == ["20211231", "20220101", "20220102"]
    assert sorted(w.destination for w in weeks)[:2] == ["20211226", "20220102"]
    assert sum(len(w.sources) for w in weeks) == 31


#: Tables in the order of their last change.
CREATED = [("ref1", "20060102"), ("dest1", "20060102"), ("dest_no_partition", None), ("ref_20060102", None), ("ref_20060103", None), ("ref_no_partition", None)]
INFO = ["x.INFORMATION_SCHEMA.TABLES"]


@pytest.mark.parametrize(
    ("destination", "sources", "alignment", "forced", "expected"),
    [
        ("dest1", [], ("__ANY__", "__ANY__"), False, True),
        ("dest1", INFO, ("__ANY__", "__ANY__"), False, True),
        ("dest1", ["ref1"], ("20060102", "20060102"), False, None),
        ("dest1", ["ref1"], ("20060102", "20060102"), True, "20060102"),
        ("dest1", ["ref1", "ref_20060103"], ("20060102", "20060102"), False, None),
        ("dest1", ["ref1", "ref_20060103"], ("20060102", "__ANY__"), False, "20060102"),
        ("dest1", ["ref1", "ref_20060102"], ("20060102", "20060102"), False, "20060102"),
        ("dest1", ["ref_no_partition"], ("20060102", "__NULL__"), False, "20060102"),
        ("dest1", ["ref_no_partition"], ("20060102", "20060102"), False, "20060102"),
        ("dest_no_partition", ["ref_no_partition"], ("__NULL__", "__NULL__"), False, "__NULL__"),
        ("dest_no_partition", ["ref_no_partition", *INFO], ("__NULL__", "__NULL__"), False, "__NULL__"),
    ],
)
def test_staleness_matrix(spark, destination, sources, alignment, forced, expected):
    def partition(name, part):
        return name.removeprefix("ref_") if name.startswith("ref_2006") else part

    rows = [(name, partition(name, part), NOW - timedelta(minutes=10 - i)) for i, (name, part) in enumerate(CREATED)]
    metadata = spark.createDataFrame(rows, "table_name string, partition_id string, last_modified timestamp")
    aligned = spark.createDataFrame([(alignment[0], [alignment[1]])], "destination string, sources array<string>")
    found = detect_staleness(metadata, destination, sources, aligned, NOW, timedelta(0), NOW if forced else None)
    assert (found is not None) if expected is True else (found or [None])[0] == expected


def parts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "partition_id string")


@pytest.mark.parametrize(
    ("ids", "direction", "expected"),
    [
        (["20240101", "20240102", "20240103", "20240107", "20240108"], "backward", ("20240107", "20240108")),
        (["20240101", "20240102", "20240103", "20240107", "20240108"], "forward", ("20240101", "20240103")),
        (["2023123122", "2023123123", "2024010100"], "backward", ("2023123122", "2024010100")),
        (["202311", "202312", "202401"], "backward", ("202312", "202401")),
        (["__NULL__"], "backward", ("__NULL__", "__NULL__")),
        (["2022", "2023"], "forward", ("2022", "2022")),
    ],
)
def test_refresh_range(spark, ids, direction, expected):
    assert tuple(ranges.refresh_range(parts(spark, *ids), 1, direction).first()) == expected


def test_a_range_has_a_longest(spark):
    days = [(date(2024, 1, 1) + timedelta(i)).strftime("%Y%m%d") for i in range(90)]
    assert tuple(ranges.refresh_range(parts(spark, *days)).first()) == ("20240229", "20240330")
    assert ranges.bounds("2024010105", "2024010106") == ("2024-01-01 05:00:00", "2024-01-01 06:00:00")
    with pytest.raises(ValueError, match="partition id"):
        ranges.unit_of("week1")


def test_refresh_of_a_table(spark, tmp_path):
    events = [(i, datetime(2024, 1, 1 + i % 5), "ab"[i % 2]) for i in range(40)]
    spark.createDataFrame(events, "id long, ts timestamp, kind string").createOrReplaceTempView("events_t")
    path, query = str(tmp_path / "daily"), "SELECT to_date(ts) AS day, kind, count(*) AS n FROM events_t WHERE to_date(ts) BETWEEN :begin AND :end GROUP BY ALL"
    aligned = day_to_day(span(spark, "2024-01-01", "2024-01-05"))
    source = [("events_t", f"2024010{d}", NOW) for d in range(1, 6)]
    schema = "table_name string, partition_id string, last_modified timestamp"
    go = lambda rows, **o: refresh.update_partitions(spark, path, spark.createDataFrame(rows, schema), "daily", ["events_t"], aligned, query, F.date_format("day", "yyyyMMdd"), NOW + timedelta(hours=1), **o)
    assert go(source, dry_run=True) == refresh.Refreshed("20240101", "20240105", None)
    with pytest.raises(refresh.TableMissing):
        go(source)
    assert go(source, auto_recreate="replace_if_changed").rows == 10
    fresh = [("daily", f"2024010{d}", NOW + timedelta(minutes=5)) for d in range(1, 6)]
    assert go(source + fresh) is None
    # The fourth day loses its rows and is stale with the fifth: its partition is empty afterwards.
    spark.createDataFrame([e for e in events if e[1].day != 4], "id long, ts timestamp, kind string").createOrReplaceTempView("events_t")
    assert go(source + fresh[:3]).first == "20240104"
    ids = lambda: {r.partition_id for r in refresh.table_at(spark, path).read().select("partition_id").distinct().collect()}
    assert ids() == {"20240101", "20240102", "20240103", "20240105"}
    # A day that loses all its rows is emptied; one that never had any is an error.
    spark.createDataFrame([e for e in events if e[1].day not in (4, 5)], "id long, ts timestamp, kind string").createOrReplaceTempView("events_t")
    later = [("events_t", "20240105", NOW + timedelta(hours=2))]
    again = lambda: refresh.update_partitions(spark, path, spark.createDataFrame(source[:4] + later + fresh, schema), "daily", ["events_t"], aligned, query, F.date_format("day", "yyyyMMdd"), NOW + timedelta(hours=3))
    assert again() == refresh.Refreshed("20240105", "20240105", 0)
    assert ids() == {"20240101", "20240102", "20240103"}
    with pytest.raises(refresh.NothingWritten):
        again()
    assert ids() == {"20240101", "20240102", "20240103"}
    with pytest.raises(refresh.SchemaChanged):
        refresh.update_partitions(spark, path, spark.createDataFrame(source, schema), "daily", ["events_t"], aligned, query.replace("count(*)", "1.5"), F.date_format("day", "yyyyMMdd"), NOW)
    with pytest.raises(ValueError, match="unknown options"):
        RefreshOptions.of({"tolerate_delay": 1})


def test_replace_range_refuses_rows_outside(spark):
    df = spark.createDataFrame([("20240101", 1), ("20240102", 2), ("20240103", 3)], "p string, v int")
    out = refresh.replace_range(df, df.filter("v = 2").withColumn("v", F.lit(9)), F.col("p"), "20240102", "20240103")
    assert sorted(map(tuple, out.collect())) == [("20240101", 1), ("20240102", 9)]
    with pytest.raises(PySparkException, match="outside"):
        refresh.replace_range(df, df, F.col("p"), "20240102", "20240103").collect()


def test_history_counts_rows_as_they_change(spark, tmp_path):
    """Insert all, change all, back, change one, back, delete one, back, add one, back."""
    clock = iter(datetime(2024, 1, 1) + timedelta(days=i) for i in range(100))
    table = scd2.HistoryTable(spark, str(tmp_path / "h"), "k", clock=lambda: next(clock))
    rows = [(i, f"name {i}") for i in range(102)]
    df = lambda r: spark.createDataFrame(r, "k long, name string")
    states = [rows, [(i, n.upper()) for i, n in rows], rows, [(0, "new"), *rows[1:]], rows, rows[1:], rows, [*rows, (999, "x")], rows]
    assert table.init(df(states[0])) == 102
    counts = [table.update(df(s)) for s in states[1:]]
    assert counts == [204, 204, 2, 2, 1, 1, 1, 1]
    with pytest.raises(scd2.NothingChanged):
        table.update(df(rows))
    for i, state in enumerate(states):
        assert sorted(map(tuple, scd2.as_of(table.read(), datetime(2024, 1, 1 + i, 1)).collect())) == sorted(state)
    assert sorted(map(tuple, scd2.latest(table.read()).collect())) == rows
    found = {tuple(r)[1:] for r in scd2.validate(table.read()).collect()}
    assert found == {(0, 0), (0, 1)}
    with pytest.raises(ValueError, match="columns"):
        table.update(df(rows).withColumn("more", F.lit(1)))
    assert table.update(df([*rows, (5000, "y")]), dry_run=True) == 1 and table.current().count() == 102
    pruned = table.as_of(datetime(2024, 1, 8, 1))
    assert sorted(map(tuple, pruned.collect())) == sorted(states[7]) and "PartitionFilters: [isnotnull(closed_on" in pruned._jdf.queryExecution().toString()
    assert table.update(df(rows).withColumn("more", F.lit(1)), on_other_columns="recreate") == 102
    assert table.read().count() == 102 and table.current().select("entity.more").distinct().count() == 1


class Lost(Exception):
    """Stands for a writer that is lost."""


def lose_at(monkeypatch, n):
    """Let the n-th write of Parquet from now on fail: before it writes, or (half) behind it."""
    write, count = DataFrameWriter.parquet, [0]

    def parquet(self, *args, **options):
        count[0] += 1
        if count[0] == int(n + 0.5):
            if n % 1 == 0:
                raise Lost
            write(self, *args, **options)
            raise Lost
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


#: Before and behind each of the writes of an update: its rows, its pointer, and for other columns the backup's pointer.
MOMENTS = [1, 1.5, 2, 2.5, 3, 3.5]


@pytest.mark.parametrize("moment", [m - 0.5 if m % 1 else m for m in MOMENTS])
@pytest.mark.parametrize("other_columns", [False, True])
def test_history_is_old_or_new_wherever_an_update_stops(spark, tmp_path, monkeypatch, moment, other_columns):
    clock = iter(datetime(2024, 1, 1) + timedelta(days=i) for i in range(100))
    table = scd2.HistoryTable(spark, str(tmp_path / "h"), "k", clock=lambda: next(clock))
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    table.init(df((1, "a"), (2, "b")))
    fresh = df((1, "x"), (3, "c"))
    fresh = fresh.withColumn("more", F.lit(1)) if other_columns else fresh
    shown = lambda: sorted((r.unique_key, r.entity.v, r.valid_to is None) for r in table.read().collect())
    old = [(1, "a", True), (2, "b", True)]
    new = [(1, "x", True), (3, "c", True)] if other_columns else [(1, "a", False), (1, "x", True), (2, "b", False), (3, "c", True)]
    with monkeypatch.context() as patch:
        lose_at(patch, moment)
        try:
            table.update(fresh, on_other_columns="recreate")
        except Lost:
            pass
    assert shown() in (old, new)
    table.update(fresh, allow_unchanged=True, on_other_columns="recreate")
    assert shown() == new and {tuple(r)[1:] for r in scd2.validate(table.read()).collect()} == {(0, 0)}


@pytest.mark.parametrize("moment", [1, 1.5, 2, 2.5])
def test_refresh_is_old_or_new_wherever_it_stops(spark, tmp_path, monkeypatch, moment):
    table = refresh.table_at(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "v int, partition_id string")
    refresh.write_range(table, rows((1, "20240101"), (2, "20240102")), "20240101", "20240102")
    shown = lambda: sorted(map(tuple, table.read().collect()))
    with monkeypatch.context() as patch:
        lose_at(patch, moment)
        try:
            refresh.write_range(table, rows((3, "20240102"), (4, "20240103")), "20240102", "20240103")
        except Lost:
            pass
    assert shown() in ([(1, "20240101"), (2, "20240102")], [(1, "20240101"), (3, "20240102"), (4, "20240103")])
    refresh.write_range(table, rows((3, "20240102"), (4, "20240103")), "20240102", "20240103")
    assert shown() == [(1, "20240101"), (3, "20240102"), (4, "20240103")]


def test_published_tables(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"), "p")
    rows = lambda *r: spark.createDataFrame(list(r), "v int, p string")
    assert not table.exists() and table.version() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    odd = ["a b", "x/y=1%2F", None, "ü:#?*", "20240101"]
    one = table.stage(rows(*[(i, p) for i, p in enumerate(odd)]), most=F.max("v"))
    assert one.metrics == {"rows": 5, "most": 4} and not table.exists() and table.unreferenced().count() == 5
    table.publish(one)
    assert {r.p for r in table.read().collect()} == set(odd) and table.unreferenced().count() == 0
    # Another draft takes two keys' place; a third is never published.
    table.publish(table.stage(rows((7, "a b"), (8, None))), keep=lambda k: k not in ("a b", None))
    table.stage(rows((9, "lost")))
    assert sorted((r.v, r.p) for r in table.read().collect() if r.p) == sorted([(7, "a b"), (1, "x/y=1%2F"), (3, "ü:#?*"), (4, "20240101")])
    assert {r.v for r in table.read(number=1).collect()} == {0, 1, 2, 3, 4} and table.numbers() == [1, 2]
    assert ["_version=3-" in r.folder for r in table.unreferenced().collect()] == [True]
    assert {r.v for r in table.read(keep=lambda k: k == "20240101").collect()} == {4}
    assert {(r.partition_id, r.n_files) for r in table.metadata("t").collect()} == {(p, 1) for p in odd}
    # The next version has the number of the lost draft, whose rows stay away.
    table.publish(table.stage(rows((10, "lost"))), keep=lambda k: True)
    assert {r.v for r in table.read().collect() if r.p == "lost"} == {10}
    late = table.stage(rows((11, "late")))
    table.publish(table.stage(rows((12, "first"))), keep=lambda k: True)
    with pytest.raises(Conflict):
        table.publish(late)
    assert {r.v for r in table.read().collect() if r.p in ("late", "first")} == {12}
    empty = table.publish(table.stage(rows()), keep=None)
    assert empty.folders == [] and table.read().count() == 0 and table.read().columns == ["v", "p"]
    other = Published(spark, str(tmp_path / "u"), "p")
    other.adopt(table.version(1))
    assert other.read().count() == 5


def test_history_update_waits_for_its_sources(spark, tmp_path):
    table = scd2.HistoryTable(spark, str(tmp_path / "h"), "k", clock=lambda: NOW)
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    table.init(df)
    meta = lambda hours: spark.createDataFrame([("history", None, NOW), ("src", None, NOW + timedelta(hours=hours))], "table_name string, partition_id string, last_modified timestamp")
    go = lambda hours: table.update_if_stale(df.withColumn("v", F.lit("b")), meta(hours), "history", ["src"], NOW + timedelta(hours=3))
    assert go(-1) is None and go(1) == 2


def test_history_of_random_states(spark):
    rng = random.Random(11)
    history, states = None, []
    for step in range(5):
        state = {k: rng.choice(["a", "b", None]) for k in range(12) if rng.random() < 0.7}
        states.append(state)
        at = datetime(2024, 1, 1 + step)
        fresh = scd2.snapshot(spark.createDataFrame(list(state.items()), "k long, v string"), "k", at, f"r{step}")
        history = (fresh if history is None else scd2.update(history, fresh, at)).checkpoint()
    for step, state in enumerate(states):
        assert dict(map(tuple, scd2.as_of(history, datetime(2024, 1, 1 + step)).collect())) == state
    line = scd2.timeline(history, [datetime(2024, 1, 1 + s) for s in range(5)])
    assert line.count() == sum(map(len, states)) and scd2.timeline(history, []).count() == len(states[-1])


def test_history_refuses_bad_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    old = scd2.snapshot(df.limit(1), "k", NOW, "r")
    with pytest.raises(PySparkException, match="twice"):
        scd2.update(old, scd2.snapshot(df, "k", NOW, "s"), NOW).collect()
    with pytest.raises(PySparkException, match="null"):
        scd2.diff(old, scd2.snapshot(df.limit(1).withColumn("k", F.lit(None).cast("long")), "k", NOW, "s")).collect()


def test_diff_names_nested_fields(spark):
    old = spark.createDataFrame([(1, ("x", 1))], "k long, s struct<a:string,b:int>")
    new = spark.createDataFrame([(1, ("y", 1))], "k long, s struct<a:string,b:int>")
    row = scd2.diff(scd2.snapshot(old, "k", NOW, "r"), scd2.snapshot(new, "k", NOW, "s")).first()
    assert [tuple(c) for c in row.entity_changes] == [("s.a", "x", "y")] and row.action == "CHANGED"
    assert [r.s.a for r in row.entity_comparison] == ["x", "y"]


def test_golden(spark, tmp_path):
    store = scd2.HistoryTable(spark, str(tmp_path / "g"), "k")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    scd2.assert_golden(store, df)
    scd2.assert_golden(store, df)
    with pytest.raises(AssertionError):
        scd2.assert_golden(store, df.withColumn("v", F.lit("b")))
    scd2.assert_golden(store, df.withColumn("v", F.lit("b")), update_golden=True)
    scd2.assert_golden(store, df.withColumn("v", F.lit("b")))


def test_checks_and_stages(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k long, v string")
    rows = {r.group_name: r for r in checks.spec({"t": df}, {"t": {"unique": [["k"]], "nonnull": ["v"], "accepted": {"v": ["a", "b"]}}}).collect()}
    assert (rows["unique"].n_cases, rows["unique"].n_cases_failed) == (2, 1)
    assert rows["nonnull"].errors == ["non-null: v [33.3%]; Expected 0 but actual is 1"]
    assert "surplus (z), missing (b)" in rows["accepted_values"].errors[0]
    stages = {"base": lambda b: df, "twice": lambda b: b["base"].union(b["base"])}
    assert checks.remade(stages, "twice").count() == 6
    assert checks.remade(stages, "twice", {"base": df.limit(1)}).count() == 2
    stored = spark.createDataFrame([("old", "1"), ("1 + 1", "x")], "signature string, result string")
    assert {tuple(r) for r in checks.outcomes(df, ["1 + 1"], stored).collect()} == {("old", "1"), ("1 + 1", '{"v":2}')}
    by_key = checks.outcomes(df, ["upper(v)", "k + 1"], spark.createDataFrame([("a", "upper(v)", "old"), ("gone", "k + 1", "kept")], "v string, signature string, result string"), key=["v"])
    assert {tuple(r) for r in by_key.filter("v is not null").collect()} == {("a", "upper(v)", '{"v":"A"}'), ("a", "k + 1", '{"v":2}'), ("z", "upper(v)", '{"v":"Z"}'), ("z", "k + 1", '{"v":3}'), ("gone", "k + 1", "kept")}
    assert checks.outcomes(df, ["sum(k)", "max(v)"]).collect() == [("sum(k)", '{"v":4}'), ("max(v)", '{"v":"z"}')]
    report = checks.spec({"t": df, "u": df}, {"t": {"unique": [["k"]]}, "u": {"nonnull": ["k"]}})
    assert {tuple(r) for r in checks.passed(report).collect()} == {("t", False), ("u", True)}
    with pytest.raises(AssertionError), checks.should_error():
        pass


@pytest.mark.parametrize(
    "written, months, rest",
    [
        ("0-0 0 0:30:0", 0, timedelta(minutes=30)), ("1-2 -3 4:05:06.5", 14, timedelta(days=-3, hours=4, minutes=5, seconds=6.5)), ("-0-1", -1, timedelta()), ("-1:00:00", 0, timedelta(hours=-1)), ("7", 0, timedelta(days=7)),
        ("PT30M", 0, timedelta(minutes=30)), ("P1Y2M3DT4H5M6S", 14, timedelta(days=3, hours=4, minutes=5, seconds=6)), ("-P1W", 0, timedelta(days=-7)), ("1 month", 1, timedelta()), ("2 days 30 MINUTES", 0, timedelta(days=2, minutes=30)),
    ],
)
def test_intervals(written, months, rest):
    assert parse_interval(written) == (months, rest)


@pytest.mark.parametrize("written", ["", "P", "PT", "soon", "1 fortnight", "1-2-3", "3 x"])
def test_what_is_no_interval(written):
    with pytest.raises(ValueError, match="interval"):
        parse_interval(written)


def test_options_from_json():
    found = RefreshOptions.of('{"tolerate_staleness": "PT1H", "max_update_months": "0-2 0 0:0:0", "force_expired_at": "2024-01-02T03:04:05", "auto_recreate": "replace_if_changed"}')
    assert found == RefreshOptions(timedelta(hours=1), datetime(2024, 1, 2, 3, 4, 5), 2, auto_recreate="replace_if_changed")
    with pytest.raises(ValueError, match="months"):
        RefreshOptions.of({"tolerate_staleness": "P1M"})


def test_json_entries_of_a_table_with_such_columns(spark):
    df = spark.createDataFrame([(1, "k", "v", '{"a": {"b": 1.50}, "": [1, "x"]}')], "id long, key string, value string, j string")
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in text.json_entries(df, "j").collect()] == [(1, "a.b", "1.50"), (1, "_f1", '[1,"x"]')]


def test_assertions(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "n int, s string")
    good = df.select(assertions.sure_range(F.col("n"), 0, 5), assertions.sure_like(F.col("s"), "a%"), assertions.sure_values(F.col("s"), ["ab"]), assertions.sure_eq(F.col("n"), F.col("n")))
    assert good.count() == 2 and good.collect()[0][0] == 1
    for bad in (assertions.sure_range(F.col("n"), 2), assertions.sure_range(F.col("n"), None, 0), assertions.sure_like(F.col("s"), "b%"), assertions.sure_values(F.col("s"), ["x"]), assertions.sure_nonnull(F.col("n")), assertions.sure_eq(F.col("n"), F.lit(7))):
        with checks.should_error("[USER_RAISED_EXCEPTION]"):
            df.select(bad).collect()


def test_profile_skips_arrays_and_flattens_structs(spark):
    df = spark.createDataFrame([(1, ("x", 2.0), [1]), (2, (None, 4.0), [2])], "k long, s struct<a:string,b:double>, l array<int>")
    row = profile.profile(df, exact=True).first().asDict()
    assert row["s___a__nonnull"] == 1 and row["s___b__sum"] == 6.0 and not any(c.startswith("l__") for c in row)
    flat = spark.range(10).select(F.lit(3.0).alias("v"))
    assert [tuple(r) for r in profile.histogram(flat, "v", exact=True).collect()] == [(0, 3.0, 3.0, 10, 1.0)]
    assert profile.top_count(flat, "v").first()["count"] == 10


@pytest.mark.parametrize(("margin", "accuracy"), [(2e-4, 10_000), (0.0, 2), (0.3, 3)])
def test_exact_quantiles_do_not_depend_on_sketches(spark, monkeypatch, margin, accuracy):
    monkeypatch.setattr(profile, "_MARGIN", margin)
    monkeypatch.setattr(profile, "_ACCURACY", accuracy)
    rng = random.Random(5)
    data = [(rng.choice(["x", "y", None]), rng.choice(["a", None]), rng.choice([None, float("nan"), -0.0, 7.0, rng.uniform(-9, 9), rng.uniform(-9e9, 9e9)])) for _ in range(700)] + [("z", "a", None), ("one", "a", 5.0)]
    df = spark.createDataFrame(data, "p string, g string, v double").repartition(5)
    picks = (0, 10, 250, 333, 500, 990, 1000)
    last = lambda v: (v != v, v)  # noqa: E731  not-a-numbers come last

    def wanted(values):
        values = sorted((v for v in values if v is not None), key=last)
        return [(p / 10, values[max(1, -(-p * len(values) // 1000)) - 1]) for p in picks] if values else []

    for partition, group_by in ((None, []), (F.col("p"), []), (None, ["g"]), (F.col("p"), ["g"])):
        key = lambda p, g: (p if partition is not None else None, (f'{{"g":{"null" if g is None else chr(34) + g + chr(34)}}}') if group_by else None)  # noqa: B023, E731
        groups = {}
        for p, g, v in data:
            groups.setdefault(key(p, g), []).append(v)
        found = profile.quantiles(df, "v", picks, digits=None, partition=partition, group_by=group_by, exact=True).collect()
        assert sorted(map(repr, ((r.partition_key, r.group_keys, r.key, r.value + 0.0) for r in found))) == sorted(repr((*k, q, v + 0.0)) for k, values in groups.items() for q, v in wanted(values))
    empty = df.filter("v > 1e300 and v < 0")
    assert profile.quantiles(empty, "v", picks, exact=True).count() == 0 and profile.histogram(empty, "v", exact=True).count() == 0


def test_labels(spark):
    meta = spark.createDataFrame([("t", "20060102"), ("t", "20060105"), ("u", "20060101"), ("u", "20060102")], "table_name string, partition_id string")
    labels = partition_labels(meta)
    assert {tuple(r) for r in labels.collect()} == {("t", "20060102", "20060105", 1), ("u", "20060101", "20060102", 0)}
    view = view_labels(labels, spark.createDataFrame([("v", "t"), ("v", "u")], "view_name string, table_name string"))
    assert tuple(view.first()) == ("v", "20060102", "20060102", 1)


NODE = "struct<project:string,dataset:string,table:string>"


def test_lineage_of_an_example(spark):
    """Tables 2 to 4 are in one dataset, each of the others in one of its own; a user reads table 1."""
    where = {0: "(User)", 1: "c", 2: "d", 3: "d", 4: "d", 5: "e", 6: "f", 7: "g"}
    node = lambda n: None if n is None else ("p", where[n], f"t{n}") if n else (lineage.USER,) * 3
    pairs = [(0, 1), (1, 2), (1, 3), (1, 4), (2, None), (3, 4), (4, None), (5, 4), (6, 5), (7, 6)]
    df = spark.createDataFrame([(node(a), node(b)) for a, b in pairs], f"dst {NODE}, src {NODE}")
    found = {(r.destination[-2:], r.depth, r.dst.table, r.src and r.src.table) for r in lineage.lineage(df).collect()}
    assert {x for x in found if x[0] == "t1"} == {("t1", -1, lineage.USER, "t1"), ("t1", 0, "t1", "t2"), ("t1", 0, "t1", "t3"), ("t1", 0, "t1", "t4"), ("t1", 1, "t2", None), ("t1", 1, "t3", "t4"), ("t1", 2, "t4", None)}
    assert {x for x in found if x[0] == "t7"} == {("t7", 0, "t7", "t6"), ("t7", 1, "t6", "t5")}
    assert {x for x in found if x[0] == "t5"} == {("t5", 0, "t5", "t4"), ("t5", 1, "t4", None)}
    looped = spark.createDataFrame([(node(3), node(2)), (node(2), node(3))], f"dst {NODE}, src {NODE}")
    assert lineage.lineage(looped).count() == 4
    diagram = lineage.mermaid(lineage.lineage(df), "p").first().diagram
    assert diagram.startswith("graph LR\n") and diagram.count("subgraph") == 5 and diagram.count("-->") == 7
    once = lineage.spliced("about this", diagram)
    assert lineage.spliced(once, "x") == "about this\n" + lineage.spliced("", "x")


def longest_ways(steps):
    """The longest way between any two nodes by plain recursion, with cycles as one node as long as they have tables."""
    nodes = {n for s in steps for n in s}
    reach = {n: set() for n in nodes}
    for _ in nodes:
        for a, b in steps:
            reach[a] |= {b} | reach[b]
    part = {n: frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}

    def far(p, to):
        ways = [len(part[b]) + (0 if part[b] == to else far(part[b], to)) for a, b in steps if a in p and b not in p and (part[b] == to or min(to) in reach[b])]
        return max(ways)

    return {(a, b): len(part[a]) - 1 + (far(part[a], part[b]) if part[a] != part[b] else 0) for a in nodes for b in reach[a] if a != b}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depths_are_the_longest_ways(spark, seed):
    rng = random.Random(seed)
    n = 9
    steps = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(14)) if a != b and (a < b or rng.random() < 0.25)})
    found = {(r.a, r.b): r.depth for r in lineage.depths(spark.createDataFrame(steps, "a long, b long")).collect()}
    assert found == longest_ways(steps)


def test_lineage_of_a_dense_dataset_and_of_a_long_chain(spark):
    """All ways through 60 tables that all read one another could never be listed."""
    node = lambda n: ("p", "d", f"t{n}")
    dense = [(node(a), node(b)) for a in range(60) for b in range(60) if a != b]
    lines = lineage.lineage(spark.createDataFrame(dense, f"dst {NODE}, src {NODE}"))
    assert {tuple(r) for r in lines.groupBy("depth").count().collect()} == {(0, 60 * 59), (50, 60 * 59 * 59)}
    chain = [(node(a), node(a + 1)) for a in range(200)]
    lines = lineage.lineage(spark.createDataFrame(chain, f"dst {NODE}, src {NODE}"), max_depth=1000)
    assert lines.count() == 200 * 201 // 2 and lines.agg(F.max("depth")).first()[0] == 199


def test_jobs_that_read_nothing_have_an_edge(spark):
    rows = [("DONE", None, NOW, "u", 1, ("p", "d", "a"), []), ("DONE", None, NOW, "u", 1, ("p", "d", "b"), [("p", "d", "a")])]
    jobs = spark.createDataFrame(rows, f"state string, error string, created timestamp, user string, bytes long, destination {NODE}, referenced array<{NODE}>")
    assert {(r.dst.table, r.src and r.src.table) for r in lineage.edges(jobs).collect()} == {("a", None), ("b", "a")}


def test_columns_that_a_query_reads(spark, tmp_path):
    spark.range(5).select("id", (F.col("id") * 2).alias("x"), F.lit("s").alias("y")).write.parquet(str(tmp_path / "a"))
    spark.range(5).select("id", F.lit(1).alias("z"), F.lit(2).alias("unused")).write.parquet(str(tmp_path / "b"))
    spark.read.parquet(str(tmp_path / "a")).createOrReplaceTempView("ta")
    spark.read.parquet(str(tmp_path / "b")).createOrReplaceTempView("tb")
    query = "SELECT x + 1 AS p, z FROM ta JOIN tb USING (id)"
    assert [t.rpartition("/")[2] for t in columns.referenced_tables(spark, query)] == ["a", "b"]
    found = {c: {t.rpartition("/")[2]: sorted(n) for t, n in reads} for c, reads in columns.column_lineage(spark, query).items()}
    assert found == {"p": {"a": ["id", "x"], "b": ["id"]}, "z": {"a": ["id"], "b": ["id", "z"]}}
    spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b")).createOrReplaceTempView("tab")
    assert [t.rpartition("/")[2] for t in columns.referenced_tables(spark, "SELECT id FROM tab")] == ["a", "b"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\n  \n b",), ("    x\n      y",)], "t string")
    one = lambda c, i: df.select(c).collect()[i][0]
    assert one(text.indent(F.col("t"), 2), 0) == "  a\n\n   b"
    assert one(text.dedent(F.col("t")), 1) == "x\n  y" and one(text.reindent(F.col("t"), 1), 1) == " x\n   y"
    labels = spark.createDataFrame([('[STRUCT("a", "1"), STRUCT("a", "2")]',)], "t string").select(text.parse_labels(F.col("t"))).first()[0]
    assert [tuple(x) for x in labels] == [("a", "1"), ("a", "2")]
    rows = spark.createDataFrame([(1, '{"a":{"b":1,"":2},"c":[1,2],"d":null}'), (2, None)], "id int, j string")
    assert {(r.key, r.value) for r in text.json_entries(rows, "j").collect()} == {("a.b", "1"), ("a._f1", "2"), ("c", "[1,2]"), ("d", None)}
    points = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(5)]).alias("q"))
    assert [tuple(x) for x in points.select(text.format_quantiles(F.col("q"), [0, 2])).first()[0]] == [(0.0, 0.0), (50.0, 2.0)]
    small = spark.createDataFrame([(1, "it's", None), (2, None, True)], "a int, b string, c boolean")
    assert sorted(map(tuple, spark.sql(text.values_sql(small)).collect())) == sorted(map(tuple, small.collect()))
    with pytest.raises(ValueError, match="more than 5 rows"):
        text.values_sql(spark.range(6), 5)
    deep = '{"a":' * 30 + '"x"' + "}" * 30
    odd = spark.createDataFrame([(1, deep), (2, "[1]"), (3, '{"n":1.50,"t":true,"l":[{"q":"é","z":1e3},null],"o":{}}'), (4, "no json")], "id int, j string")
    assert {(r.id, r.key, r.value) for r in text.json_entries(odd, "j").collect()} == {(1, ".".join("a" * 30), "x"), (3, "n", "1.50"), (3, "t", "true"), (3, "l", '[{"q":"é","z":1e3},null]')}
    assert "| 0 " in text.table_text(spark.range(1).collect())


def test_column_lineage_of_many_shapes(spark, tmp_path):
    """Views, unions, structs taken apart and put together, subqueries, shared subqueries, exploded arrays, windows, and
    tables of the catalog."""
    with catalog.temporary_database(spark) as name:
        spark.sql(f"CREATE TABLE {name}.a (id int, s struct<x:int,y:struct<z:string,w:int>>, l array<struct<k:string,v:int>>, g string) USING parquet")
        spark.sql(f"CREATE TABLE {name}.b (id int, n int, g string) USING parquet")
        spark.sql(f"CREATE VIEW {name}.v AS SELECT id, s.y AS inner_s, g FROM {name}.a WHERE g <> 'no'")
        spark.sql(f"CREATE VIEW {name}.vv AS SELECT v.id, v.inner_s.z AS z, b.n FROM {name}.v JOIN {name}.b USING (id)")
        a, b = f"spark_catalog.{name}.a", f"spark_catalog.{name}.b"
        of = lambda q: columns.column_lineage(spark, q.replace("$", name))
        values = lambda q: columns.value_lineage(spark, q.replace("$", name))
        assert of("SELECT z FROM $.vv") == {"z": [(a, ["g", "id", "s.y.z"]), (b, ["id"])]}
        assert values("SELECT z, n + 1 AS m, 7 AS c FROM $.vv") == {"z": [(a, ["s.y.z"])], "m": [(b, ["n"])], "c": []}
        assert values("SELECT t.p, t.q.x AS qx FROM (SELECT named_struct('x', s.x, 'o', n) AS q, upper(s.y.z) AS p FROM $.a JOIN $.b USING (id)) t") == {"p": [(a, ["s.y.z"])], "qx": [(a, ["s.x"])]}
        assert values("SELECT id, g FROM $.a UNION ALL SELECT n, 'c' FROM $.b") == {"id": [(a, ["id"]), (b, ["n"])], "g": [(a, ["g"])]}
        assert values("WITH c AS (SELECT g, max(n) AS m FROM $.b GROUP BY g) SELECT c1.m, c2.g FROM c c1 JOIN c c2 ON c1.g = c2.g") == {"m": [(b, ["n"])], "g": [(b, ["g"])]}
        assert of("SELECT count(*) AS n FROM $.b") == {"n": [(b, [])]}
        assert values("SELECT e.v, a.id FROM $.a LATERAL VIEW explode(l) t AS e") == {"v": [(a, ["l.v"])], "id": [(a, ["id"])]}
        assert values("SELECT l[0].k AS k, (SELECT max(n) FROM $.b WHERE b.g = a.g) AS m FROM $.a") == {"k": [(a, ["l.k"])], "m": [(a, ["g"]), (b, ["g", "n"])]}
        assert values("SELECT sum(n) OVER (PARTITION BY g ORDER BY id) AS r FROM $.b") == {"r": [(b, ["g", "id", "n"])]}
        assert of("SELECT id FROM $.a WHERE EXISTS (SELECT 1 FROM $.b WHERE b.id = a.id AND b.n > 2)") == {"id": [(a, ["id"]), (b, ["id", "n"])]}
        assert of("SELECT id FROM (SELECT id, n FROM $.b ORDER BY n LIMIT 3)") == {"id": [(b, ["id", "n"])]}
        assert of("SELECT DISTINCT g FROM $.b") == {"g": [(b, ["g"])]}
        assert columns.referenced_tables(spark, f"SELECT 1 FROM {name}.vv") == [a, b]
        spark.range(3).createOrReplaceTempView("no_table")
        assert columns.referenced_tables(spark, "SELECT id FROM no_table") == [] and values("SELECT id FROM no_table") == {"id": []}


def test_labels_of_views_come_from_what_they_read(spark):
    with catalog.temporary_database(spark) as name, catalog.temporary_database(spark) as other:
        for table, days in ((f"{name}.t", (1, 2, 3, 5)), (f"{name}.u", (2, 3, 4)), (f"{other}.w", (3, 4))):
            spark.sql(f"CREATE TABLE {table} (a int, p string) USING parquet PARTITIONED BY (p)")
            spark.sql(f"INSERT INTO {table} VALUES " + ", ".join(f"(1, '2024010{d}')" for d in days))
        spark.sql(f"CREATE VIEW {name}.v1 AS SELECT t.a, t.p FROM {name}.t JOIN {name}.u USING (p)")
        spark.sql(f"CREATE VIEW {name}.v2 AS SELECT * FROM {name}.v1 WHERE a > 0")
        spark.sql(f"CREATE VIEW {name}.v3 AS SELECT a FROM {name}.v2 UNION ALL SELECT a FROM {other}.w")
        assert catalog.views(spark, name) == ["v1", "v2", "v3"]
        assert {tuple(r) for r in catalog.dependencies(spark, name).collect()} == {(v, t) for v in ("v1", "v2", "v3") for t in ("t", "u")} | {("v3", f"{other}.w")}
        assert {r.view_name: "JOIN" in r.view_definition for r in catalog.view_definitions(spark, name).collect()} == {"v1": True, "v2": False, "v3": False}
        found = update_labels(spark, name)
        assert found["v2"] == {"partition-min": "20240102", "partition-max": "20240104", "partition-skip": "1"}
        assert found["v3"] == {"partition-min": "20240103", "partition-max": "20240104", "partition-skip": "1"}
        assert catalog.labels(spark, TableRef(name, "v3"))["partition-min"] == "20240103" and set(found) == {"t", "u", "v1", "v2", "v3"}


def test_recreation_keeps_buckets(spark):
    with catalog.temporary_database(spark) as name:
        ref = TableRef(name, "t")
        spark.range(20).selectExpr("id", "id % 3 AS k", "'20240101' AS p").write.partitionBy("p").bucketBy(4, "k").sortBy("id").saveAsTable(f"{name}.t")
        catalog.recreate(spark, ref, spark.range(5).selectExpr("id", "id % 2 AS k", "1.5 AS more", "'20240102' AS p"))
        assert catalog.buckets(spark, ref) == (4, ["k"], ["id"]) and spark.table(str(ref)).count() == 5


def test_builds_are_logged(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"))
    spark.range(4).write.parquet(str(tmp_path / "src" / "a"))
    rows = spark.read.parquet(str(tmp_path / "src" / "a"))
    with log.run("out.b", rows, "SELECT", team="x") as run:
        run.rows = 4
    with pytest.raises(ValueError), log.run("out.c", rows):
        raise ValueError("bad")
    found = {r.destination.table: r for r in log.read().collect()}
    assert found["b"].rows == 4 and found["b"].labels["team"] == "x" and found["b"].referenced[0].table == "a" and found["b"].error is None
    assert found["c"].error == "ValueError: bad" and {r.dst.table for r in lineage.edges(log.read()).collect()} == {"b"}
    assert joblog.users(log.read()).first()["n_failed"] == 1
    history = scd2.HistoryTable(spark, str(tmp_path / "store" / "h"), "id", log=log)
    history.init(rows)
    history.update(rows.filter("id < 3"))
    with pytest.raises(scd2.NothingChanged):
        history.update(rows.filter("id < 3"))
    edge = lineage.edges(log.read()).filter("dst.table = 'h'").first()
    assert (edge.dst.dataset, edge.src.table, edge.n_jobs) == ("store", "a", 2)
    assert sorted(r.rows for r in log.read().filter("destination.table = 'h' and error is null").collect()) == [1, 4]


def test_squares_are_summed_exactly(spark):
    big = [2**63 - 1, -(2**63), 3, None] * 50
    wide = [Decimal("99999999999999999999999999999999.999999"), Decimal("-0.000001"), Decimal("12345678901234567890.5"), None] * 50
    narrow = [Decimal("12345678.25"), Decimal("-0.75"), None, Decimal("99999999.99")] * 50
    df = spark.createDataFrame(list(zip(big, wide, narrow, strict=True)), "a long, b decimal(38,6), c decimal(10,2)")
    for sketches in (False, True):
        rows = profile.profile(df.repartition(3), partition=F.col("a").cast("string") if sketches else None, sketches=sketches)
        row = (profile.merge(rows) if sketches else rows).first()
        for name, values in (("a", big), ("b", wide), ("c", narrow)):
            want = float(sum(Fraction(v) ** 2 for v in values if v is not None))
            assert abs(row[f"{name}__sum2"] - want) <= 4e-16 * want
    exact = spark.createDataFrame([(10**9 + i,) for i in range(1000)], "a long")
    assert profile.profile(exact).first()["a__sum2"] == float(sum((10**9 + i) ** 2 for i in range(1000)))


def test_all_digits_of_squares_are_shown(spark):
    some = {
        "long": [2**63 - 1, -(2**63), 3, None] * 50,
        "int": [94_906_267, 1, 0, None],
        "decimal(38,6)": [Decimal("99999999999999999999999999999999.999999"), Decimal("-0.000001"), None] * 50,
        "decimal(10,2)": [Decimal("12345678.25"), Decimal("-0.75"), None],
        "decimal(4,2)": [Decimal("0.05"), None],
        "byte": [None, 0],
        "decimal(12,4)": [None],
        "short": [None],
    }
    for kind, values in some.items():
        df = spark.createDataFrame([(v, str(i % 3)) for i, v in enumerate(values)], f"v {kind}, p string")
        found = profile.shown(profile.merge(profile.profile(df, partition=F.col("p"), columns=["v"], sketches=True))).first()["v__sum2_exact"]
        known = [Fraction(v) ** 2 for v in values if v is not None]
        assert (None if found is None else Fraction(found)) == (sum(known) if known else None)
    assert found is None and spark.createDataFrame([(10**9 + 7,)], "v long").transform(lambda df: profile.shown(profile.profile(df, sketches=True))).first()["v__sum2_exact"] == str((10**9 + 7) ** 2)


def test_a_stored_profile_query_has_all_digits(spark, tmp_path):
    users = [94_906_267 + i for i in range(20)]
    rows = spark.createDataFrame([(u, 1.0, datetime(2024, 1, 1 + i % 2)) for i, u in enumerate(users)], "user_id long, value double, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    want = sum((u * (10 if i % 2 else 1)) ** 2 for i, u in enumerate(users))
    assert queries.profile_stored(spark, str(tmp_path)).first().squares == str(want)


def test_merged_sketches_say_what_the_rows_do(spark):
    df = spark.range(20000).select((F.col("id") % 10).cast("string").alias("p"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("t"), F.lit(None).cast("double").alias("none"))
    row = profile.shown(profile.merge(profile.profile(df, partition=F.col("p"), columns=["v", "t", "none"], sketches=True))).first()
    values = sorted(r.v for r in df.select("v").collect())
    for q in row.v__quantiles:
        at = q.key / 100 * len(values)
        assert bisect_left(values, q.value) - 200 <= at <= bisect_right(values, q.value) + 200
    assert {(x.value, x["count"]) for x in row.t__top_count} == {("a", 6667), ("b", 13333)} and row.none__quantiles is None
    plain = {r.bucket: r["count"] for r in profile.histogram(df, "v", exact=True).collect()}
    assert sum(b["count"] for b in row.v__histogram) == pytest.approx(20000, abs=20)
    assert all(abs(b["count"] - plain[b.bucket]) < 400 for b in row.v__histogram)


def test_a_stored_profile_reads_changed_partitions_only(spark, tmp_path):
    source, kept = Published(spark, str(tmp_path / "t"), "day"), StoredProfile(spark, str(tmp_path / "p"), "day", ["v"])
    rows = lambda days, v: spark.createDataFrame([(v + i, f"2024010{d}") for d in days for i in range(4)], "v long, day string")
    source.publish(source.stage(rows(range(1, 6), 0)))
    assert kept.refresh(source.read(), source.metadata("t")) == [f"2024010{d}" for d in range(1, 6)]
    assert kept.refresh(source.read(), source.metadata("t")) == []
    source.publish(source.stage(rows([3, 7], 100)), keep=lambda day: day not in ("20240103", "20240105"))
    assert kept.stale(source.metadata("t")) == (["20240103", "20240107"], ["20240105"])
    files = {f.rpartition("/")[0].rpartition("day=")[2][:8] for f in kept.of(source.read(), ["20240103"]).inputFiles()}
    plan = kept.of(source.read(), ["20240103"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "20240103" in files
    assert kept.refresh(source.read(), source.metadata("t")) == ["20240103", "20240107"]
    row = kept.merged().first()
    assert (row["count"], row.v__sum, row.v__max) == (20, 3 * 6 + 2 * 406, 103) and kept.rows().count() == 5


def test_blocks_and_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 4000, 1, 40).withColumn("p", F.when(F.col("id") < 100, None).otherwise(F.concat(F.lit("a/"), F.col("id") % 2))).write.partitionBy("p").parquet(path)
    few, more = tables.sampled_blocks(spark, path, 20, 1), tables.sampled_blocks(spark, path, 60, 1)
    all_files = len(spark.read.parquet(path).inputFiles())
    assert 0 < len(few.inputFiles()) < len(more.inputFiles()) < all_files and set(few.inputFiles()) < set(more.inputFiles())
    assert tables.sampled_blocks(spark, path, 100).count() == 4000 and tables.sampled_blocks(spark, path, 0).count() == 0 and few.columns == ["id", "p"]
    counts = {r.partition_id: r.n_rows for r in tables.row_counts(spark, path, "p").collect()}
    assert counts == {None: 100, "a/0": 1950, "a/1": 1950}
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    assert "PushedAggregation: [COUNT(*)]" in tables._pushed_counts(own, path, "p")._jdf.queryExecution().toString()
    assert {(r.partition_id, r.n_rows) for r in tables.storage_profile(spark, path, "t", "p").collect()} == set(counts.items())
    old = spark.createDataFrame([("a", NOW - timedelta(days=200)), ("b", NOW)], "partition_id string, last_modified timestamp")
    assert {r.partition_id: r.storage_tier for r in tables.dataset_profile(old, NOW).collect()} == {"a": "LONG_TERM", "b": "ACTIVE"}


def test_recreation_copies_and_labels_of_the_catalog(spark):
    with catalog.temporary_database(spark) as name:
        ref, old, twin = (TableRef(name, t) for t in ("t", "t_old", "twin"))
        spark.sql(f"CREATE TABLE {ref} (a int COMMENT 'about a', p string) USING parquet PARTITIONED BY (p) COMMENT 'about t' TBLPROPERTIES ('team' = 'x')")
        spark.sql(f"INSERT INTO {ref} VALUES (1, '20240101'), (2, '20240102'), (3, '20240105')")
        catalog.copy_table(spark, ref, twin)
        assert spark.table(str(twin)).count() == 3 and catalog.partition_columns(spark, twin) == [("p", "string")]
        catalog.recreate(spark, ref, spark.createDataFrame([(1, 2.5, "20240101"), (2, 2.5, "20240103")], "a int, b double, p string"), old)
        assert spark.table(str(old)).count() == 3 and spark.table(str(ref)).columns == ["a", "b", "p"] and spark.table(str(ref)).count() == 2
        assert catalog.table_description(spark, ref) == "about t" and catalog.labels(spark, ref)["team"] == "x"
        assert spark.table(str(ref)).schema["a"].metadata["comment"] == "about a" and catalog.partition_columns(spark, ref) == [("p", "string")]
        assert update_labels(spark, name)["t"] == {"partition-min": "20240101", "partition-max": "20240103", "partition-skip": "1"}
        assert catalog.labels(spark, ref)["partition-skip"] == "1" and catalog.labels(spark, ref)["team"] == "x"


def test_lineage_in_descriptions(spark):
    with catalog.temporary_database(spark) as name:
        catalog.set_description(spark, name, "about")
        node = lambda t: ("p", name, t)
        rows = [("DONE", None, NOW, "u", 1, node("b"), [node("a")]), ("DONE", None, NOW, "u", 1, node("c"), [node("b")]), ("DONE", None, NOW - timedelta(days=40), "u", 1, node("old"), [node("a")])]
        jobs = spark.createDataFrame(rows, f"state string, error string, created timestamp, user string, bytes long, destination {NODE}, referenced array<{NODE}>")
        found = lineage.describe(spark, jobs, "p", [name])
        assert catalog.description(spark, name) == found[name] and found[name].startswith("about\n") and found[name].count(" --> ") == 2 and "old" not in found[name]


def test_recorded_column_lineage(spark, tmp_path):
    spark.range(5).select("id", (F.col("id") * 2).alias("x")).write.parquet(str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a")).createOrReplaceTempView("rec_a")
    log = columns.recorded(spark, "r", "SELECT id FROM rec_a", "v1", NOW).unionByName(columns.recorded(spark, "r", "SELECT x AS y, 1 AS one FROM rec_a", "v2", NOW + timedelta(days=1)))
    row = columns.analyse(log).first()
    assert (row.revision, [c.column for c in row.column_lineage]) == ("v2", ["y", "one"]) and row.column_lineage[0].lineage[0].fields == ["x"]


def test_history_as_sql_functions(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(days=i) for i in range(9))
    table = scd2.HistoryTable(spark, str(tmp_path / "h"), "k", clock=lambda: next(clock))
    table.init(spark.createDataFrame([(1, "a")], "k long, v string"))
    table.update(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"))
    table.views("hist_v")
    assert spark.sql("SELECT v FROM hist_v ORDER BY k").collect() == [("b",), ("c",)]
    assert spark.sql("SELECT v FROM hist_v__as_of(timestamp '2024-01-01 12:00:00')").collect() == [("a",)]
    line = spark.sql("SELECT day(at), v FROM hist_v__timeline(array(timestamp '2024-01-01 12:00:00', timestamp '2024-01-02 12:00:00')) ORDER BY 1, 2").collect()
    assert line == [(1, "a"), (2, "b"), (2, "c")]


def test_retry():
    now, waits, tries = [0.0], [], []

    def wait(s):
        waits.append(s)
        now[0] += s

    def action():
        tries.append(1)
        if len(tries) < 4:
            raise ValueError
        return "done"

    assert until_success(action, sleep=wait, clock=lambda: now[0]) == "done" and waits == [15, 30, 60]
    with pytest.raises(TimeoutError):
        until_success(lambda: 1 / 0, timeout=0, sleep=wait, clock=lambda: now[0])


def test_catalog_and_sources(spark, tmp_path):
    with catalog.temporary_database(spark) as name:
        ref = TableRef.parse(f"{name}.t")
        spark.sql(f"CREATE TABLE {ref} (a int, p string) USING parquet PARTITIONED BY (p)")
        assert catalog.partition_columns(spark, ref) == [("p", "string")]
        catalog.set_labels(spark, ref, {"partition-min": "it's"})
        assert catalog.labels(spark, ref)["partition-min"] == "it's"
        catalog.set_description(spark, name, "text 'quoted'")
        assert catalog.description(spark, name) == "text 'quoted'"
        assert catalog.tables(spark, name).count() == 1
    for day in ("20240101", "20240102", "20240103"):
        spark.range(int(day[-1])).write.parquet(str(tmp_path / f"log_{day}"))
    found = tables.shards(spark, str(tmp_path), "log_", "20240102")
    assert {tuple(r) for r in found.groupBy("table_suffix").count().collect()} == {("20240102", 2), ("20240103", 3)}
    spark.range(6).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(str(tmp_path / "parted"))
    assert {r.partition_id for r in tables.file_metadata(spark, str(tmp_path / "parted"), "t", "p").collect()} == {"0", "1"}
    assert {(r.table_name, r.partition_id, r.n_rows) for r in tables.storage_profile(spark, str(tmp_path / "parted"), "t20240101", "p").collect()} == {("t*", "0", 3), ("t*", "1", 3)}
    dated = spark.createDataFrame([("20230101", datetime(2023, 1, 2)), ("20231230", datetime(2023, 12, 30, 5)), (None, NOW)], "partition_id string, last_modified timestamp")
    assert {(r.partition_id, r.creation_delay) for r in tables.dataset_profile(dated, NOW, 365).collect()} == {("20231230", timedelta(hours=5)), (None, None)}
    assert 0 < tables.sampled(spark.range(1000), 10, 1).count() < 250


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", datetime(2024, 1, 2)), (2, "b", datetime(2024, 1, 3))], "k long, v string, ts timestamp").write.parquet(source)
    stream = lambda: spark.readStream.schema("k long, v string, ts timestamp").parquet(source)
    calls = []
    streaming.run_to_end(streaming.refresh_on_arrival(stream(), F.date_format("ts", "yyyyMMdd"), lambda a, b: calls.append((a, b)), str(tmp_path / "c1")))
    assert calls == [("20240102", "20240103")]
    table = scd2.HistoryTable(spark, str(tmp_path / "h"), "k")
    keep = lambda: streaming.run_to_end(streaming.keep_history(stream(), table, "k", "ts", str(tmp_path / "c2")))
    keep()
    spark.createDataFrame([(2, "c", datetime(2024, 1, 4))], "k long, v string, ts timestamp").write.mode("append").parquet(source)
    keep()
    assert {(r.k, r.v) for r in scd2.latest(table.read()).collect()} == {(1, "a"), (2, "c")}
    counts = streaming.daily_counts(stream().withColumnRenamed("v", "event_type"))
    streaming.run_to_end(counts.writeStream.format("memory").queryName("daily_n").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")))
    assert {tuple(r) for r in spark.table("daily_n").collect()} == {("20240102", "a", 1), ("20240103", "b", 1), ("20240104", "c", 1)}
