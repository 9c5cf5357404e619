"""Registered queries against DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "null"
        return str(v) if isinstance(v, str) else repr(round(float(v), 6))

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    want, got = con.execute(ORACLES[name]).df(), entry.queries()[name](spark, str(SF)).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_histogram_of_two_million_values_equals_its_sql(spark, tmp_path):
    """All prices differ, and the share of the last bucket ends in a five at the fifth digit."""
    con, file = duckdb.connect(), str(tmp_path / "lineitem.parquet")
    price = "case when i < 300 then 1e7 + i else (i * 1000003 % 2000000) / 100.0 end"
    con.execute(f"copy (select {price} as l_extendedprice from range(2000000) r(i)) to '{file}' (format parquet)")
    con.execute(f"create view lineitem as select * from '{file}'")
    got = entry.queries()["profile_histogram"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(ORACLES["profile_histogram"]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
