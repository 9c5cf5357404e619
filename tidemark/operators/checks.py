"""Data checks: uniqueness, missing values, accepted values; their report; assertions inside queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASES = "group_name string, name string, actual string, expected string"

#: Distinct values that the accepted-values check lists, and error texts of a group in the report.
MOST_VALUES, MOST_ERRORS = 100, 20


def _value(columns: list[str]) -> Column:
    """Values as text, with NULL for null."""
    return F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _name(columns: list[str]) -> str:
    return ", ".join(columns)


def unique_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """One case for each value of some columns together: it occurs once."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    name = F.concat(F.lit(f"unique: {_name(columns)} = "), _value(columns))
    return counts.select(F.lit("unique").alias("group_name"), name.alias("name"), F.col("n").cast("string").alias("actual"), F.lit("1").alias("expected"))


def nonnull_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """One case for each column: it has no null.  All columns are counted in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cases = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]
    each = counts.select("_n", F.explode(F.array(*cases)).alias("x")).select("_n", "x.*")
    ratio = F.format_string("%4.1f", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("_n")), F.lit(0.0)))
    name = F.concat(F.lit("non-null: "), F.col("column"), F.lit(" ["), ratio, F.lit("%]"))
    return each.select(F.lit("nonnull").alias("group_name"), name.alias("name"), F.col("n").cast("string").alias("actual"), F.lit("0").alias("expected"))


def accepted_cases(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """One case: the column's most frequent values, and the accepted ones, are the same."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "v").limit(MOST_VALUES).agg(F.collect_list("v").alias("seen"))
    wanted = F.array(*[F.lit(v) for v in accepted]).cast("array<string>")
    shown = lambda a: F.array_join(F.array_sort(a), ", ")
    actual = F.concat(F.lit("surplus ("), shown(F.array_except("seen", wanted)), F.lit("), missing ("), shown(F.array_except(wanted, "seen")), F.lit(")"))
    return top.select(F.lit("accepted_values").alias("group_name"), F.lit(f"accepted values: {column}").alias("name"), actual.alias("actual"), F.lit("surplus (), missing ()").alias("expected"))


def cases(df: DataFrame, unique: list[list[str]] = (), nonnull: list[str] = (), accepted: dict[str, list[str]] | None = None) -> DataFrame:
    """All cases of a table."""
    found = [unique_cases(df, c) for c in unique] + ([nonnull_cases(df, list(nonnull))] if nonnull else [])
    found += [accepted_cases(df, c, v) for c, v in (accepted or {}).items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def report(cases: DataFrame, target: str) -> DataFrame:
    """(target_table, group_name, n_cases, n_cases_passed, n_cases_failed, errors) for each group with cases.

    The listed errors are the first by name.  Only they are ordered, within a group's failures.
    """
    passed = F.col("actual").eqNullSafe(F.col("expected"))
    error = F.concat(F.col("name"), F.lit("; Expected "), F.col("expected"), F.lit(" but actual is "), F.col("actual"))
    counts = cases.groupBy("group_name").agg(F.count("*").alias("n_cases"), F.count_if(passed).alias("n_cases_passed"))
    first = cases.filter(~passed).withColumn("_rank", F.row_number().over(Window.partitionBy("group_name").orderBy("name"))).filter(F.col("_rank") <= MOST_ERRORS)
    errors = first.groupBy("group_name").agg(F.array_sort(F.collect_list(error)).alias("errors"))
    out = counts.join(errors, "group_name", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    return out.select(F.lit(target).alias("target_table"), "group_name", "n_cases", "n_cases_passed", (F.col("n_cases") - F.col("n_cases_passed")).alias("n_cases_failed"), "errors")


def spec(stages: dict[str, DataFrame], tests: dict[str, dict]) -> DataFrame:
    """The report of several named stages of a query; `tests` has the arguments of `cases` for each."""
    if unknown := set(tests) - set(stages):
        raise ValueError(f"no such stages: {sorted(unknown)}")
    out = None
    for name, arguments in tests.items():
        one = report(cases(stages[name], **arguments), name)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tests")
    return out


def remade(stages: dict[str, object], final: str, mocks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Build a query from named stages, with some replaced.

    A stage is a function of the stages built before it; `final` is the one wanted.
    """
    built: dict[str, DataFrame] = dict(mocks or {})
    for name, make in stages.items():
        if name not in built:
            built[name] = make(built)
        if name == final:
            break
    return built[final]


def passed(reports: DataFrame) -> DataFrame:
    """(target_table, passed): whether all groups of cases of each table passed; one without cases has."""
    return reports.groupBy("target_table").agg(F.bool_and(F.col("n_cases_failed") == 0).alias("passed"))


def outcomes(df: DataFrame, expressions: list[str], stored: DataFrame | None = None, how: str = "full", key: list[str] = ()) -> DataFrame:
    """(signature, result) of SQL expressions, as JSON, beside stored ones; fresh results win.

    Without a key, each is one value over the whole table (an aggregate, or what needs no column).  With one, each is
    evaluated for every row, and results go by key and signature: (key columns, signature, result).
    """
    value = lambda e: F.to_json(F.struct(F.expr(e).alias("v")), {"ignoreNullFields": "false"})
    each = F.array(*[F.struct(F.lit(e).alias("signature"), F.col(f"_{i}").alias("result")) for i, e in enumerate(expressions)])
    named = [value(e).alias(f"_{i}") for i, e in enumerate(expressions)]
    rows = df.select(*key, *named) if key else df.agg(*named)
    fresh = rows.select(*key, F.explode(each).alias("x")).select(*key, "x.*")
    if stored is None:
        return fresh
    by = [*key, "signature"]
    old = stored.select(*by, F.col("result").alias("old"))
    return old.join(fresh, by, how).select(*by, F.coalesce("result", "old").alias("result"))


@contextmanager
def should_error(match: str = "") -> Iterator[None]:
    """Passes only if the block raises an error, whose text has `match`."""
    try:
        yield
    except Exception as e:
        if match and match not in str(e):
            raise
        return
    raise AssertionError("an error was expected")
