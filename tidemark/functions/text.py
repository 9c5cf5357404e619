"""Text helpers on columns and small tables."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indent(text: Column, n: int) -> Column:
    """Lines that have a character, moved right by n; blank ones emptied."""
    cleared = F.regexp_replace(text, r"(?m)^[ \t]+$", "")
    return F.regexp_replace(cleared, r"(?m)^(?=.)", " " * n)


def dedent(text: Column) -> Column:
    """Lines without the indent that all non-blank ones share."""
    lines = F.split(F.regexp_replace(text, r"(?m)^[ \t]+$", ""), "\n")
    depth = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, F.coalesce(depth, F.lit(0)) + 1, F.length(x))), "\n")


def reindent(text: Column, n: int) -> Column:
    return indent(dedent(text), n)


def parse_labels(text: Column) -> Column:
    """`[STRUCT("k", "v"), ...]` as an array of (key, value); repeats stay."""
    pairs = F.from_json(F.translate(F.regexp_replace(text, "STRUCT", ""), "()", "[]"), "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))


def format_quantiles(points: Column, picks: list[int] | None = None, digits: int | None = None, size: int | None = None) -> Column:
    """Picked points of an array of quantiles as (key, value), key being their percentage; no picks are all."""
    last = F.size(points) - 1
    wanted = F.array(*[F.lit(p) for p in picks]) if picks else F.sequence(F.lit(0), last)
    value = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
    return F.transform(wanted, lambda i: F.struct((F.lit(100.0) * i / last).alias("key"), value(F.get(points, i)).alias("value")))


class _Number(str):
    """A number as it is written."""


def _written(value: object) -> str | None:
    """A leaf as text: texts and numbers as they stand, arrays as compact JSON."""
    if value is None or type(value) is str or isinstance(value, _Number):
        return None if value is None else str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ",".join(_inside(v) for v in value) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_inside(v)}" for k, v in value.items()) + "}"


def _inside(value: object) -> str:
    if value is None:
        return "null"
    return json.dumps(value, ensure_ascii=False) if type(value) is str else _written(value)


def json_entries(df: DataFrame, column: str) -> DataFrame:
    """(all columns, key, value): the leaves of a JSON object, by dotted key, of any depth; arrays stay text, an empty
    key is `_f<place>`.  A null, and what is no JSON object, has no entry.  Columns of these names are left out of the
    result, which has its own.  One pass, in Arrow batches."""
    rest = [f for f in df.schema if f.name not in ("key", "value")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, values = [], [], []
            for i, text in enumerate(batch[column].to_pylist()):
                try:
                    value = json.loads(text, parse_int=_Number, parse_float=_Number) if text else None
                except ValueError:
                    continue
                stack = [("", iter(enumerate(value.items())))] if isinstance(value, dict) else []
                while stack:
                    prefix, items = stack[-1]
                    j, (key, v) = next(items, (None, (None, None)))
                    if j is None:
                        stack.pop()
                    elif isinstance(v, dict) and v:
                        stack.append((f"{prefix}{key or f'_f{j}'}.", iter(enumerate(v.items()))))
                    elif not isinstance(v, dict):
                        rows.append(i)
                        keys.append(f"{prefix}{key or f'_f{j}'}")
                        values.append(_written(v))
            kept = batch.take(pa.array(rows, pa.int32()))
            own = [pa.array(keys, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays([*[kept[f.name] for f in rest], *own], [*[f.name for f in rest], "key", "value"])

    extra = [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
    return df.mapInArrow(run, T.StructType([*rest, *extra]))


def table_text(rows: list[Row]) -> str:
    """A few collected rows as a boxed text table, within comment marks."""
    if not rows:
        return "/* (no rows) */"
    names = list(rows[0].asDict())
    show = lambda v: "null" if v is None else v if isinstance(v, str) else json.dumps(v, default=str)
    cells = [names] + [[show(v) for v in r] for r in rows]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in cells]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join(["/*", rule, lines[0], rule, *lines[1:], rule, "*/"])


def values_sql(df: DataFrame, most: int = 100) -> str:
    """SQL that gives a small table again; a table of more than `most` rows is an error."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in df.schema)
    literal = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ",\n".join("  (" + ", ".join(literal(v) for v in r) + ")" for r in found)
    names = ", ".join(f"`{c}`" for c in df.columns)
    return textwrap.dedent(f"SELECT {columns}\nFROM VALUES\n") + rows + f"\nAS t({names})"
