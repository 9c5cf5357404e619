"""Column profiles of a table, by partition and group."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of 1001 quantile points, those that a profile shows; histogram edges; listed values of numbers and texts.
PICKS, EDGES, TOP_NUMBERS, TOP_TEXTS = (0, 10, 100, 250, 500, 750, 900, 990, 1000), 20, 5, 20

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

Groups = list[tuple[str, Column]]


def leaf_columns(schema: T.StructType, skip: tuple[str, ...] = (), path: str = "", name: str = "") -> list[tuple[str, str, T.DataType]]:
    """(output name, column path, type) of the fields to profile: leaves of structs; nothing inside arrays or maps."""
    out = []
    for f in schema:
        full, label = f"{path}`{f.name}`", f"{name}{f.name}"
        if label in skip or isinstance(f.dataType, (T.ArrayType, T.MapType)):
            continue
        if isinstance(f.dataType, T.StructType):
            out += leaf_columns(f.dataType, skip, f"{full}.", f"{label}___")
        else:
            out.append((label, full, f.dataType))
    return out


#: Size of the sketches of quantiles: of any value the rank is within about half a percent.  Values that a sketch of
#: frequent ones tracks: counts are exact where a column has no more.
KLL_K, TRACKED = 800, 10_000

#: Decimals of 38 digits are cut into limbs of so many, whose sums cannot overflow below 10^19 rows.
_LIMB = 19


def square_limbs(c: Column, kind: T.DataType) -> list[tuple[int, Column]]:
    """The square of a whole or decimal number as (exponent, limb): the sum of limb * 10^exponent is exact.

    A number of up to 19 digits has a square of 38; a longer one is a * 10^19 + b first.
    """
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    digits = kind.precision if isinstance(kind, T.DecimalType) else 19
    whole = T.DecimalType(38, 0)
    base = F.lit(Decimal(10**_LIMB))

    def split(x: Column, exponent: int) -> list[tuple[int, Column]]:
        low = (x % base).cast(whole)
        return [(exponent, low), (exponent + _LIMB, ((x - low) / base).cast(whole))]

    # The digits without a point; all of them fit, since they are as many as the number has.
    unit = F.translate(F.abs(c).cast("string"), ".", "").cast(whole) if scale else F.abs(c.cast(whole))
    if digits <= _LIMB:
        narrow = unit.cast(T.DecimalType(_LIMB, 0))
        return [(e - 2 * scale, limb) for e, limb in split((narrow * narrow).cast(whole), 0)]
    low = (unit % base).cast(T.DecimalType(_LIMB, 0))
    high = ((unit - low) / base).cast(T.DecimalType(_LIMB, 0))
    parts = [((low * low).cast(whole), 0), ((low * high).cast(whole), _LIMB), ((low * high).cast(whole), _LIMB), ((high * high).cast(whole), 2 * _LIMB)]
    return [(e - 2 * scale, limb) for x, at in parts for e, limb in split(x, at)]


def _limb_name(i: int, exponent: int) -> str:
    return f"sum2_limb{i}_e{exponent}".replace("-", "m")


def _exponent(limb_name: str) -> int:
    return int(limb_name.rpartition("_e")[2].replace("m", "-"))


def limbs_value(sums: list[tuple[int, Column]]) -> Column:
    """The number that summed limbs make, rounded once: exactly where it has 38 digits at most, else by doubles."""
    low = min(e for e, _ in sums)
    wide = T.DecimalType(38, 0)
    exact = None
    for e, limb in sums:
        if e - low > 37:
            return sum((limb.cast("double") * 10.0**e for e, limb in sums), F.lit(0.0))
        scaled = F.try_multiply(limb.cast(wide), F.lit(Decimal(10 ** (e - low))))
        exact = scaled if exact is None else F.try_add(exact, scaled)
    rounded = sum((limb.cast("double") * 10.0**e for e, limb in sums), F.lit(0.0))
    return F.coalesce(exact.cast("double") / 10.0**-low if low < 0 else exact.cast("double") * 10.0**low, rounded)


def limbs_text(sums: list[tuple[int, Column]]) -> Column:
    """All digits of the number that summed limbs make; a double would keep the first 16 of them."""
    low, wide, base = min(e for e, _ in sums), T.DecimalType(38, 0), F.lit(Decimal(10**_LIMB))
    at = {e: [limb.cast(wide) for other, limb in sums if other == e] for e in sorted({e for e, _ in sums})}
    digits, carry = F.lit(""), F.lit(Decimal(0)).cast(wide)
    for e, limbs in at.items():
        value = sum(limbs, carry).cast(wide)
        own = (value % base).cast(wide)
        carry = ((value - own) / base).cast(wide)
        digits = F.concat(F.lpad(own.cast("string"), _LIMB, "0"), digits)
    digits = F.concat(carry.cast("string"), digits)
    if low < 0:
        point = F.length(digits) + low
        digits = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(-low)))
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def _stats(name: str, path: str, kind: T.DataType, exact: bool, sketches: bool) -> list[Column]:
    c = F.col(path)
    put = lambda stat, e: e.alias(f"{name}__{stat}")
    distinct = F.count_distinct if exact else F.approx_count_distinct
    out = [put("nonnull", F.count(c))]
    kll = top = None
    if isinstance(kind, NUMBERS):
        limbs = [(e, F.sum(limb)) for e, limb in square_limbs(c, kind)]
        out += [put("unique", distinct(c)), put("sum", F.try_sum(c)), put("sum2", limbs_value(limbs)), put("avg", F.try_avg(c)), put("min", F.min(c)), put("max", F.max(c))]
        if sketches:
            out += [put(_limb_name(i, e), limb.cast("decimal(38,0)")) for i, (e, limb) in enumerate(limbs)]
        sketch = c.cast("long") if not isinstance(kind, T.DecimalType) else c.cast("string")
        kll, top = c.cast("double"), c.cast("string")
    elif isinstance(kind, FLOATS):
        out += [put("sum", F.sum(c)), put("avg", F.avg(c)), put("min", F.min(c)), put("max", F.max(c))]
        sketch, kll = None, c.cast("double")
    elif isinstance(kind, T.StringType):
        n = F.length(c)
        out += [put("unique", distinct(c)), put("avg_len", F.avg(n)), put("min_len", F.min(n)), put("max_len", F.max(n))]
        sketch = top = c
    elif isinstance(kind, TIMES):
        out += [put("min", F.min(c)), put("max", F.max(c))]
        sketch = c.cast("date").cast("string")
    else:
        sketch = None
    if sketches and sketch is not None:
        out.append(put("day_hll" if isinstance(kind, TIMES) else "hll", F.hll_sketch_agg(sketch)))
    if sketches and kll is not None:
        # Not-a-numbers have no rank.
        out.append(put("kll", F.kll_sketch_agg_double(F.when(~F.isnan(kll), kll), F.lit(KLL_K))))
    if sketches and top is not None:
        out.append(put("top", F.call_function("approx_top_k_accumulate", top, F.lit(TRACKED))))
    return out


def profile(df: DataFrame, partition: Column | None = None, group_by: list[str] = (), columns: list[str] | None = None, exact: bool = False, sketches: bool = False) -> DataFrame:
    """One row per partition and group: count, and the statistics of each column's type, as `<column>__<stat>`.

    One aggregate in one pass; a sum that its type cannot hold is null.  With `sketches`, sketches of distinct values (HLL), of quantiles (KLL) and of frequent
    values are kept, so that profiles can be merged; `shown` reads them.
    """
    keys = _keys(partition, group_by)
    chosen = [x for x in leaf_columns(df.schema, tuple(group_by)) if columns is None or x[0] in columns]
    stats = [s for name, path, kind in chosen for s in _stats(name, path, kind, exact, sketches)]
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *stats)


#: Columns that tell profiles of a table apart.
KEYS = ("partition_key", "group_keys")


def _varying(partition: Column | None, group_by: list[str]) -> list[str]:
    """The keys that are not null throughout."""
    return [name for name, there in zip(KEYS, (partition is not None, bool(group_by)), strict=True) if there]


def _keys(partition: Column | None, group_by: list[str]) -> list[Column]:
    part = partition if partition is not None else F.lit(None).cast("string")
    group = F.to_json(F.struct(*group_by), {"ignoreNullFields": "false"}) if group_by else F.lit(None).cast("string")
    return [part.cast("string").alias("partition_key"), group.alias("group_keys")]


#: How each statistic of a stored profile is merged with others of its kind.
_MERGE = {"nonnull": F.sum, "sum": F.try_sum, "min": F.min, "max": F.max, "min_len": F.min, "max_len": F.max, "hll": F.hll_union_agg, "day_hll": F.hll_union_agg, "kll": F.kll_merge_agg_double, "top": lambda c: F.call_function("approx_top_k_combine", F.col(c))}


def merge(profiles: DataFrame, by: list[str] = ()) -> DataFrame:
    """Profiles of many partitions as one, per value of `by`; averages follow from sums, unique counts from sketches."""
    names = {c.rpartition("__")[0]: set() for c in profiles.columns if "__" in c}
    for c in profiles.columns:
        if "__" in c:
            names[c.rpartition("__")[0]].add(c.rpartition("__")[2])
    exact = {n: sorted(s for s in stats if s.startswith("sum2_limb")) for n, stats in names.items()}
    merged = [_MERGE[s](f"{n}__{s}").alias(f"{n}__{s}") for n, stats in names.items() for s in sorted(stats) if s in _MERGE]
    merged += [F.sum(f"{n}__{s}").cast("decimal(38,0)").alias(f"{n}__{s}") for n, limbs in exact.items() for s in limbs]
    merged += [F.sum(f"{n}__sum2").alias(f"{n}__sum2") for n, stats in names.items() if "sum2" in stats and not exact[n]]
    lengths = [F.sum(F.col(f"{n}__avg_len") * F.col(f"{n}__nonnull")).alias(f"{n}__sum_len") for n, stats in names.items() if "avg_len" in stats]
    out = profiles.groupBy(*by).agg(F.sum("count").alias("count"), *merged, *lengths)
    for n, stats in names.items():
        if "avg" in stats:
            out = out.withColumn(f"{n}__avg", F.try_divide(F.col(f"{n}__sum"), F.col(f"{n}__nonnull")))
        if "avg_len" in stats:
            out = out.withColumn(f"{n}__avg_len", F.try_divide(F.col(f"{n}__sum_len"), F.col(f"{n}__nonnull"))).drop(f"{n}__sum_len")
        if "hll" in stats:
            out = out.withColumn(f"{n}__unique", F.hll_sketch_estimate(f"{n}__hll"))
        if exact[n]:
            sums = [(_exponent(s), F.col(f"{n}__{s}")) for s in exact[n]]
            out = out.withColumn(f"{n}__sum2", limbs_value(sums))
    return out


def _quantiles_of(sketch: str) -> Column:
    """(key, value) of the picked quantiles of a KLL sketch; key is the percentage."""
    values = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(p / 1000) for p in PICKS]))
    keys = F.array(*[F.lit(p / 10) for p in PICKS])
    return F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


#: Points of a sketch that a histogram counts.
_POINTS = 1000


def _histogram_of(sketch: str) -> Column:
    """(bucket, low, high, count) of a KLL sketch, with edges as those of `histogram`; of a thousand quantiles, so many
    lie in a bucket as thousandths of the rows."""
    points = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit((i + 0.5) / _POINTS) for i in range(_POINTS)]))
    quarter = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.75)))
    base, step = quarter[0] - 1.5 * (quarter[1] - quarter[0]), (quarter[1] - quarter[0]) / 5
    total = F.kll_sketch_get_n_double(sketch)
    place = F.transform(points, lambda v: F.greatest(F.lit(0), F.least(F.lit(EDGES + 1), F.floor((v - base) / step) + 1)).cast("int"))

    def bar(i: Column) -> Column:
        low, high = F.when(i > 0, base + step * (i - 1)), F.when(i <= EDGES, base + step * i)
        return F.struct(i.alias("bucket"), low.alias("low"), high.alias("high"), F.round(F.size(F.filter(place, lambda x: x == i)) * total / _POINTS).cast("long").alias("count"))

    bars = F.filter(F.transform(F.sequence(F.lit(0), F.lit(EDGES + 1)), bar), lambda x: x["count"] > 0)
    none = F.lit(None).cast("double")
    return F.when(step > 0, bars).otherwise(F.array(F.struct(F.lit(0).alias("bucket"), none.alias("low"), none.alias("high"), total.alias("count"))))


def shown(profiles: DataFrame, top_numbers: int = TOP_NUMBERS, top_texts: int = TOP_TEXTS) -> DataFrame:
    """Profiles with sketches, merged or not, with what the sketches say in their place.

    A whole or decimal number has `__sum2_exact`, the digits of the sum of squares as text.
    A number has `__quantiles` of (key, value) and a `__histogram` of (bucket, low, high, count); numbers and texts have
    `__top_count` of (value, count).  Frequent values are those that the sketch is sure of: with more distinct values
    than it tracks, one that is not frequent is left out.
    """
    out = profiles
    limbs = [c for c in profiles.columns if "__sum2_limb" in c]
    for n in dict.fromkeys(c.rpartition("__")[0] for c in limbs):
        out = out.withColumn(f"{n}__sum2_exact", limbs_text([(_exponent(c), F.col(f"`{c}`")) for c in limbs if c.rpartition("__")[0] == n]))
    for n in [c.removesuffix("__kll") for c in profiles.columns if c.endswith("__kll")]:
        has = F.col(f"{n}__nonnull") > 0
        out = out.withColumns({f"{n}__quantiles": F.when(has, _quantiles_of(f"{n}__kll")), f"{n}__histogram": F.when(has, _histogram_of(f"{n}__kll"))})
    for n in [c.removesuffix("__top") for c in profiles.columns if c.endswith("__top")]:
        most = top_numbers if f"{n}__kll" in profiles.columns else top_texts
        found = F.call_function("approx_top_k_estimate", F.col(f"{n}__top"), F.lit(most))
        out = out.withColumn(f"{n}__top_count", F.transform(found, lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count"))))
    return out.drop(*[c for c in profiles.columns if c.rpartition("__")[2] in ("kll", "top", "hll", "day_hll") or "__sum2_limb" in c])


def top_count(df: DataFrame, column: str, n: int = TOP_NUMBERS, partition: Column | None = None, group_by: list[str] = ()) -> DataFrame:
    """(partition_key, group_keys, value, count) of a column's most frequent values, ties by value.

    Values are counted before they are ranked, so only distinct values are ordered.
    """
    counts = df.groupBy(*_keys(partition, group_by), F.col(column).alias("value")).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("partition_key", "group_keys").orderBy(F.desc("count"), "value"))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


#: How far to either side of a wanted quantile its bounds lie: a sketch of this accuracy is off by a ten-thousandth at most.
_MARGIN, _ACCURACY = 2e-4, 10_000


def _matched(left: DataFrame, right: DataFrame, keys: list[str], *within: Column) -> DataFrame:
    """A left join by keys that may be null, and by conditions; without keys, `right` has a few rows.

    Of an outer join Spark broadcasts no `left`, which it may take for small by its files.
    """
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys}) if keys else F.broadcast(right)
    same = [F.lit(True), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], *within]
    return left.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"_{k}" for k in keys])


def _exact_quantiles(rows: DataFrame, keys: list[str], picks: tuple[int, ...], points: int = 1000) -> DataFrame:
    """(keys, q) of rows (keys, v): of the n values of a group that are not null, those at the places ceil(pick * n / points), from 1.

    Approximate quantiles at both sides of each pick cut a group's values into bins.  All rows are counted by bin; those of
    bins with a wanted place are counted by value and put in order.  So the sketches bound what is ordered, and no result
    depends on them; a wanted bin keeps its two bounds, since another run of a sketch may give others.
    """
    rows = rows.filter(F.col("v").isNotNull())
    cuts = sorted({min(1.0, max(0.0, p / points + side)) for p in picks for side in (-_MARGIN, _MARGIN)})
    # Sketches of not-a-numbers may give them out of order.
    bounds = rows.groupBy(*keys).agg(F.sort_array(F.percentile_approx("v", F.array(*[F.lit(c) for c in cuts]), _ACCURACY)).alias("_cuts"))
    above = reduce(lambda a, b: a + b, [(F.col("v") > F.col("_cuts")[i]).cast("int") for i in range(len(cuts))])
    cut = lambda i: F.get("_cuts", i)  # noqa: E731  null beyond either end
    binned = _matched(rows, bounds, keys).withColumn("bin", above).select(*keys, "bin", cut(F.col("bin") - 1).alias("low"), cut(F.col("bin")).alias("high"))

    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy(*keys, "bin", "low", "high").agg(F.count("*").alias("n")).withColumns({"before": before, "total": F.sum("n").over(group)})
    place = lambda p: F.greatest(F.lit(1), F.call_function("div", F.col("total") * p + (points - 1), F.lit(points)))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (place(p) - F.col("before")).alias("place")) for i, p in enumerate(picks)])
    here = F.filter(places, lambda x: (x["place"] > 0) & (x["place"] <= F.col("n")))
    wanted = bins.select(*keys, "bin", "low", "high", here.alias("here")).filter(F.size("here") > 0)

    # At most one bin for each pick of a group; the other rows become one without a bin.
    found = _matched(rows, wanted, keys, F.coalesce(F.col("v") > F.col("low"), F.lit(True)), F.coalesce(F.col("v") <= F.col("high"), F.lit(True)))
    found = found.withColumn("v", F.when(F.col("bin").isNotNull(), F.col("v")))
    values = found.groupBy(*keys, "bin", "v").agg(F.count("*").alias("n"), F.any_value("here").alias("here"))
    up_to = values.withColumn("up_to", F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v")))
    at = up_to.select(*keys, "v", F.explode(F.filter("here", lambda x: (x["place"] > F.col("up_to") - F.col("n")) & (x["place"] <= F.col("up_to")))).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("x.i").alias("i"), F.col("v").alias("v"))))
    return at.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("q"))


def quantiles(df: DataFrame, column: str, picks: tuple[int, ...] = PICKS, points: int = 1000, digits: int | None = 6, partition: Column | None = None, group_by: list[str] = (), exact: bool = False) -> DataFrame:
    """(partition_key, group_keys, key, value) of picked quantiles; key is the percentage."""
    keys = _keys(partition, group_by)
    if exact:
        names = _varying(partition, group_by)
        rows = _exact_quantiles(df.select(*keys, F.col(column).alias("v")), names, picks, points)
        rows = rows.select(*[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in KEYS], "q")
    else:
        rows = df.groupBy(*keys).agg(F.percentile_approx(column, F.array(*[F.lit(p / points) for p in picks]), _ACCURACY).alias("q"))
    each = rows.select("partition_key", "group_keys", F.posexplode("q").alias("i", "value"))
    key = F.element_at(F.array(*[F.lit(100.0 * p / points) for p in picks]), F.col("i") + 1)
    value = F.col("value") if digits is None else F.round("value", digits)
    return each.select("partition_key", "group_keys", key.alias("key"), value.alias("value"))


def histogram(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """(bucket, low, high, count, ratio) of a numeric column.

    Edges lie a fifth of the interquartile range apart (its quartiles as SQL has them, with `exact`), from 1.5 ranges below the lower quartile to 1.5 above the upper;
    the first and last buckets are open.  Without spread there is one bucket.
    """
    value = F.col(column).cast("double")
    rows = df.filter(value.isNotNull()).select(value.alias("v"))
    spread = _exact_quantiles(rows, [], (250, 750)) if exact else rows.agg(F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.75)), _ACCURACY).alias("q"))
    spread = spread.select((F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("base"), ((F.col("q")[1] - F.col("q")[0]) / 5).alias("step"))
    # `spread` is one row.
    place = F.when(F.col("step") > 0, F.greatest(F.lit(0), F.least(F.lit(EDGES + 1), F.floor((F.col("v") - F.col("base")) / F.col("step")) + 1))).otherwise(F.lit(0))
    counted = rows.join(F.broadcast(spread)).groupBy(place.cast("int").alias("bucket"), "base", "step").agg(F.count("*").alias("count"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    low = F.when(F.col("step") <= 0, F.col("_min")).when(F.col("bucket") > 0, F.col("base") + F.col("step") * (F.col("bucket") - 1)).otherwise(F.lit(float("-inf")))
    high = F.when(F.col("step") <= 0, F.col("_max")).when(F.col("bucket") <= EDGES, F.col("base") + F.col("step") * F.col("bucket")).otherwise(F.lit(float("inf")))
    total = F.sum("count").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Ties as SQL's round on doubles has them: by the product, not by the digits that a double shows.
    ratio = F.round(F.col("count") / total * 1e4) / 1e4
    return counted.select("bucket", low.alias("low"), high.alias("high"), "count", ratio.alias("ratio"))


def full(df: DataFrame, partition: Column | None = None, group_by: list[str] = (), columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """`profile` with, for each number, `<column>__top_count`, `__quantiles` and `__histogram`, and for each text its top counts.

    The values of all columns are stacked and counted before they are ranked, and one row for each group comes back, so
    two more passes do for any number of columns.  Top counts are arrays of (value as text, count), quantiles of
    (key, value) and histograms of (bucket, low, high, count); the edges are those of `histogram`, for each group.
    """
    keys = ["partition_key", "group_keys"]
    chosen = [x for x in leaf_columns(df.schema, tuple(group_by)) if columns is None or x[0] in columns]
    numbers = [(n, p) for n, p, kind in chosen if isinstance(kind, (*NUMBERS, *FLOATS))]
    counted = [(n, p, TOP_TEXTS if isinstance(kind, T.StringType) else TOP_NUMBERS) for n, p, kind in chosen if isinstance(kind, (*NUMBERS, T.StringType))]
    out = profile(df, partition, group_by, columns, exact)
    same = lambda other: (F.col("partition_key").eqNullSafe(other["_p"])) & (F.col("group_keys").eqNullSafe(other["_g"]))

    def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        right = right.withColumnsRenamed({"partition_key": "_p", "group_keys": "_g"})
        return left.join(right, same(right), how).drop("_p", "_g")

    if counted:
        each = df.select(*_keys(partition, group_by), F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(p).cast("string").alias("value"), F.lit(most).alias("most")) for n, p, most in counted])).alias("x")).select(*keys, "x.*")
        counts = each.groupBy(*keys, "c", "value", "most").agg(F.count("*").alias("count"))
        rank = F.row_number().over(Window.partitionBy(*keys, "c").orderBy(F.desc("count"), "value"))
        first = counts.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("most"))
        listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == n, F.struct("_rank", "value", "count")))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(f"{n}__top_count")
        out = joined(out, first.groupBy(*keys).agg(*[listed(n) for n, _, _ in counted]))
    if numbers:
        each = df.select(*_keys(partition, group_by), F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(p).cast("double").alias("v")) for n, p in numbers])).alias("x")).select(*keys, "x.*").filter("v is not null")
        if exact:
            points = _exact_quantiles(each, [*_varying(partition, group_by), "c"], PICKS)
            points = points.select(*[F.col(k) if k in points.columns else F.lit(None).cast("string").alias(k) for k in keys], "c", "q")
        else:
            points = each.groupBy(*keys, "c").agg(F.percentile_approx("v", F.array(*[F.lit(p / 1000) for p in PICKS]), _ACCURACY).alias("q"))
        low, high = F.col("q")[PICKS.index(250)], F.col("q")[PICKS.index(750)]
        points = points.withColumns({"base": low - 1.5 * (high - low), "step": (high - low) / 5})
        edged = joined(each.withColumnRenamed("c", "_c"), points, "inner").filter(F.col("c") == F.col("_c"))
        bucket = F.when(F.col("step") > 0, F.greatest(F.lit(0), F.least(F.lit(EDGES + 1), F.floor((F.col("v") - F.col("base")) / F.col("step")) + 1))).otherwise(F.lit(0)).cast("int")
        buckets = edged.groupBy(*keys, "c", "base", "step", bucket.alias("bucket")).agg(F.count("*").alias("count"))
        start = F.when((F.col("step") > 0) & (F.col("bucket") > 0), F.col("base") + F.col("step") * (F.col("bucket") - 1))
        end = F.when((F.col("step") > 0) & (F.col("bucket") <= EDGES), F.col("base") + F.col("step") * F.col("bucket"))
        one = F.struct("bucket", start.alias("low"), end.alias("high"), "count")
        bars = buckets.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == n, one))).alias(f"{n}__histogram") for n, _ in numbers])
        pairs = F.transform(F.arrays_zip(F.array(*[F.lit(p / 10) for p in PICKS]).alias("key"), F.col("q").alias("value")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
        quant = points.groupBy(*keys).agg(*[F.any_value(F.when(F.col("c") == n, pairs), True).alias(f"{n}__quantiles") for n, _ in numbers])
        out = joined(joined(out, quant), bars)
    return out
