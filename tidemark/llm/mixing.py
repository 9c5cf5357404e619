"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words.  Within a source each document has the same expected number of copies,
target / source size.  Documents are laid out by (size, id), the expected copies are prefix-summed, one random offset
per source is added, and a document is emitted once for each integer boundary that its interval crosses.  Laying out
by size makes the sample stratified: the words taken differ from the target by at most about one document.

The prefix sum is distributed: documents are range-partitioned by (source, size, id), so a source that holds a third
of all rows is spread over many tasks; each partition sums locally, and a small table of partition totals gives the
offsets.

Nulls and edge cases: a null or empty text has size 0 and is still laid out (its copies take no words); a null source
is a source of its own, ordered last; repeated rows are separate documents with adjacent intervals; a text of any
length is one document; other columns, whatever their names, come through `mix` as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import global_rank, materialise, n_words, packed, type_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source.

    `sizes` has one row per source: (source, source_size).  The budget (a share of all words) goes to the sources by
    weight; a target stops at `most` times the source's size and the excess is shared again by weight among the rest.
    That ends where target = min(most * size, level * weight), so one pass over the sources in order of
    most * size / weight finds the level.  Null sources come last.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1)
    out = (
        sizes.withColumn("_place", F.row_number().over(by_name))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_words", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)))
        .withColumn("_free", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0)))
        .withColumn("_level", (F.col("_words") - F.col("_capped")) / F.col("_free"))
        # The first source, in this order, whose cap is not below the level fixes the level of all that follow; capping
        # more sources than that would only lower it, so it is the highest.
        .withColumn("_open", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_level", F.max("_open").over(everything))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return out.select("source", "source_size", F.round(target, 6).alias("target"))


def copies(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, n_copies) for every row of `docs` (doc_id, text, source)."""
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    laid = slim.repartitionByRange(F.col("source").asc_nulls_last(), "size", "doc_id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id")
    # Written once: the partition numbers and local places that follow must never be derived from two different shuffles.
    laid = materialise(laid.withColumn("_part", F.spark_partition_id()).mapInPandas(_places, f"doc_id {type_of(docs, 'doc_id')}, source {type_of(docs, 'source')}, size long, _part int, _place long"))
    totals = laid.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_size")
    targets = source_targets(totals.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, budget, most)
    parts = parts.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    parts = parts.select("_source", F.col("_part").alias("_p"), "_before", "source_size", "target")
    placed = laid.join(parts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("_before") + F.col("_place")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))
    offset = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = F.floor(offset + rate * (place + 1)) - F.floor(offset + rate * place)
    return placed.select("doc_id", "source", "size", "source_size", "target", crossed.cast("int").alias("n_copies"))


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each source within a sorted partition from 0."""
    last, n = None, 0
    for batch in batches:
        if len(batch):
            source = batch["source"].astype(object).where(batch["source"].notna(), None)
            new = np.r_[True, (source.values[1:] != source.values[:-1])]
            starts = np.flatnonzero(new)
            place = np.arange(len(batch)) - np.repeat(starts, np.diff(np.r_[starts, len(batch)]))
            if last is not None and last[0] == source.iloc[0]:
                first = starts[1] if len(starts) > 1 else len(batch)
                place[:first] += n
            last, n = (source.iloc[-1],), int(place[-1]) + 1
            yield batch.assign(source=source, _place=place)


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed table: each row of `docs` as often as the sampling takes it, with the columns of `docs`.

    Copies are looked up by doc_id, source and text size.  Rows that repeat all three share the sum of their copies
    evenly, in the order of their texts.
    """
    taken = copies(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("n_copies").alias("n"), F.count("*").alias("rows"))
    taken = materialise(taken.filter("n > 0")).withColumnsRenamed({"doc_id": "id_", "source": "source_", "size": "size_"})
    each = packed(docs, id=F.col("doc_id"), source=F.col("source"), size=n_words(F.col("text")))
    # Neither side is bounded, so the plan is the same at every size: a join by shuffle.
    joined = each.join(taken.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
    out = joined.filter("rows = 1").select("row", F.col("n").alias("k"))
    if taken.filter("rows > 1").limit(1).count():
        many = materialise(joined.filter("rows > 1").select("id", "source", "size", "row", "n", "rows", F.xxhash64("row.text").alias("text")))
        # A range sort, so that rows that are all alike are spread over tasks; any number tells them apart.
        order = ["id", "source", "size", "text", "tie"]
        placed = global_rank(many.withColumn("tie", F.monotonically_increasing_id()), order)
        first = placed.groupBy("id", "source", "size").agg(F.min("rank").alias("first")).withColumnsRenamed({"id": "id_", "source": "source_", "size": "size_"})
        placed = placed.join(first, F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
        place = F.col("rank") - F.col("first")
        share = F.floor(F.col("n") * (place + 1) / F.col("rows")) - F.floor(F.col("n") * place / F.col("rows"))
        out = out.unionByName(placed.select("row", share.alias("k")))
    return out.filter("k > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).select("row.*")
