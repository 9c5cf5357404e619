"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are dealt to logical partitions by a hash.  From the counts of the partitions, the driver draws how many rows
each partition sends to each shard: without replacement from the shards' remaining room, which is the exact law of
those counts in a uniform random permutation (a matrix of numbers: partitions x shards, never rows).  Each partition
permutes its rows locally and cuts them by its row of the matrix; the rows are exchanged; each shard permutes again,
which gives the slots.  A shard is permuted in blocks of hash order, so that no task holds a whole shard.

Only DataFrame functions touch the rows.  All random numbers come from the seed and a row's own columns, so a retried
task or a rerun deals alike.

Law `rows`: shard sizes differ by at most one.  Nulls and edge cases: null columns are ordinary values; repeated rows
are separate rows and may land in different shards; rows of any size are dealt whole; columns named shard and slot are
replaced, and all others, whatever their names, come through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, packed

#: Equal rows beyond which they are told apart by number.
MANY = 10_000

#: Logical partitions: one for each so many rows, within these bounds.
ROWS_PER_PARTITION, FEWEST, MOST = 50_000, 256, 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good.

    The probabilities around the mode follow from their exact ratios, so the population may be of any size; values
    more than 12 standard deviations away (mass below 1e-30) are left out.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    deviation = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(1, total - 1))
    reach = int(12 * deviation) + 30
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    ratio = (good - k[:-1]) * (n - k[:-1]) / ((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    logs = np.r_[0.0, np.cumsum(np.log(ratio))]
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(mass, rng.random() * mass[-1], side="right"), len(k) - 1)])


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; columns add up to shard sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for count in counts:
        row, left, others = [], count, sum(room)
        for s in range(n_shards):
            others -= room[s]
            row.append(hypergeometric(rng, room[s], others, left))
            left -= row[-1]
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` (row, hash) with `copy`, which tells apart the rows that are equal in very many.

    Equal rows would all be dealt alike.  Where more than MANY rows share a hash, they are counted and written out
    again from their count, in chunks, so no task has them all.  Nothing depends on the order in which rows come.
    """
    many = materialise(rows.groupBy("hash").count().filter(F.col("count") > MANY).select("hash"))
    if not many.limit(1).count():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    counted = rows.join(many, "hash", "left_semi").groupBy("row", "hash").count()
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / MANY)))).repartition("hash", "chunk")
    copies = F.sequence(F.col("chunk") * MANY + 1, F.least(F.col("count"), (F.col("chunk") + 1) * MANY))
    again = chunks.select("row", "hash", F.explode(copies).alias("copy"))
    return rows.join(many, "hash", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def shard(df: DataFrame, n_shards: int = 8, seed: int = 29) -> DataFrame:
    """`df` with shard (0 to n_shards - 1) and slot (gapless from 0 within the shard)."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    rows = numbered(packed(df, hash=F.xxhash64(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0).cast("long")))
    n_parts = int(min(MOST, max(FEWEST, df.count() // ROWS_PER_PARTITION)))
    key = lambda k: F.xxhash64(F.lit(seed + k), "hash", "copy")
    dealt = rows.select("row", F.pmod(key(0), F.lit(n_parts)).cast("int").alias("part"), key(1).alias("first"), key(2).alias("second"), key(3).alias("third"))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)
    cuts = spark.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in enumerate(matrix)], "part int, cuts array<long>")
    # One row per logical partition, at most MOST: the size of this broadcast is bounded.
    local = dealt.join(F.broadcast(cuts), "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    n_blocks = max(1, n_parts // n_shards * 2)
    shard_of = F.size(F.filter("cuts", lambda c: c < F.col("place")))
    sent = local.select("row", shard_of.alias("shard"), F.pmod(F.col("third"), F.lit(n_blocks)).cast("int").alias("block"), "second")
    sizes = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most n_shards * n_blocks rows, which is within twice MOST.
    placed = sent.withColumn("place", F.row_number().over(Window.partitionBy("shard", "block").orderBy("second")))
    out = placed.join(F.broadcast(starts), ["shard", "block"]).select("row", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
    return out.select(*([F.col("row.*")] if names else []), "shard", "slot")
