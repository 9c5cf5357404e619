"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A word, wherever a contract speaks of words: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that deletes a query's shuffle files when it ends; a table that is written needs them no more.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names, or else below its warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tidemark/{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts its lineage and survives lost executors.

    The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as one struct column, `row`, beside columns made from its own; no name of the one can clash with the other's.

    `select("row.*")` gives the columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def type_of(df: DataFrame, name: str) -> str:
    """The type of a column, as a schema's text has it."""
    return df.schema[name].dataType.simpleString()


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `rank`, the place of each row in the order of some columns, from 0; nulls first.

    Range partitions number their rows locally; a table with one row per partition gives the offsets.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows))], [*batch.schema.names, "_local"])
            n += batch.num_rows

    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    laid = materialise(laid.mapInArrow(number, StructType([*laid.schema.fields, StructField("_local", LongType())])))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return laid.join(parts, "_part").withColumn("rank", F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


#: Bits of a bitmap of 64-bit names, by their last bits.
BITS = 24


def bitmap(df: DataFrame, name: Column) -> np.ndarray:
    """A bitmap of the last BITS bits of a column of 64-bit names; it comes to the driver in blocks of 4 KB, 2 MB in all."""
    place = df.select(name.bitwiseAND(F.lit((1 << BITS) - 1)).alias("place"))
    blocks = place.groupBy(F.shiftright("place", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for block, data in blocks.collect():
        bits[block] = np.frombuffer(data, np.uint8)
    return bits.ravel()


def in_bitmap(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of some 64-bit names the bitmap may have."""
    place = names.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast where the counted rows are within the limit; beyond it, Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items of about `most` in total size, so that array work on a batch has bounded memory."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield slice(at, len(sizes))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (public-domain splitmix64 finaliser constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts as codes: (code of each word, number of words of each text, the distinct words)."""
    split = [_blanks(text).split(" ") if text else [] for text in texts]
    counts = np.fromiter((len(w) for w in split), np.int64, len(split))
    flat = np.empty(int(counts.sum()), object)
    at = 0
    for words in split:
        flat[at : at + len(words)] = words
        at += len(words)
    keep = flat != ""
    if not keep.all():
        owner = np.repeat(np.arange(len(split)), counts)[keep]
        counts = np.bincount(owner, minlength=len(split)).astype(np.int64)
        flat = flat[keep]
    codes, words = factorize(flat, any(text and "\0" in text for text in texts))
    return codes, counts, words


def factorize(values: np.ndarray, nulls: bool) -> tuple[np.ndarray, np.ndarray]:
    """The place of each string among the distinct ones, and those.  pandas reads strings up to a null character, so such are told apart here."""
    if not nulls:
        return pd.factorize(values)
    place: dict[str, int] = {}
    codes = np.fromiter((place.setdefault(v, len(place)) for v in values), np.int64, len(values))
    words = np.empty(len(place), object)
    words[:] = list(place)
    return codes, words


def grams(flat: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the n-grams within texts; a non-empty text of fewer words is one n-gram."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = max(0, len(flat) - n + 1)
    name = np.zeros(starts, np.uint64)
    for k in range(n):
        name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + starts])
    at = np.flatnonzero(owner[:starts] == owner[n - 1 :]) if starts else np.zeros(0, np.int64)
    name = name[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        own = [np.uint64(0)] * len(short)
        for i, s in enumerate(short):
            h = np.zeros(1, np.uint64)
            for w in flat[first[s] : first[s] + counts[s]]:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
            own[i] = mix64(h + np.uint64(counts[s]))[0]
        name, at = np.r_[name, np.array(own, np.uint64)], np.r_[at, first[short]]
        order = np.argsort(at, kind="stable")
        name, at = name[order], at[order]
    return name, at


def _blanks(text: str) -> str:
    """ASCII white space, and no other, as blanks."""
    for space in "\n\t\r\x0b\x0c":
        if space in text:
            text = text.replace(space, " ")
    return text


class WordTable:
    """Token ids of the distinct words that a worker has met, in flat arrays.

    `encode` maps new words to all their ids, one word after the other, and the number of ids of each.  Beyond `most`
    words, those met in one piece only are dropped: the table saves work, and has no part in results.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000) -> None:
        self.encode, self.most = encode, most
        self.place: dict[str, int] = {}
        self.starts, self.ids, self.met = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _drop(self) -> None:
        keep = np.flatnonzero(self.met > 1)[-self.most // 2 :]
        words = list(self.place)
        size = np.diff(self.starts)[keep]
        self.ids = self.ids[spread(self.starts[keep], size)]
        self.starts = np.r_[0, np.cumsum(size)]
        self.met = np.ones(len(keep), np.int32)
        self.place = {words[k]: i for i, k in enumerate(keep)}

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, number of ids) of each of some distinct words, and the ids that the places count into."""
        if len(self.place) > self.most:
            self._drop()
        place = self.place
        fresh = [w for w in words if w not in place]
        if fresh:
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            flat, size = self.encode(fresh)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, flat])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int32)])
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self.met[at] += 1
        return self.starts[at], self.starts[at + 1] - self.starts[at], self.ids


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
