"""A training corpus in five stages, each by one operator, each written before the next reads it.

All stages decide by row, not by doc_id, so null and repeated doc_ids say nothing of other rows; other columns, whatever
their names, come through as they are (only `shard` and `slot` are replaced, by the last stage); an empty table stays
empty; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from tidemark.llm.common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.  Null and empty texts, and all of fewer than ten words, go; rows that are
    alike stay or go together."""
    return quality_rules.keep(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more.

    That with the least doc_id stays, nulls last, and of rows that are alike one; texts without words all stay.
    """
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.  Texts without words stay; null and empty items match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source by its weight; documents may come twice.

    A null source is one of its own; rows that are alike share their copies; a text without words takes none of a
    source's words.
    """
    return mixing.mix(docs)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; rows that are alike may land in different shards."""
    return sharding.shard(docs, n_shards=8)


STAGES = [("quality rules", keep_good), ("n-gram jaccard join", keep_one), ("benchmark decontamination", keep_clean), ("mixing to target weights", mix_sources), ("sharding", deal)]

#: Tokenisers and hashes of shingles have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
