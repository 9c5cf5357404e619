"""Ranked lexical search over a length-stratified index.

A document's score for a query is the sum, over the query's terms with repeats, of w * ((10^9 tf) div (1000 tf + 12 m)):
w is the term's weight, tf its occurrences in the document, and m a normaliser that depends on the document's length
alone.  Documents of equal m form a stratum.  Within one, an impact depends on term and tf only, so postings lie by term
and tf there and each impact is computed once for a run of equal tf.  The largest impacts of a stratum bound what any of
its documents can score: a query visits strata by falling bound and stops at the first that cannot reach its last place.

One pass over the texts counts the terms that the queries have; the counts are written, and from them come the corpus
figures (documents, terms in all, documents of each term).  Counted documents are laid out by m and doc_id in range
partitions, so that a stratum of any size spreads over tasks; each task keeps the best of each query, and one window
ranks what tasks kept.  Queries go in blocks of a stated size, each against all documents.

Nulls and edge cases: a null, empty or term-free text is in no stratum and found by no query; a query without terms that
any document has gives no row; rows with equal or null doc_ids are documents of their own (null ids rank first among
equal scores); rows with equal item_ids are queries of their own; a text of any length is counted whole; empty tables
give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import materialise, spread

#: Queries of one pass over the documents, and bytes of their texts; their terms are what is broadcast.
BLOCK, BLOCK_BYTES = 5_000, 16 << 20

#: Bytes of UTF-8 as terms have them: A-Z in lower case, what separates terms as a blank, others as they are.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in turn."""
    return text.translate(_TERM_BYTES).split() if text else []


def counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n with repeats; terms by place in the vocabulary, others left out."""
    place = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    ints = ArrayType(IntegerType())
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType()), StructField("terms", ints), StructField("tfs", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = place.value.get
        for batch in batches:
            kept, n, found, tfs, size = [], [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                words = terms(text.as_py())
                if words:
                    own = Counter(map(get, words))
                    own.pop(None, None)
                    kept.append(i)
                    n.append(len(words))
                    size.append(len(own))
                    found += own
                    tfs += own.values()
            ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weights(n_docs: int, found_in: np.ndarray) -> np.ndarray:
    """The weight of each term, by the number of documents that have it; 0 where none has."""
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) if df else 0 for df in found_in.tolist()], np.int64)


@dataclass
class Stratum:
    """Postings of documents of one m: by term, then by falling tf, with the impact of each."""

    document: np.ndarray
    impact: np.ndarray
    #: The terms that occur, where the postings of each begin, how many there are, and the impact of the first.
    terms: np.ndarray
    first: np.ndarray
    size: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(m: int, document: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> Stratum:
        order = np.lexsort((document, -tf, term))
        document, term, tf = document[order], term[order], tf[order].astype(np.int64)
        new_term = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        run = np.flatnonzero(new_term | np.r_[True, tf[1:] != tf[:-1]]) if len(term) else np.zeros(0, np.int64)
        impact = weight[term[run]] * ((1_000_000_000 * tf[run]) // (1000 * tf[run] + 12 * m))
        impact = np.repeat(impact, np.diff(np.r_[run, len(term)]))
        first = np.flatnonzero(new_term)
        return Stratum(document, impact, term[first], first, np.diff(np.r_[first, len(term)]), impact[first])

    def of_query(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """The places among this stratum's terms of those that a query has, and how often it has each."""
        at = np.searchsorted(self.terms, query.terms)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == query.terms[hit]
        return at[hit], query.times[hit]

    def scores(self, at: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """The scores of all `n` documents."""
        out = np.zeros(n, np.int64)
        places = spread(self.first[at], self.size[at])
        np.add.at(out, self.document[places], self.impact[places] * np.repeat(times, self.size[at]))
        return out


@dataclass
class Query:
    """A query's terms, and its best documents so far as (score, order of the id, id)."""

    terms: np.ndarray
    times: np.ndarray
    best: list[tuple[int, tuple, object]] = field(default_factory=list)

    def offer(self, ids: list, scores: np.ndarray, k: int) -> None:
        self.best += [(int(s), (i is not None, i if i is not None else 0), i) for s, i in zip(scores, ids, strict=True)]
        self.best.sort(key=lambda x: x[1])
        self.best.sort(key=lambda x: -x[0])
        del self.best[k:]

    def floor(self, k: int) -> int:
        """What a document has to score: as much as the last place, or anything above 0."""
        return self.best[-1][0] if len(self.best) >= k else 1


def visit(strata: list[tuple[pa.Array, Stratum]], query: Query, k: int) -> int:
    """Let a query meet strata by falling bound, as far as they can matter; the number that it met."""
    found = [s.of_query(query) for _, s in strata]
    bound = np.array([int((s.most[at] * times).sum()) for (_, s), (at, times) in zip(strata, found, strict=True)], np.int64)
    for met, i in enumerate(np.argsort(-bound, kind="stable")):
        if bound[i] < query.floor(k):
            return met
        ids, stratum = strata[i]
        score = stratum.scores(*found[i], len(ids))
        good = np.flatnonzero(score >= query.floor(k))
        if len(good) > k:
            # Equal scores at the last place all stay, to be told apart by their ids.
            good = good[score[good] >= np.partition(score[good], -k)[-k]]
        query.offer(ids.take(pa.array(good)).to_pylist(), score[good], k)
    return len(strata)


def _strata(batch: pa.RecordBatch, weight: np.ndarray) -> list[tuple[pa.Array, Stratum]]:
    """The documents of each m of a batch, which is in order of m, with their postings."""
    m = batch["m"].to_numpy()
    lists = batch["terms"]
    ends = lists.offsets.to_numpy()
    term, tf = (x.values.to_numpy(zero_copy_only=False) for x in (lists, batch["tfs"]))
    cuts = np.r_[np.flatnonzero(np.r_[True, m[1:] != m[:-1]]), len(m)] if len(m) else [0]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(ends[a], ends[b])
        document = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        out.append((batch["doc_id"].slice(a, b - a), Stratum.of(int(m[a]), document, term[part], tf[part], weight)))
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    rows = items.select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).toLocalIterator()
    found = [_search(docs, items, block, k) for block in _blocks(rows)]
    return reduce(DataFrame.unionByName, found) if found else _search(docs, items, [], k)


def _blocks(rows: Iterator) -> Iterator[list]:
    block, size = [], 0
    for row in rows:
        if block and (len(block) >= BLOCK or size + len(row[1]) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield block


def _search(docs: DataFrame, items: DataFrame, block: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms(bytes(text))) for _, text in block]
    vocabulary = sorted(set().union(*asked))
    counted = materialise(counts(docs, vocabulary))
    corpus = counted.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("n_terms")).first()
    found_in = np.zeros(len(vocabulary), np.int64)
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        found_in[term] = df
    place = {t: i for i, t in enumerate(vocabulary)}
    queries = []
    for own in asked:
        at = sorted((place[t], c) for t, c in own.items())
        queries.append((np.array([t for t, _ in at], np.int32), np.array([c for _, c in at], np.int64)))
    given = spark.sparkContext.broadcast((weights(corpus.n_docs, found_in), queries))
    m = F.expr(f"75 + (25 * n * {corpus.n_docs}L) div {corpus.n_terms}L")
    laid = counted.filter(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m")).repartitionByRange("m", "doc_id").sortWithinPartitions("m")
    doc_id = docs.schema["doc_id"]
    schema = StructType([StructField("item", LongType()), StructField(doc_id.name, doc_id.dataType), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, own = given.value
        own = [Query(*q) for q in own]
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            strata = _strata(batch, weight)
            for query in own:
                visit(strata, query, k)
        best = [(i, b) for i, query in enumerate(own) for b in query.best]
        if best:
            columns = [pa.array([i for i, _ in best], pa.int64()), pa.array([b[2] for _, b in best], kind), pa.array([b[0] for _, b in best], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    place_of = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = laid.mapInArrow(run, schema).withColumn("rank", F.row_number().over(place_of)).filter(F.col("rank") <= k)
    kind = StructField("item_id", items.schema["item_id"].dataType)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], StructType([StructField("item", LongType()), kind]))
    # As many rows as the block has queries.
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
