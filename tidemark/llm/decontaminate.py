"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Texts are read as normalised words (lower case, letters and digits only; in scripts without spaces each character is one).
One pass over the corpus counts the n-grams that any test item has, by a bitmap of fixed size.  An item's seeds are its
rarest n-grams by that count: of G it leaves out the G / 12 most common ones, such as a phrase that many questions
share.  So a text that has more than G / 12 of an item's n-grams has a seed of it, whichever they are, and one that has
fewer if one of them is a seed.  A second pass cuts the passages around seeds; items of like length have one bitmap and
one margin, so a short item makes short passages whatever other items there are.  A join by seed pairs passages and items,
each pair once, and removes what bitmaps let through.  Smith-Waterman alignment of words (match 2, mismatch and gap -1)
scores each pair; the score is a share of the item's perfect score, and pairs from `least` on are contamination.

Joins are by n-gram or passage, never of all with all.  An item found in a third of all documents gives one row per
document and item; nothing is capped.

Nulls and edge cases: null or empty texts and items have no n-grams and match nothing; an item shorter than n words is
one seed, looked for in documents as a run of that many words (so an item of one common word is found wherever it is);
items or documents that repeat are matched separately.  Ids may be of any type.  A document is known by its doc_id and
text: rows that repeat both are one, a repeated or null doc_id says nothing of other texts, and an item_id that repeats
gives one row with the best score; a text of any length is read in passages; other columns, whatever their names, come
through `clean` as they are; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import bitmap, grams, in_bitmap, materialise, mix64, packed, pieces, spread, word_codes

#: Words of a seed, and the least score.
N, LEAST = 4, 0.5

#: One in so many of an item's n-grams, the most common ones, are no seeds.  Words of the shortest reach.
COMMON, LEAST_REACH = 12, 32

#: Words of a passage beyond which it is cut into overlapping ones.
LONGEST = 2048

_NOT_WORD = re.compile(r"[\W_]+")

#: Characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Bopomofo, Han.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_HAS_ALONE, _WORDS = re.compile(f"[{_ALONE}]"), re.compile(f"[{_ALONE}]|[^{_ALONE}]+")


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of texts, one text after the other, and the number of words of each."""
    codes, counts, words = word_codes(texts)
    bare = np.array([w.lower() if w.isalnum() else _NOT_WORD.sub("", w.lower()) for w in words], object)
    size = (bare != "").astype(np.int64)
    alone = {i: _WORDS.findall(w) for i, w in enumerate(bare) if not w.isascii() and _HAS_ALONE.search(w)}
    for i, w in alone.items():
        size[i] = len(w)
    kinds = np.array([x for i, w in enumerate(bare) if w for x in alone.get(i, (w,))], object) if alone else bare[size > 0]
    hashes = pd.util.hash_array(kinds, categorize=False) | np.uint64(1) if len(kinds) else np.zeros(0, np.uint64)
    if not len(codes) or (size == 1).all():
        return hashes[codes] if len(codes) else np.zeros(0, np.uint64), counts
    each = size[codes]
    total = np.r_[0, np.cumsum(each)]
    ends = np.cumsum(counts)
    return hashes[spread((np.cumsum(size) - size)[codes], each)], total[ends] - total[ends - counts]


def seeds(flat: np.ndarray, counts: np.ndarray, n: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the n-grams within texts and of the runs of some lesser lengths, by place."""
    found = [grams(flat, counts, n)]
    owner = np.repeat(np.arange(len(counts)), counts)
    for size in lengths:
        starts = max(0, len(flat) - size + 1)
        name = np.zeros(starts, np.uint64)
        for k in range(size):
            name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + starts])
        at = np.flatnonzero(owner[:starts] == owner[size - 1 :]) if starts else np.zeros(0, np.int64)
        # As `grams` names a text that is shorter than n.
        found.append((mix64(name[at] + np.uint64(size)), at))
    if len(found) == 1:
        return found[0]
    name, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return name[order], at[order]


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, gram, words) for each n-gram of each item; `words` is the whole item."""
    longs = ArrayType(LongType())
    schema = StructType([items.schema["item_id"], StructField("gram", LongType()), StructField("words", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = hashed_words([t or "" for t in batch["text"].to_pylist()])
            name, at = grams(flat, counts, n)
            first = np.cumsum(counts) - counts
            owner = np.searchsorted(first + counts, at, side="right")
            whole = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), flat.view(np.int64))
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(of), pa.array(name.view(np.int64)), whole.take(of)], schema.names)

    return items.select("item_id", "text").mapInArrow(run, schema)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def gram_counts(docs: DataFrame, bits: np.ndarray, n: int, lengths: list[int]) -> DataFrame:
    """(gram, n): in how many texts an n-gram of the bitmap is."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), 4 << 20):
                flat, counts = hashed_words(texts[part])
                name, at = seeds(flat, counts, n, lengths)
                hit = in_bitmap(shared.value, name)
                name, owner = name[hit], np.searchsorted(np.cumsum(counts), at[hit], side="right")
                order = np.lexsort((owner, name))
                name, owner = name[order], owner[order]
                new = np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])][: len(name)]
                kinds, times = np.unique(name[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def rare_seeds(known: DataFrame, counted: DataFrame) -> DataFrame:
    """(item, item_id, words, reach, gram) of the seeds of each item: all its n-grams but the G / COMMON most common.

    `item` names an item, `reach` is its length as the next power of two, from LEAST_REACH on.
    """
    size = F.size("words")
    reach = F.greatest(F.lit(LEAST_REACH), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))))).cast("int")
    each = known.withColumn("item", F.xxhash64("item_id", "words")).select("item", "item_id", "words", reach.alias("reach"), "gram").dropDuplicates(["item", "gram"])
    of = Window.partitionBy("item")
    ranked = each.join(counted.hint("merge"), "gram", "left").withColumns({"_rank": F.row_number().over(of.orderBy(F.coalesce("n", F.lit(0)), "gram")), "_all": F.count("*").over(of)})
    return ranked.filter(F.col("_rank") <= F.col("_all") - F.floor(F.col("_all") / COMMON)).drop("_rank", "_all", "n")


def passages(docs: DataFrame, bits: dict[int, np.ndarray], least: float, n: int, lengths: list[int]) -> DataFrame:
    """(key, doc_id, reach, at, words, grams) of the passages that have an n-gram of a bitmap, with a margin on each side.

    There is a bitmap for the items of each reach.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    longs = ArrayType(LongType())
    schema = StructType([StructField("key", LongType()), docs.schema["doc_id"], StructField("reach", IntegerType()), StructField("at", IntegerType()), StructField("words", longs), StructField("grams", longs)])

    def cut(hits: np.ndarray, margin: int) -> Iterator[tuple[int, int]]:
        """Runs of hits that lie within the margin of each other, none much longer than LONGEST."""
        breaks = np.flatnonzero(np.diff(hits) > margin) + 1
        for run in np.split(np.arange(len(hits)), breaks):
            while len(run):
                end = int(np.searchsorted(hits[run], hits[run[0]] + LONGEST))
                yield int(run[0]), int(run[end - 1]) + 1
                if end == len(run):
                    break
                # The next piece begins a margin earlier, so that no copy is cut by both.
                run = run[min(end, max(1, int(np.searchsorted(hits[run], hits[run[end]] - margin)))) :]

    def around(flat: np.ndarray, counts: np.ndarray, name: np.ndarray, at: np.ndarray, reach: int) -> Iterator[tuple]:
        """(text, place of the passage in it, words, n-grams) around hits."""
        # A copy that scores enough has matched words and gaps: matches count 2, gaps cost 1, and 2 a word is perfect.
        margin = int(reach * (3 - 2 * least)) + n
        first = np.cumsum(counts) - counts
        owner = np.searchsorted(first + counts, at, side="right")
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(owner)) + 1):
            o = owner[own[0]]
            for a, b in cut(at[own], margin):
                low, high = max(first[o], at[own[a]] - margin), min(first[o] + counts[o], at[own[b - 1]] + n + margin)
                yield o, reach, low - first[o], flat[low:high].view(np.int64), name[own[a:b]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), 4 << 20):
                flat, counts = hashed_words(texts[part])
                name, at = seeds(flat, counts, n, lengths)
                rows = []
                for reach, known in shared.value.items():
                    hit = np.flatnonzero(in_bitmap(known, name))
                    if len(hit):
                        rows += around(flat, counts, name[hit], at[hit], reach)
                if rows:
                    of = pa.array([part.start + int(r[0]) for r in rows], pa.int64())
                    columns = [pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int64())), (4, pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([batch["key"].take(of), batch["doc_id"].take(of), *columns], schema.names)

    return docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(run, schema)


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each row of `items` with the same row of `texts`, and where it ends in both.

    Rows are padded with 0 (items) and 1 (texts), which match nothing.  A gap costs the same for each word, so the best
    way to reach a cell along a row of the matrix is a running maximum.
    """
    n, width = texts.shape
    slope = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width), np.int32)
    best, end, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        step = np.where(texts == items[:, i : i + 1], np.int32(2), np.int32(-1))
        step[:, 1:] += row[:, :-1]
        row = np.maximum(np.maximum(step, row - 1), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better], last[better] = top[better], at[better], i
    return best, end, last


def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align (key, doc_id, item_id, at, words, item) pairs; gives the ids, score, first_word and last_word of the copy."""
    for batch in batches:
        words, item = batch["words"], batch["item"]
        width, tall = np.diff(words.offsets.to_numpy()), np.diff(item.offsets.to_numpy())
        words, item = (np.split(x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1]) for x, size in ((words, width), (item, tall)))
        order = np.lexsort((tall, width))
        for part in pieces(width[order] * 1, 1 << 18):
            rows = order[part]
            found = []
            for flip in (1, -1):
                a = np.zeros((len(rows), tall[rows].max()), np.int64)
                b = np.ones((len(rows), width[rows].max()), np.int64)
                for k, r in enumerate(rows):
                    a[k, : tall[r]] = item[r][::flip]
                    b[k, : width[r]] = words[r][::flip]
                found.append(align(a, b))
            (best, end, _), (_, back, _) = found
            start = width[rows] - 1 - back
            at = batch["at"].to_numpy()[rows].astype(np.int64)
            of = pa.array(rows)
            ids = [batch[c].take(of) for c in ("key", "doc_id", "item_id")]
            values = [best / (2.0 * tall[rows]), at + np.minimum(start, end), at + np.maximum(start, end)]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, values)], ["key", "doc_id", "item_id", "score", "first_word", "last_word"])


def row_matches(docs: DataFrame, items: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """(key, doc_id, item_id, score, first_word, last_word) of the copies of items in documents."""
    known = materialise(item_grams(items, n))
    lengths = sorted(r["size"] for r in known.filter(F.size("words") < n).select(F.size("words").alias("size")).distinct().collect())
    chosen = materialise(rare_seeds(known, gram_counts(docs, bitmap(known, F.col("gram")), n, lengths)))
    # As many bitmaps as lengths of items have binary logarithms.
    bits = {r["reach"]: bitmap(chosen.filter(F.col("reach") == r["reach"]), F.col("gram")) for r in chosen.select("reach").distinct().collect()}
    found = materialise(passages(docs, bits, least, n, lengths).withColumn("passage", F.xxhash64("key", "reach", "at", "words")))
    hits = found.select("passage", "reach", F.explode(F.array_distinct("grams")).alias("gram"))
    pairs = hits.join(chosen.select("item", "reach", "gram"), ["gram", "reach"]).select("passage", F.col("item").alias("of")).distinct()
    whole = chosen.select(F.col("item").alias("of"), "item_id", F.col("words").alias("item")).dropDuplicates(["of"])
    joined = pairs.join(found.select("passage", "key", "doc_id", "at", "words").dropDuplicates(["passage"]), "passage").join(whole, "of")
    ids = [StructField("key", LongType()), docs.schema["doc_id"], items.schema["item_id"]]
    schema = StructType([*ids, StructField("score", DoubleType()), StructField("first_word", LongType()), StructField("last_word", LongType())])
    scored = joined.select("key", "doc_id", "item_id", "at", "words", "item").mapInArrow(score_pairs, schema).filter(F.col("score") >= least)
    best = scored.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("best"))
    return best.select("key", "doc_id", "item_id", "best.score", "best.first_word", "best.last_word")


def matches(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of the copies of items, for each document that differs."""
    return row_matches(docs, items, **options).drop("key")


def clean(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` without a copy of an item."""
    dirty = row_matches(docs, items, **options).select("key").distinct()
    return packed(docs, key=row_key()).join(dirty, "key", "left_anti").select("row.*")
