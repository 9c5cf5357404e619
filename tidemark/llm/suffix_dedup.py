"""Removal of repeated byte strings by distributed prefix doubling.

A byte is removed if a string of `length` bytes that covers it also starts earlier (in a smaller document, or earlier in
the same one).  Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

Each round sorts positions by a pair of ranks, the rank that the last round gave and the name of the bytes at the next
offset, and numbers the classes anew.  A position whose string is unique drops out; one whose string has reached the
threshold and is not the first of its class is a repeat.

Positions are thinned first, without loss: of the NAME-byte strings in a window of `length` bytes, the one whose hash is
least (the leftmost of equal ones) is the window's anchor, so equal windows have equal anchors at equal places, and only
anchors need a rank.  The windows that an anchor stands for are a run of starts at or before it.

1. Anchors are sorted by (name of their NAME bytes, name of the bytes from there to `length`), which ranks the strings of
   NAME and of `length` bytes.  An anchor with a unique name drops out, with its windows.
2. Anchors are sorted by (rank of `length` bytes, distance to the next anchor, its rank).  A pair that is not the first of
   its class is a longer string that starts earlier, and every window in it is a repeat.  So the inside of long
   repeats is settled.  Anchors whose windows are not, and that share their name with another such, go on.
3. Their windows, in blocks of BLOCK neighbours, are sorted by (rank of the anchor's name, name of the bytes that all
   windows of the block have, name of the bytes that any has).  Unique ones drop out, whole blocks that are not first
   are repeats, and what shares its inner bytes only goes on.
4. Single windows are sorted by (rank of those bytes, name of the rest): past the threshold, one that is not first is a
   repeat.

Sorts are range-partitioned with the position as last key, so a string that a third of all documents share is spread
over many tasks.  Where the ranges of anchors begin is taken from a sample of short passages, which only balances tasks:
every anchor of every document is named once and sent to its range.  Ranks are dense: two rows for each partition, with its first and its last pair, tell where its numbers
start and whether its first class began before.  Names are 64-bit hashes of bytes.

Nulls and edge cases: a null text is empty; documents shorter than `length` bytes keep all; rows with equal doc_ids are
separate documents, in the order of their texts' hashes, and equal rows in any order (only the first keeps a shared
string); null doc_ids come first; a very long text is read in segments; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import global_rank, materialise, mix64, pieces, spread, type_of

LENGTH, NAME, BLOCK = 100, 40, 16

#: Bytes that are worked on at once.
PIECE = 2 << 20

#: One passage in so many, of so many bytes, shows how names are spread.
SHOWN, PASSAGE = 16, 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1024)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


class Names:
    """Names of all strings of some concatenated texts, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive items."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(names: Names, ends: np.ndarray, own: np.ndarray, length: int, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start, value) of each anchor and the run of windows that it stands for.

    `ends` are the ends of the texts; each has `own` starts to look at.
    """
    none = np.zeros(0, np.int64)
    value = names.all(name) | np.uint64(1)
    if len(names.sums) - 1 < length:
        return none, none, none, none.view(np.uint64)
    least = _least(value, length - name + 1)
    for first, end, n in zip(np.r_[0, ends[:-1]], ends, own, strict=True):
        least[max(first, min(first + n, end - length + 1)) : end] = 0
    # A run ends where the least value changes, or where its anchor is the start itself.
    new = np.r_[True, (least[1:] != least[:-1]) | (value[: len(least) - 1] == least[:-1])]
    low = np.flatnonzero(new)
    high = np.r_[low[1:], len(least)] - 1
    low, high = low[least[low] > 0], high[least[low] > 0]
    wanted = least[low]
    at = high.copy()
    left = np.flatnonzero(value[at] != wanted)
    while len(left):
        at[left] += 1
        left = left[value[at[left]] != wanted[left]]
    return at, low, high, wanted


def _segments(batch: pd.DataFrame, length: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, base, own, ends, data) of texts joined to pieces of bounded size; long texts come in segments.

    Of each, `own` starts are looked at, `most` at most.
    """
    found = []
    for row, text in enumerate(_texts(batch)):
        for base in range(0, max(1, len(text)), PIECE):
            found.append((row, base, min(most, PIECE), text if len(text) <= PIECE else text[base : base + PIECE + 2 * length]))
    for part in pieces(np.array([len(x[3]) for x in found], np.int64), PIECE):
        row, base, own, texts = zip(*found[part], strict=True)
        data = np.frombuffer(b"".join(texts), np.uint8)
        yield np.array(row), np.array(base, np.int64), np.array(own, np.int64), np.cumsum(np.array([len(t) for t in texts], np.int64)), data


def _texts(batch: pd.DataFrame) -> list[bytes]:
    return [b"" if t is None else bytes(t) for t in batch["data"]]


def _longs(**columns: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({k: v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64) for k, v in columns.items()})


def spot(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A place with its run of starts, in one number that orders by place."""
    return (at << 16) | ((at - high) << 8) | (high - low)


def run_of(column: str = "spot") -> tuple[Column, Column, Column]:
    """(place, first start, last start) of a spot."""
    at = F.shiftright(column, 16)
    high = at - F.shiftright(column, 8).bitwiseAND(F.lit(255))
    return at, high - F.col(column).bitwiseAND(F.lit(255)), high


def positions(docs: DataFrame, length: int, name: int, bounds: list[tuple] | None = None, most: int = PIECE) -> DataFrame:
    """(name, rest, uid, spot) of every anchor of `docs` (uid, begin, data); with `bounds`, also part, its range.

    Places count from `begin`; of each row, anchors of its first `most` starts are given.
    """
    least = wide(*np.array(bounds, np.int64).reshape(-1, 4).T) if bounds is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uid, begin = batch["uid"].to_numpy(), batch["begin"].to_numpy()
            for row, base, own, ends, data in _segments(batch, length, most):
                names = Names(data)
                at, low, high, value = anchors(names, ends, own, length, name)
                owner = np.searchsorted(ends, at, side="right")
                shift = (begin[row] + base)[owner] - np.r_[0, ends][owner]
                rest = names.of(at + name, np.minimum(ends[owner], at + length))
                out = _longs(name=value, rest=rest, uid=uid[row[owner]], spot=spot(at + shift, low + shift, high + shift))
                yield out if least is None else out.assign(part=part_of(out, bounds, least))

    return docs.select("uid", "begin", "data").mapInPandas(run, "name long, rest long, uid long, spot long" + (", part int" if bounds is not None else ""))


def wide(*keys: np.ndarray) -> np.ndarray:
    """Rows of signed keys as byte strings in the same order."""
    rows = np.stack([k.astype(np.int64).view(np.uint64) for k in keys], axis=1) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * len(keys)}").ravel()


def part_of(rows: pd.DataFrame, bounds: list[tuple], least: np.ndarray) -> np.ndarray:
    """The range of each row: the number of bounds at or before it.  `least` are the bounds by `wide`."""
    first = np.array([b[0] for b in bounds], np.int64)
    name = rows["name"].to_numpy()
    part = np.searchsorted(first, name, side="right")
    # Few rows have the name of a bound, unless it is a common one; these are compared by all keys.
    close = np.flatnonzero(np.searchsorted(first, name) < part)
    part[close] = np.searchsorted(least, wide(*(rows[c].to_numpy()[close] for c in ("name", "rest", "uid", "spot"))), side="right")
    return part.astype(np.int32)


def ranges(docs: DataFrame, length: int, name: int) -> list[tuple]:
    """Where the ranges of anchors begin, but the first: one (name, rest, uid, spot) for each partition of a shuffle."""
    first = F.pmod(F.xxhash64("uid"), F.lit(SHOWN)) * PASSAGE
    begins = F.when(first < F.octet_length("data"), F.sequence(first, F.octet_length("data").cast("long"), F.lit(SHOWN * PASSAGE).cast("long")))
    passage = lambda begin: F.struct(begin.alias("begin"), F.substring("data", (begin + 1).cast("int"), F.lit(PASSAGE + 2 * length)).alias("data"))
    some = docs.select("uid", F.inline(F.transform(begins, passage)))
    order = ["name", "rest", "uid", "spot"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(positions(some, length, name, most=PASSAGE)).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    least = laid.groupBy("part").agg(F.min(F.struct(*order)).alias("least")).collect()
    return sorted(tuple(r["least"]) for r in least)[1:]


def _numbered(outer: list[str], inner: list[str], carry: list[str]):
    """Numbers the classes of a sorted partition, drops those unique by their outer keys and adds the partition's ends."""
    keys = [*outer, *inner]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = first = last = None
        n_outer = n_inner = -1
        for batch in _with_end(batches):
            rows = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            part = rows["part"].iloc[0]
            key = rows[keys].to_numpy(np.int64)
            before = np.vstack([key[:1] - 1 if last is None else last, key[:-1]])
            same = key == before
            if last is None:
                same[0] = False
            same_outer, same_inner = same[:, : len(outer)].all(axis=1), same.all(axis=1)
            a, b = n_outer + np.cumsum(~same_outer), n_inner + np.cumsum(~same_inner)
            # The last row waits for the one after it.
            cut = len(rows) - (batch is not None)
            unique = ~same_outer & ~np.r_[same_outer[1:], False]
            keep = np.flatnonzero((~unique | (a == 0) | (np.arange(len(rows)) == len(rows) - 1))[:cut])
            first = key[:1] if first is None else first
            if cut:
                last, n_outer, n_inner = key[cut - 1 : cut], a[cut - 1], b[cut - 1]
                out = rows.iloc[keep][["uid", "spot", *carry]]
                yield out.assign(outer=a[keep], inner=b[keep], first=~same_inner[keep], part=part, ends=None)
            held = rows.iloc[cut:]
        if last is not None:
            blank = {c: [None, None] for c in carry}
            yield pd.DataFrame({"uid": 0, "spot": 0, **blank, "outer": [0, n_outer], "inner": [0, n_inner], "first": False, "part": part, "ends": [list(first[0]), list(last[0])]})

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def rerank(rows: DataFrame, outer: list[str], inner: list[str], carry: str = "", parts: int = 0) -> DataFrame:
    """(uid, spot, carried columns, outer, inner, first): rows sorted by the keys, then by position, with dense ranks.

    `outer` and `inner` become the ranks by the outer keys and by all keys; `first` tells the first position of an inner
    class.  Rows that are unique by their outer keys drop out (but at the ends of partitions).  With `parts`, rows come
    with the one of so many ranges that they lie in, as `part`; else Spark samples them, which takes a run of its own.
    """
    order = [*outer, *inner, "uid", "spot"]
    names = [c.split()[0] for c in carry.split(",") if c.strip()]
    laid = rows.repartitionById(parts, "part") if parts else rows.repartitionByRange(*order)
    laid = laid.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"uid long, spot long, {carry + ', ' if carry else ''}outer long, inner long, first boolean, part int, ends array<long>"
    made = materialise(laid.mapInPandas(_numbered(outer, inner, names), schema))
    ends: dict[int, list] = {}
    for r in made.filter("ends is not null").select("part", "outer", "inner", "ends").orderBy("part", "inner").collect():
        ends.setdefault(r["part"], []).append(r)
    starts, a, b, last = [], 0, 0, None
    for part, found in sorted(ends.items()):
        head, tail = found[0]["ends"], found[-1]["ends"]
        goes_on_outer, goes_on = last is not None and head[: len(outer)] == last[: len(outer)], head == last
        starts.append((part, a - goes_on_outer, b - goes_on, goes_on))
        a, b, last = a - goes_on_outer + found[-1]["outer"] + 1, b - goes_on + found[-1]["inner"] + 1, tail
    # One row for each partition.
    table = rows.sparkSession.createDataFrame(starts, "part int, a long, b long, goes_on boolean")
    out = made.filter("ends is null").join(F.broadcast(table), "part")
    first = F.col("first") & ~((F.col("inner") == 0) & F.col("goes_on"))
    return out.select("uid", "spot", *names, (F.col("outer") + F.col("a")).alias("outer"), (F.col("inner") + F.col("b")).alias("inner"), first.alias("first"))


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs twice or more."""
    return rows.join(rows.groupBy(key).count().filter("count > 1").select(key), key)


def chained(ranked: DataFrame, length: int) -> DataFrame:
    """(uid, rank, at, low, high, start, ends): each anchor of `ranked` with its open windows and its chain of repeats.

    An anchor that the one before leads to by a repeated pair is in its chain, which begins at `start`; `ends` tells
    the last anchor of a chain.  In a chain of two or more, windows from `start` on are settled; those from `low` to
    `high` are open.
    """
    by_place = Window.partitionBy("uid").orderBy("spot")
    pairs = ranked.withColumn("next", F.lead("inner").over(by_place)).withColumn("gap", F.shiftright(F.lead("spot").over(by_place), 16) - F.shiftright("spot", 16))
    pairs = pairs.filter(F.col("gap") <= length).select(F.col("inner").alias("rank"), "gap", "next", "uid", "spot")
    again = rerank(pairs, ["rank", "gap"], ["next"]).filter("not first")
    both = ranked.select("uid", "spot", F.col("outer").alias("rank"), F.lit(0).alias("kind")).unionByName(again.select("uid", "spot", F.lit(None).cast("long").alias("rank"), F.lit(1).alias("kind")))
    by_kind = Window.partitionBy("uid").orderBy("spot", "kind")
    leads = (F.lead("kind").over(by_kind) == 1) & (F.lead("spot").over(by_kind) == F.col("spot"))
    rows = both.withColumn("leads", F.coalesce(leads, F.lit(False))).filter("kind = 0")
    at, low, high = run_of()
    broken = ~F.coalesce(F.lag("leads").over(by_place), F.lit(False))
    start = F.max(F.when(F.col("broken"), at)).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("broken", broken).withColumn("start", start)
    chain = F.col("leads") | ~F.col("broken")
    high = F.when(chain, F.least(high, F.col("start") - 1)).otherwise(high)
    return rows.select("uid", "rank", at.alias("at"), low.alias("low"), high.alias("high"), "start", (~F.col("leads")).alias("ends"))


def blocks(docs: DataFrame, length: int, name: int) -> DataFrame:
    """(rank, block, core, hull, uid, spot, reach) of the open windows of each row (uid, data, rank, at, low, high), in
    blocks; the last four are arrays with an item for each anchor, by place.

    A block has the windows at BLOCK neighbouring distances from their anchor; `reach` are their bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = []
            for row, (text, at) in enumerate(zip(_texts(batch), batch["at"], strict=True)):
                # Of a long text, the anchors of a segment and what is around them.
                for base in range(0, len(text), PIECE):
                    one = slice(*np.searchsorted(at, (base, base + PIECE))) if len(text) > PIECE else slice(0, len(at))
                    start = max(0, base - length)
                    cut.append((row, one, start, text[start : base + PIECE + 2 * length] if len(text) > PIECE else text))
            for part in pieces(np.array([len(x[3]) for x in cut], np.int64), PIECE):
                row, each, start, texts = zip(*cut[part], strict=True)
                size = np.array([len(t) for t in texts], np.int64)
                data = b"".join(texts)
                n = np.array([x.stop - x.start for x in each], np.int64)
                if not n.sum():
                    continue
                # Places count into `data`; `shift` leads back to the text's own.
                begin, end, shift = (np.repeat(x, n) for x in (np.cumsum(size) - size, np.cumsum(size), np.cumsum(size) - size - np.array(start, np.int64)))
                uid = np.repeat(batch["uid"].to_numpy()[list(row)], n)
                rank, at, low, high = (np.concatenate([batch[c].iloc[r][x] for r, x in zip(row, each, strict=True)]) for c in ("rank", "at", "low", "high"))
                first, last = (at - high) // BLOCK, (at - low) // BLOCK
                block = spread(first, last - first + 1)
                rank, at, low, high, begin, end, shift, uid = (np.repeat(x, last - first + 1) for x in (rank, at + shift, low + shift, high + shift, begin, end, shift, uid))
                near, far = block * BLOCK, np.minimum(block * BLOCK + BLOCK - 1, length - name)
                low, high = np.maximum(low, at - far), np.minimum(high, at - near)
                names = Names(np.frombuffer(data, np.uint8))
                a, b = np.maximum(begin, at - far), np.minimum(end, at - near + length)
                core, hull = names.of(at - near, at - far + length), names.of(a, b) + mix64((at - a).astype(np.uint64))
                out = _longs(rank=rank, block=block, core=core, hull=hull, uid=uid, spot=spot(at - shift, low - shift, high - shift))
                yield out.assign(reach=[data[x:y] for x, y in zip(low.tolist(), (high + length).tolist(), strict=True)])

    return docs.select("uid", "data", "rank", "at", "low", "high").mapInPandas(run, "rank long, block long, core long, hull long, uid long, spot long, reach binary")


def windows(rows: DataFrame, length: int, name: int) -> DataFrame:
    """(rank, offset, name, uid, spot) of each window of blocks (outer, uid, spot, reach); its spot is its start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch["reach"].map(len).to_numpy(), PIECE):
                rows = batch.iloc[part]
                data = [bytes(x) for x in rows["reach"]]
                size = np.array([len(x) for x in data], np.int64)
                each = size - length + 1
                names = Names(np.frombuffer(b"".join(data), np.uint8))
                start = spread(np.cumsum(size) - size, each)
                packed, rank, uid = (np.repeat(rows[c].to_numpy(), each) for c in ("spot", "outer", "uid"))
                at = packed >> 16
                s = at - ((packed >> 8) & 255) - (packed & 255) + spread(np.zeros(len(each), np.int64), each)
                near = (at - s) // BLOCK * BLOCK
                far = np.minimum(near + BLOCK - 1, length - name)
                # The window's bytes before and after those that all windows of its block have.
                begin, end = start + (at - near - s), start + (at - far + length - s)
                rest = mix64(names.of(start, begin) * _BASE + names.of(end, start + length))
                yield _longs(rank=rank, offset=at - s, name=rest, uid=uid, spot=s)

    return rows.select("outer", "uid", "spot", "reach").mapInPandas(run, "rank long, offset long, name long, uid long, spot long")


def repeats(docs: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """(uid, low, high): spans, which may overlap, of bytes to remove, of `docs` (uid, data); uids are unique and ordered.

    A span may reach past the end of its text; what is left of it counts if it has a whole window.
    """
    if not 0 <= length - name < 256:
        raise ValueError("a window may have 255 bytes more than a name at most")
    bounds = ranges(docs, length, name)
    ranked = rerank(positions(docs.withColumn("begin", F.lit(0).cast("long")), length, name, bounds), ["name"], ["rest"], parts=len(bounds) + 1)
    chains = materialise(chained(ranked, length))
    inside = chains.filter("ends and start < at").select("uid", F.col("start").alias("low"), (F.col("at") + length).alias("high"))
    goes_on = shared(chains.filter("low <= high").select("rank", "uid", "at", "low", "high"), "rank")
    goes_on = goes_on.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high", "rank"))).alias("open"))
    goes_on = goes_on.select("uid", *[F.col(f"open.{c}").alias(c) for c in ("rank", "at", "low", "high")])
    edges = rerank(materialise(blocks(docs.join(goes_on, "uid"), length, name)), ["rank", "block", "core"], ["hull"], "reach binary")
    _, low, high = run_of()
    whole = edges.filter("not first").select("uid", low.alias("low"), (high + length).alias("high"))
    single = rerank(windows(shared(edges.filter("first"), "outer"), length, name), ["rank", "offset"], ["name"]).filter("not first")
    return inside.unionByName(whole).unionByName(single.select("uid", F.col("spot").alias("low"), (F.col("spot") + length).alias("high")))


def remove(docs: DataFrame, length: int = LENGTH, name: int = NAME, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs` (doc_id, text); with `texts`, also
    spans (the maximal removed runs, from and to) and kept (the remaining bytes)."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", data.alias("data"))
    numbered = type_of(docs, "doc_id") in ("tinyint", "smallint", "int", "bigint")
    odd = not numbered or docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if odd:
        keyed = materialise(rows.select("doc_id", F.xxhash64("doc_id", "data").alias("key"), "data"))
        # Equal rows are told apart by any number, so that many of them are spread over tasks.
        rows = global_rank(keyed.withColumn("tie", F.monotonically_increasing_id()), ["doc_id", "key", "tie"]).select("doc_id", F.col("rank").alias("uid"), "data")
    else:
        rows = rows.withColumn("uid", F.col("doc_id").cast("long"))
    spans = repeats(rows.select("uid", "data"), length, name)
    each = spans.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, raw, found in zip(batch["doc_id"], _texts(batch), batch["spans"], strict=True):
                merged = union(found, len(raw), length)
                view, ends = memoryview(raw), [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(view[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if merged else raw
                out.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *(([list(m) for m in merged], kept) if texts else ())))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(("spans", "kept") if texts else ())])
            yield frame.astype({"doc_id": "Int64"}) if numbered else frame

    schema = f"doc_id {type_of(docs, 'doc_id')}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.join(each, "uid", "left").select("doc_id", "data", "spans").mapInPandas(run, schema + (", spans array<array<long>>, kept binary" if texts else ""))


def union(found: list | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, of those that have a whole window; spans that touch are one run."""
    if found is None or len(found) == 0:
        return []
    pairs = sorted((int(x["low"]), min(int(x["high"]), size)) for x in found)
    out: list[tuple[int, int]] = []
    for low, high in pairs:
        if high - low < length:
            continue
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out
