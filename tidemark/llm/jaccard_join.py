"""N-gram Jaccard join by prefix trees.

A document's set holds the hashes of its distinct n-word shingles.  Two documents link when
100 * intersection >= percent * union.  Equal sets are one class, and all work below is on classes.

1. Shingles get a global order from the corpus counts of their rarest word (a shingle is no more frequent than that),
   then by hash.  Linked classes share `least` or more of a set's `size` shingles, least = ceil(percent * size / 100),
   so they share one of its first p = size - least + 1, and k of its first p + k - 1.  With k = 1 + p / 2, that prefix
   is kept of each class.  Two classes share the lesser of their k's, so a class with fewer prefix shingles in other
   prefixes than the k of the smallest size that can link with it links with nothing, and most leave here.  Its index
   are the shared ones of the first p.
2. All links come from tries.  A trie stores whole sets as paths in the global order (most frequent shingle first, so
   that copies share paths).  A class walks it with the overlap of the path so far; a subtree is left when its remaining
   length cannot reach the needed overlap, or when it is in the walker's component.
3. First tries: a class goes home to the index shingle that most classes have.  The home's sets are dealt to chunks of
   bounded weight, and the one with the largest share of its prefix in the index stands first in each chunk's trie, so
   most copies of a text, however many, become one component, each stored once.
4. Second tries: what is left is the pairs of classes in different components that share an index shingle.  Only
   shingles with two components or more go on, once for each distinct group of classes.  Groups of the same copies
   differ by a few classes each, so they are gathered: a class names its largest group, a group goes to the one that
   most of its classes name.  The largest component gathered needs no comparison within itself, and classes are dealt to
   tasks in chunks of bounded weight, pairwise, so no group is whole in one task and no pair is lost.

Links found inside one component are not all listed: the result is each document's component.

Joins by shingle or class are by shuffle at every size (Spark splits hot keys of such a join): neither side is bounded.

Nulls and edge cases: a text without words, or null, has an empty set and links with nothing (its component is its own
doc_id); a text of fewer words than a shingle is one shingle, of its whole sequence; a text of any length is one set;
rows that repeat a doc_id are separate documents; rows with a null doc_id get the component's smallest doc_id, or null;
one_of_each goes by rows, so neither makes it keep two of a component; other columns, whatever their names, come through
it as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grams, materialise, mix64, packed, pieces, word_codes
from tidemark.llm.components import components

#: Shingles in all the sets that a task compares on one side.
WEIGHT = 500_000

#: Shingles of a path that are compared at once.
STEP = 32

#: Bits of the table of word counts.
BUCKETS = 18

UPPER = {c: c + 32 for c in range(65, 91)}


def _hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z in lower case."""
    lower = np.array([w.lower() if w.isascii() else w.translate(UPPER) for w in words], object)
    return pd.util.hash_array(lower, categorize=False) | np.uint64(1) if len(lower) else np.zeros(0, np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS)).astype(np.int64)


def word_levels(docs: DataFrame) -> np.ndarray:
    """Of each bucket of words, the binary logarithm of its count over all texts.

    Words share buckets, so the table's size is fixed; that only blurs the order of shingles, which any order keeps right.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), 3 << 20):
                codes, _, words = word_codes(texts[part])
                np.add.at(total, _bucket(_hashes(words)), np.bincount(codes, minlength=len(words)))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    counts = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << BUCKETS, np.uint64)
    levels[counts["bucket"].to_numpy()] = np.log2(counts["n"].to_numpy()).astype(np.uint64) + 1
    return np.minimum(levels, np.uint64(63))


def shingles(texts: list[str], n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, one text after the other, and the number of each text.

    A shingle is a 58-bit hash below the 6-bit level of its rarest word; a text of fewer words is of level 0.
    """
    codes, counts, words = word_codes(texts)
    hashes = _hashes(words)
    flat = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    name, at = grams(flat, counts, n)
    owner = np.searchsorted(np.cumsum(counts), at, side="right")
    level = np.r_[levels[_bucket(hashes)][codes], np.zeros(n, np.uint64)] if len(codes) else np.zeros(n, np.uint64)
    least = level[at]
    for k in range(1, n):
        least = np.minimum(least, level[at + k])
    least[counts[owner] < n] = 0
    name = (least << np.uint64(58)) | (name >> np.uint64(6))
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    new = np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])][: len(name)]
    return name[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def prefix(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """p and k of sets: the first p shingles have one that a linked set shares, the first p + k - 1 have k."""
    p = size - (size * percent + 99) // 100 + 1
    return p, 1 + p // 2


def sets(docs: DataFrame, n: int, percent: int, levels: np.ndarray, whole: bool = False) -> DataFrame:
    """(key, size, p, k, cid, hashes and the other columns) of each row of `docs` (key, text and others).

    `cid` names the set; `hashes` is its prefix, or all of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), 3 << 20):
                name, size = shingles(texts[part], n, shared.value)
                ends = np.cumsum(size)
                total = np.r_[np.uint64(0), np.cumsum(mix64(name + np.uint64(7)))]
                cid = mix64(total[ends] - total[ends - size] + mix64(size.astype(np.uint64)))
                p, k = prefix(size, percent)
                wanted = size if whole else np.minimum(size, p + k - 1)
                name = name.view(np.int64)
                out = {f.name: batch[f.name].values[part] for f in others}
                yield pd.DataFrame(out | {"size": size, "p": p, "k": k, "cid": cid.view(np.int64), "hashes": [name[e - s : e - s + w] for e, s, w in zip(ends, size, wanted, strict=True)]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.mapInPandas(run, f"{schema}, size long, p long, k long, cid long, hashes array<long>")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def needed(size: Column, percent: int) -> Column:
    """Prefix shingles that a set shares with any set that links with it: the k of the smallest size that can."""
    least = lambda n: F.floor((n * percent + 99) / 100)
    smallest = least(size)
    return 1 + F.floor((smallest - least(smallest) + 1) / 2)


def survivors(slim: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes that share enough prefix shingles with others to link, with their `index`.

    A shingle is shared if it occurs under two names of sets.
    """
    each = slim.select("cid", F.posexplode("hashes").alias("place", "hash"), "p").select("cid", (F.col("place") < F.col("p")).alias("indexed"), "hash")
    shared = each.groupBy("hash").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low <> high").select("hash")
    found = each.join(materialise(shared).hint("merge"), "hash").groupBy("cid").agg(F.collect_set("hash").alias("found"), F.collect_set(F.when(F.col("indexed"), F.col("hash"))).alias("index"))
    out = classes.join(found, "cid").filter((F.size("found") >= needed(F.col("size"), percent)) & (F.size("index") > 0))
    return out.drop("found")


class Trie:
    """Sets as paths; each node holds an edge of shingles, the sets that end there, and bounds of those below."""

    __slots__ = ("edge", "children", "ends", "least", "longest", "below")

    def __init__(self, edge: list[int]) -> None:
        self.edge, self.children, self.ends, self.below = edge, {}, [], []
        self.least, self.longest = 1 << 62, 0

    def add(self, path: list[int], item: int, size: int) -> None:
        """Insert a set below this node, whose own edge is already matched."""
        node, at = self, 0
        while True:
            node.least, node.longest = min(node.least, size), max(node.longest, len(path) - at)
            node.below.append(item)
            if at == len(path):
                node.ends.append(item)
                return
            child = node.children.get(path[at])
            if child is None:
                child = node.children[path[at]] = Trie(path[at:])
            else:
                k, most = 1, min(len(child.edge), len(path) - at)
                while k < most and child.edge[k] == path[at + k]:
                    k += 1
                if k < len(child.edge):
                    child.split(k)
            at += len(child.edge)
            node = child

    def split(self, k: int) -> None:
        low = Trie(self.edge[k:])
        low.children, low.ends, low.below, low.least, low.longest = self.children, self.ends, list(self.below), self.least, self.longest
        self.longest += len(low.edge)
        self.edge, self.children, self.ends = self.edge[:k], {low.edge[0]: low}, []


def walk(root: Trie, probe: frozenset, size: int, me: int, find, sizes: np.ndarray, percent: int) -> Iterator[int]:
    """Sets in the trie that link with a probe of another component."""
    stack = [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        wanted = percent * (size + max(node.least, -(-size * percent // 100)))
        # The overlap can still grow by what is left on either side; a long edge is left as soon as that is too little.
        reaches = True
        for i in range(0, max(1, len(node.edge)), STEP):
            overlap += len(probe.intersection(node.edge[i : i + STEP]))
            most = overlap + min(node.longest + max(0, len(node.edge) - i - STEP), len(probe) - overlap)
            reaches = most * (100 + percent) >= wanted
            if not reaches:
                break
        if not reaches:
            continue
        mine = find(me)
        if len(node.below) <= 256 and all(find(x) == mine for x in node.below):
            continue
        for item in node.ends:
            if find(item) != mine and overlap * 100 >= (size + int(sizes[item]) - overlap) * percent:
                yield item
                mine = find(me)
        stack += [(child, overlap) for child in node.children.values()]


def trie_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Components that the links between the walkers and the others of one task make, as stars; rows are (cid, size, comp, hashes, walks, inner)."""
    rows = rows.drop_duplicates("cid")
    cid, sizes, walks = rows["cid"].to_numpy(), rows["size"].to_numpy(), rows["walks"].to_numpy()
    paths = [list(map(int, x))[::-1] for x in rows["hashes"]]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for i, comp in enumerate(rows["comp"]):
        parent[i] = first.setdefault(comp, i)
    root = Trie([])
    # Walkers of a task that has both sides meet among themselves only where `inner` says so.
    inner = bool(rows["inner"].any())
    found = []

    def visit(i: int) -> None:
        probe = frozenset(paths[i])
        while (hit := next(walk(root, probe, int(sizes[i]), i, find, sizes, percent), None)) is not None:
            found.append((i, hit))
            parent[find(i)] = find(hit)

    for i in np.flatnonzero(~walks):
        root.add(paths[i], i, int(sizes[i]))
    for i in np.flatnonzero(walks):
        visit(i)
        if inner:
            root.add(paths[i], i, int(sizes[i]))
    # As stars, so that the graph of all tasks' links has no long chains.
    centre: dict[int, int] = {}
    for i in (i for link in found for i in link):
        centre[find(i)] = min(centre.get(find(i), cid[i]), cid[i])
    stars = {(cid[i], centre[find(i)]) for link in found for i in link}
    return pd.DataFrame([x for x in stars if x[0] != x[1]], columns=["a", "b"]).astype("int64")


TRIE_LINKS = "a long, b long"


def home_edges(near: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links among the classes that have the same home."""
    each = near.select("cid", "size", (F.size("index") / F.col("p")).alias("share"), F.explode("index").alias("hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    members = each.join(counts.hint("merge"), "hash").groupBy("cid", "size", "share").agg(F.max(F.struct("n", "hash")).alias("top")).select("cid", "size", "share", F.col("top.hash").alias("home"))
    members = materialise(members)
    homes = members.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.max(F.struct("share", "cid")).alias("hub")).filter("n > 1")
    homes = homes.select("home", F.col("hub.cid").alias("hub"), F.ceil(F.col("weight") / WEIGHT).cast("int").alias("chunks"))
    chunk = F.when(F.col("cid") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", F.lit(3)), F.col("chunks")).cast("int")))
    dealt = members.join(homes, "home").select("home", F.explode(chunk).alias("chunk"), "cid", F.col("cid").alias("comp"), (F.col("cid") != F.col("hub")).alias("walks"), F.lit(True).alias("inner"))
    whole = dealt.join(full.select("cid", "size", "hashes"), "cid")
    return whole.groupBy("home", "chunk").applyInPandas(lambda rows: trie_links(rows, percent), TRIE_LINKS)


def gathered(near: DataFrame, comps: DataFrame) -> DataFrame:
    """(place, cid, comp, weight): the classes to compare at each place, all pairs that share an index shingle and are
    in different components being together at one place."""
    labelled = near.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    each = materialise(labelled.select("cid", "comp", F.col("size").alias("weight"), F.explode("index").alias("hash")))
    sign = F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("sign")
    groups = each.groupBy("hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), sign)
    groups = groups.filter("low <> high").groupBy("n", "sign").agg(F.min("hash").alias("hash"))
    members = materialise(each.join(groups.select("hash", "n").hint("merge"), "hash"))
    named = members.groupBy("cid").agg(F.max(F.struct("n", "hash")).alias("top")).select("cid", F.col("top.hash").alias("top"))
    votes = members.join(named.hint("merge"), "cid").groupBy("hash", "top").agg(F.count("*").alias("n"))
    place = votes.groupBy("hash").agg(F.max(F.struct("n", "top")).alias("best")).select("hash", F.col("best.top").alias("place"))
    return members.join(place.hint("merge"), "hash").select("place", "cid", "comp", "weight").distinct()


def rest_edges(near: DataFrame, full: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components that share an index shingle."""
    each = materialise(gathered(near, comps)).withColumnRenamed("place", "hash")
    by_comp = each.groupBy("hash", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    groups = by_comp.groupBy("hash").agg(F.max(F.struct("n", "comp", "weight")).alias("main"), F.sum("weight").alias("weight"))
    chunks = lambda w: F.greatest(F.lit(1), F.ceil(w / WEIGHT)).cast("int")
    groups = groups.select("hash", F.col("main.comp").alias("main"), chunks(F.col("weight") - F.col("main.weight")).alias("n_walk"), chunks(F.col("main.weight")).alias("n_main"))
    members = each.join(groups.hint("merge"), "hash").withColumn("walks", F.col("comp") != F.col("main"))
    chunk = F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("walks"), F.col("n_walk")).otherwise(F.col("n_main"))).cast("int")
    members = members.withColumn("chunk", chunk)
    # A task is (shingle, walking chunk a, side, chunk b): side 0 is the main component's chunk b, side 1 another walking chunk.
    one = lambda a, side, b, role, inner: F.struct(a.alias("a"), F.lit(side).alias("side"), b.alias("b"), F.lit(role).alias("role"), inner.alias("inner"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    as_main = F.transform(upto(F.col("n_walk")), lambda a: one(a, 0, F.col("chunk"), False, F.lit(False)))
    to_main = F.transform(upto(F.col("n_main")), lambda b: one(F.col("chunk"), 0, b, True, b == 0))
    later = F.filter(upto(F.col("n_walk")), lambda b: b > F.col("chunk"))
    earlier = F.filter(upto(F.col("n_walk")), lambda a: a < F.col("chunk"))
    to_walk = F.transform(later, lambda b: one(F.col("chunk"), 1, b, True, F.lit(False)))
    from_walk = F.transform(earlier, lambda a: one(a, 1, F.col("chunk"), False, F.lit(False)))
    dealt = members.withColumn("task", F.explode(F.when(F.col("walks"), F.concat(to_main, to_walk, from_walk)).otherwise(as_main)))
    dealt = dealt.select("hash", "cid", "comp", "task.a", "task.side", "task.b", F.col("task.role").alias("walks"), "task.inner")
    whole = dealt.join(full.select("cid", "size", "hashes"), "cid")
    return whole.groupBy("hash", "a", "side", "b").applyInPandas(lambda rows: trie_links(rows, percent), TRIE_LINKS)


def link(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(key, doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    return rows_linked(docs, n, percent).drop("first_key")


def rows_linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`link` with `first_key`, the key of the component's first row by doc_id (nulls last), then key."""
    levels = word_levels(docs)
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    slim = materialise(sets(keyed, n, percent, levels))
    of = F.min(F.struct("key", "size", "p", "k")).alias("of")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = materialise(slim.filter("size > 0").groupBy("cid").agg(first, of).select("cid", "first", "of.*"))
    near = materialise(survivors(slim.select("cid", "p", "hashes"), classes.drop("first"), percent))
    # Only the texts that stand for a class that is left are read again, for their whole sets.  Neither side is bounded,
    # so the plan is the same at every size: a join by shuffle.
    full = sets(keyed.select("key", "text").join(near.select("key").distinct().hint("merge"), "key", "left_semi"), n, percent, levels, whole=True)
    full = materialise(full.select("cid", "size", "hashes").dropDuplicates(["cid"]))
    homes = materialise(home_edges(near, full, percent))
    more = materialise(rest_edges(near, full, components(homes), percent))
    comps = components(homes.unionByName(more))
    joined = classes.select("cid", "first").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = joined.groupBy("comp").agg(F.min("first").alias("least"))
    named = joined.join(least, "comp").select("cid", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first_key"))
    out = slim.select("key", "doc_id", "size", "cid").join(named, "cid", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("key", "doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), "first_key")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are the first of their component; texts without words all stay.

    The first is that with the least doc_id, nulls last, then key.  Rows that repeat doc_id and text are copies too: one
    stays.
    """
    found = rows_linked(docs, n, percent)
    first = found.filter("n_shingles = 0 or key = first_key").groupBy("key")
    keys = materialise(first.agg(F.max(F.expr("n_shingles = 0")).alias("bare"), F.count("*").alias("n")))
    kept = packed(docs, key=row_key()).join(keys.hint("merge"), "key")
    # Only rows that repeat a key need the shuffle that tells them apart.
    if keys.filter("not bare and n > 1").limit(1).count():
        kept = kept.filter("bare or n = 1").unionByName(kept.filter("not bare and n > 1").dropDuplicates(["key"]))
    return kept.select("row.*")
