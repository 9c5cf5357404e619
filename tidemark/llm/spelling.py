"""Groups of words that differ by one letter, from blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of one or two,
and lengths that differ by one at most.  Products of two blocks of count vectors give the squared distances of all their
pairs at once (|a|^2 + |b|^2 - 2ab); the pairs at one or two are verified letter by letter.

Blocks are cells: a length, cut further by how many of a word's letters fall into each of five classes of letters.  One
edit moves at most one letter from one class to another, or adds or takes one, so a cell has to meet itself, the cells of
its length that are one such move away, and those of the next length with one letter more: sixteen at most, each pair of
cells once.  A cell's words are dealt into chunks of a bounded size, and so are the words of its neighbours, so a group
of one task is bounded however many words a cell has.

Joins are sort-merge joins by hint.  Spark takes a table of words for as large as its compressed file, also after an
explode that makes sixteen rows of each, and would broadcast either.

`count` counts words of texts, `near` finds the pairs, `group` gives each word its form and root.

Nulls and edge cases: a null or empty text has no words; a null doc_id counts as the empty text where it decides on
deletions; repeated rows count again; a text or word of any length is read whole; ties between forms go to the smallest
in code-point order; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Words that a task counts before it hands them on; they meet again in the aggregate.
HELD = 400_000

#: Words of a chunk, on either side of a product.
LEFT, RIGHT = 4_096, 32_768

#: Bytes of Latin-1 as words have them: letters, A-Z in lower case; all else is a blank.
_LETTERS = bytes(b if b >= 0xC0 or chr(b).isalpha() and b < 0x80 else 0x20 for b in bytes(range(256)).lower())

#: Classes of letters: by falling frequency in turn, the rest by code point.  Any classes give the same pairs.
N_CLASSES = 5
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
_CLASS = {c: i % N_CLASSES for i, c in enumerate(_COMMON)} | {chr(c): c % N_CLASSES for c in range(0xC0, 0x100)}

_CLASS_OF = np.array([_CLASS.get(chr(b), 0) for b in range(256)])


def count(docs: DataFrame, delete_one_in: int | None = None) -> DataFrame:
    """(word, n): the words of all texts (doc_id, text) and their occurrences.

    With `delete_one_in`, a word of a document whose crc32 of "<doc_id>:<word>" that number divides loses the letter at
    crc32 % length there, which plants misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                if not text:
                    continue
                own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                if delete_one_in:
                    own = _with_deletions(f"{doc_id.as_py() or ''}:", own, delete_one_in)
                total.update(own)
                if len(total) > HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_deletions(key: str, own: Counter[bytes], one_in: int) -> Counter[bytes]:
    begun = zlib.crc32(key.encode())
    crc32 = zlib.crc32
    hit = [w for w in own if not crc32(w if w.isascii() else w.decode("latin-1").encode(), begun) % one_in]
    taken = [(w, own.pop(w)) for w in hit]
    for word, n in taken:
        at = crc32(word.decode("latin-1").encode(), begun) % len(word)
        own[word[:at] + word[at + 1 :]] += n
    return own


def _counted(total: Counter[bytes]) -> pa.RecordBatch:
    words = [w.decode("latin-1") for w in total if w]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n for w, n in total.items() if w], pa.int64())], ["word", "n"])


def _cell(word: Column) -> Column:
    """How many letters of a word fall into each class."""
    letters = "".join(_CLASS)
    digits = F.translate(word, letters, "".join(str(_CLASS[c]) for c in letters))
    return F.array(*[F.length(digits) - F.length(F.replace(digits, F.lit(str(i)), F.lit(""))) for i in range(N_CLASSES)])


#: Moves from a cell to those that it meets: itself, one letter from a later class to an earlier one, one letter more.
_MOVES = [[0] * N_CLASSES]
_MOVES += [[(k == i) - (k == j) for k in range(N_CLASSES)] for i in range(N_CLASSES) for j in range(i + 1, N_CLASSES)]
_MOVES += [[int(k == i) for k in range(N_CLASSES)] for i in range(N_CLASSES)]


def _moved(cell: Column, sign: int) -> Column:
    """All cells one move away, on (1) or back (-1)."""
    moves = F.array(*[F.array(*[F.lit(sign * x) for x in move]) for move in _MOVES])
    moved = F.transform(moves, lambda move: F.zip_with(cell, move, lambda a, b: a + b))
    return F.filter(moved, lambda c: F.forall(c, lambda x: x >= 0))


def near(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): each two words (word, n) that differ by one letter, once."""
    placed = words.select("word", "n", _cell(F.col("word")).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("own"))
    meets = sizes.select(F.explode(_moved(F.col("cell"), -1)).alias("cell"), "own").groupBy("cell").agg(F.sum("own").alias("met"))
    chunks = meets.join(sizes.hint("merge"), "cell").select("cell", F.ceil(F.col("own") / LEFT).alias("lefts"), F.ceil(F.col("met") / RIGHT).alias("rights"))
    chunk = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = placed.join(chunks.hint("merge"), "cell").select("cell", chunk(F.col("lefts")).alias("i"), every(F.col("rights")).alias("j"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = placed.select(F.explode(_moved(F.col("cell"), -1)).alias("cell"), "word", "n").join(chunks.hint("merge"), "cell")
    right = right.select("cell", every(F.col("lefts")).alias("i"), chunk(F.col("rights")).alias("j"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    key = ["cell", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pairs, "a string, b string, a_n long, b_n long")


def _letters(words: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of some words, the rows that have it and their letters."""
    words = words.to_pylist()
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    first = np.cumsum(size) - size
    return {int(k): (rows := np.flatnonzero(size == k), flat[first[rows][:, None] + np.arange(k)]) for k in np.unique(size)}


def _counts(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), 256), np.float32)
    np.add.at(out, (np.arange(len(letters))[:, None], letters), 1)
    return out


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of one chunk of a cell and one chunk of what the cell meets."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    others = _letters(right["b"])
    for size, (rows_a, letters_a) in _letters(left["a"]).items():  # a cell has one length
        counts_a = _counts(letters_a)
        cell = np.bincount(_CLASS_OF[letters_a[0]], minlength=N_CLASSES)
        for more in (0, 1):
            rows_b, letters_b = others.get(size + more, (None, letters_a[:0]))
            for at_a, at_b in _close(counts_a, letters_b):
                x, y = letters_a[at_a], letters_b[at_b]
                ok = _one_apart(x, y)
                if not more:
                    # A cell meets itself: each two words of it once.
                    home = (np.sort(_CLASS_OF[y], axis=1) == np.repeat(np.arange(N_CLASSES), cell)).all(axis=1)
                    ok &= ~home | (x < y).any(axis=1)
                out_a.append(rows_a[at_a[ok]])
                out_b.append(rows_b[at_b[ok]])
    i, j = pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))
    a, b = left.take(i), right.take(j)
    return pa.table({"a": a["a"], "b": b["b"], "a_n": a["a_n"], "b_n": b["b_n"]})


def _close(counts_a: np.ndarray, letters_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose letter counts are at a squared distance of one or two, block by block."""
    for start in range(0, len(letters_b), 1024):
        counts_b = _counts(letters_b[start : start + 1024])
        used = np.flatnonzero(counts_b.any(axis=0) | counts_a.any(axis=0))
        x, y = counts_a[:, used], counts_b[:, used]
        # One product gives minus the squared distance: the norms go as two columns more.
        x = np.c_[2 * x, -(x * x).sum(axis=1), -np.ones(len(x), np.float32)]
        y = np.c_[y, np.ones(len(y), np.float32), (y * y).sum(axis=1)]
        gram = x @ y.T
        at = np.flatnonzero((gram > -2.5) & (gram < -0.5))
        yield at // len(y), start + at % len(y)


def _one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced letter, or by one more in b."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    # Up to the first difference they agree at the same place, from there on at the next.
    k = a.shape[1]
    agree = np.cumprod(a == b[:, :k], axis=1, dtype=bool).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=bool).sum(axis=1)
    return agree + behind >= k


def group(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each of which is there once.

    A word's form is its near word of largest n, if that is at least `times` the word's own; its root is where forms end.
    """
    pairs = near(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    # The largest n and, of those, the smallest word.
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    own = words.join(found.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.col("form_n") >= times * F.col("n")
    own = materialise(own.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    return own.join(_roots(own, times).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(own: DataFrame, times: int) -> DataFrame:
    """(word, root) of the words that have a form.

    Each step takes every word twice as far.  A form is `times` as frequent, so steps end after the logarithm of the
    largest n.
    """
    links = own.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = own.agg(F.max("n")).first()[0] or 1
    for _ in range(ceil(log(max(2.0, log(most) / log(times) + 1), 2))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def variants(docs: DataFrame, delete_one_in: int | None = None, least_length: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """`group` of the words of `docs` (doc_id, text) that are long and frequent enough."""
    words = count(docs, delete_one_in).filter((F.length("word") >= least_length) & (F.col("n") >= least_n))
    return group(materialise(words), times)
