"""Ranked search, spelling variants and byte-pair encoding against brute force, on texts with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, lexical_search, spelling
from tidemark.llm.common import materialise, word_codes
from tidemark.llm.token_output import word_bpe_path

UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    return [" ".join(rng.choice(stems) for _ in range(rng.choice([1, 3, 20, 150]))) + rng.choice(["", ".", "\n", "!?"]) for _ in range(n)]


ODD = [None, "", " \n\t", "...", "Ab-C aB c", "a\x00b a\x00c", "\U0001f600 naïve Ünïcode 1st", "word " * 30000, "x" * 20000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated and null ids, repeated rows, and columns named like results."""
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(ODD)] + [(1, "word x", "en", "a", 1), (None, "a null id", None, None, None), (None, "a null id", None, None, None), (3, "word", "en", "a", 1)]
    return spark.createDataFrame([(*r, 9, "n", 3) for r in rows], DOCS + ", rank int, item string, word int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(docs, items, k):
    """(item number, rank, doc_id, score) by scoring every document for every item."""
    of = lambda text: re.findall(TERM, (text or "").translate(UPPER))
    counted = [(d, Counter(of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, (_, text) in enumerate(items):
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in of(text) if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def searched(docs, items, k):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, items, k).collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_search_ranks_as_scoring_everything_does(spark, partitions):
    rows = list(enumerate(texts(1, 150))) + [(1000 + i, t) for i, t in enumerate(texts(1, 40))]
    items = list(enumerate(["abc", "nothing here", *texts(2, 12), *texts(1, 3), "", None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string"), 5) == ranked(rows, items, 5)


def test_search_of_odd_and_empty_tables(spark, odd, empty):
    items = list(enumerate(["word", "WORD a", "xx", "ab c null id", "\x00", None, "word word"]))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert searched(odd, table, 3) == ranked(rows, items, 3)
    assert searched(empty, table, 3) == [] and searched(odd, table.limit(0), 3) == []


def test_search_in_blocks_and_with_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 2)
    rows, items = list(enumerate(texts(3, 60))), list(enumerate(texts(4, 5)))
    docs = spark.createDataFrame([(f"d{d:03}", t) for d, t in rows], "doc_id string, text string")
    table = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    assert searched(docs, table, 4) == [(f"i{i}", r, f"d{d:03}", s) for i, r, d, s in ranked(rows, items, 4)]


def test_strata_that_cannot_matter_are_not_visited():
    """Of strata whose bounds fall, a query that has its best in the first meets no other."""
    weight = np.array([1000], np.int64)
    strata = []
    for m, tf in ((80, 50), (200, 1), (300, 1)):
        rows = [lexical_search.pa.array([m * 10 + i for i in range(5)]), lexical_search.Stratum.of(m, np.arange(5), np.zeros(5, int), np.full(5, tf), weight)]
        strata.append(tuple(rows))
    query = lexical_search.Query(np.array([0], np.int32), np.array([1], np.int64))
    assert lexical_search.visit(strata[::-1], query, 3) == 1 and [b[2] for b in query.best] == [800, 801, 802]
    assert lexical_search.visit(strata, lexical_search.Query(query.terms, query.times), 6) == 2
    assert lexical_search.visit(strata, lexical_search.Query(query.terms, query.times), 99) == 3


def test_impacts_are_computed_once_for_a_run_of_equal_frequencies():
    s = lexical_search.Stratum.of(90, np.array([3, 0, 1, 2, 0]), np.array([7, 7, 7, 7, 9]), np.array([2, 5, 2, 5, 1]), np.arange(10, dtype=np.int64))
    assert s.document.tolist() == [0, 2, 1, 3, 0] and s.terms.tolist() == [7, 9]
    assert s.most.tolist() == [7 * (5000000000 // (5000 + 1080)), 9 * (1000000000 // (1000 + 1080))]


# --- spelling variants


def near_pairs(words):
    letters = sorted({c for w in words for c in w})
    near = defaultdict(set)
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] |= {e for e in edits if e in words and e != w}
    return near


def grouped(words, times):
    near, form = near_pairs(words), {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= times * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def some_words(seed, n, letters="abcdeé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)}
    return {w: 5 ** rng.randint(0, 6) + rng.randint(0, 1) for w in words}


@pytest.mark.parametrize("chunks", [None, (7, 11)])
def test_groups_are_those_of_all_edits(spark, monkeypatch, chunks):
    if chunks:
        monkeypatch.setattr(spelling, "LEFT", chunks[0])
        monkeypatch.setattr(spelling, "RIGHT", chunks[1])
    words = some_words(1, 400)
    found = spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"), 5)
    assert {tuple(r) for r in found.collect()} == grouped(words, 5) and found.count() == len(words)


def test_each_pair_comes_once(spark):
    words = some_words(2, 150, "ab")
    found = [tuple(sorted((r.a, r.b))) for r in spelling.near(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    near = near_pairs(words)
    assert len(found) == len(set(found)) and set(found) == {tuple(sorted((a, b))) for a in words for b in near[a]}


def test_long_chains_of_forms_have_one_root(spark):
    chain = {"a" * (i + 1): 5**i for i in range(12)}
    found = {r.word: r.root for r in spelling.group(spark.createDataFrame(list(chain.items()), "word string, n long"), 5).collect()}
    assert set(found.values()) == {"a" * 12}


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    monkeypatch.setattr(spelling, "materialise", noted)
    words = materialise(spark.createDataFrame(list(some_words(3, 200).items()), "word string, n long"))
    found = spelling.group(words, 5)
    found.collect()
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (spelling.near(words), found)]
    assert len(plans) > 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def counted(rows, one_in):
    total = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if one_in and h % one_in == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            total[w] += 1
    total.pop("", None)
    return total


@pytest.mark.parametrize("one_in", [None, 1, 3])
def test_words_are_counted_with_their_deletions(spark, odd, monkeypatch, one_in):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(100 + i, t) for i, t in enumerate(["Ärger × ÷ ßo Ωmega naïve", "don't_stop x1y", *texts(5, 30)])]
    monkeypatch.setattr(spelling, "HELD", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count(docs, one_in).collect()} == counted(rows, one_in)


def test_variants_of_odd_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    words = {w: n for w, n in counted(rows, 199).items() if len(w) >= 3 and n >= 2}
    assert {tuple(r) for r in spelling.variants(odd, 199, 3, 2).collect()} == grouped(words, 5)
    assert spelling.variants(empty, 199).count() == 0


# --- byte-pair encoding


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def coder(request):
    file = public_tokenizers.path(request.param)
    return bpe.bpe(file), Tokenizer.from_file(file)


def same(coder, texts):
    own, library = coder
    ids, n = own.texts(texts)
    ends = np.cumsum(n)
    for text, end, k, want in zip(texts, ends, n, library.encode_batch(texts, add_special_tokens=False), strict=True):
        found = ids[end - k : end]
        assert found.tolist() == want.ids, text
        assert own.decoded(found).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_encoding_equals_the_library_on_odd_texts(coder):
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    odd += ["", "<|endoftext|>a b<|startoftext|>", "hello<|endoftext|", "İstanbul ΣΑΣ don't we'll 123", "a" * 100_000, "abcdefghij" * 3000, "\U0001d7d8é" * 3000, "é ́x", "x y　z w", "a\x00b a\x00c", "\x01<|endoftext|>"]
    same(coder, odd)
    for text in odd:
        same(coder, [text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_encoding_equals_the_library_on_any_text(some):
    same((bpe.bpe(word_bpe_path()), _LIBRARY), some)


_LIBRARY = Tokenizer.from_file(word_bpe_path())


def test_last_tokens_of_prefixes_are_those_of_their_encodings():
    """Along one piece, the last token of every prefix is the last of that prefix's own encoding by plain merges."""
    own = bpe.bpe(word_bpe_path())
    for piece in ("internationalisation", "thththththinining", "aaaaaaaaaaa", "donaudampfschifffahrt"):
        symbols = own.inner[[ord(c) for c in piece]]
        tokens = np.zeros(len(piece), np.int32)
        own._prefixes(symbols, np.array([0]), np.array([len(piece)]), tokens)
        alone = np.zeros(len(piece), np.int32)
        own._rest(symbols.tolist(), 0, 0, 0, alone)
        assert tokens.tolist() == alone.tolist() == [merged(own.merges, symbols[: i + 1].tolist())[-1] for i in range(len(piece))]


def merged(merges, tokens):
    """Plain merging: the pair of least rank, the leftmost of equal ones, until there is none."""
    made = {r: t for t, r in merges.rank.items()}
    while True:
        ranks = [(merges.pair[p], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in merges.pair]
        if not ranks:
            return tokens
        rank, i = min(ranks)
        tokens = [*tokens[:i], made[rank], *tokens[i + 2 :]]


def test_suffix_automaton_has_all_suffixes():
    strings = [[0, 1, 0], [1, 0], [0, 1, 1, 0], [2], [1]]
    auto = bpe.SuffixAutomaton(strings, 3)

    def state(s):
        at = 0
        for c in s:
            at = auto.step.get(at * 3 + c)
            if at is None:
                return None
        return at

    inside = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert all((state(s) is not None) == (s in inside) for n in range(1, 5) for s in np.ndindex(*[3] * n))
    for i, s in enumerate(strings):
        assert auto.string[state(s)] == i and auto.length[state(s)] == len(s)
    assert auto.string[auto.above[state([0, 1, 1, 0])]] == strings.index([1, 0])


def test_a_file_that_is_no_plain_model_is_refused(tmp_path):
    with pytest.raises(ValueError, match="merge"):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aab": 3}, [("a", "ab"), ("a", "b")])


def test_digests_encode_and_decode(spark, odd, empty):
    found = sorted(map(tuple, bpe.digests(odd).collect()), key=str)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = _LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        hexes = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), _LIBRARY.decode(ids, skip_special_tokens=False).encode())]
        want.append((r.doc_id, len(ids), *hexes))
    assert found == sorted(want, key=str) and bpe.digests(empty).count() == 0
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back == {(r.doc_id, _LIBRARY.decode(_LIBRARY.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in odd.select("doc_id", "text").collect()}
    assert bpe.decode(spark.createDataFrame([("a", None), ("b", [320, 10**8, -1, 320])], "doc_id string, ids array<int>")).collect() == [("a", ""), ("b", "a</w> a</w>")]


def test_strings_with_null_characters_are_told_apart():
    codes, counts, words = word_codes(["a\x00b a\x00c a\x00b", None])
    assert codes.tolist() == [0, 1, 0] and counts.tolist() == [3, 0] and list(words) == ["a\x00b", "a\x00c"]
