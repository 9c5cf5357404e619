"""Byte-pair encoding and decoding, by the unique last token of every prefix.

A sequence of tokens is the encoding of its text where each token is its own encoding and each two neighbours are
compatible: merging the symbols of both gives the two again.  So each prefix of a text has one last token: the token
that ends there and is compatible with the last token of the prefix before it.  Tokens that end at a place come from a
suffix automaton of the vocabulary: its state is the longest suffix that lies within any token, and the states up its
suffix links that are whole tokens are the candidates.  Following the last tokens back from the end gives the ids; a
text of n bytes takes n steps, however long it is.

The normaliser and the first split of a tokenizer file are the library's own; merges are not.  `encode` and `decode`
take any column of texts or ids; `digests` does both and keeps sizes and hashes only.

Nulls and edge cases: a null or empty text has no ids; no ids decode to the empty text; a text of any length is read
whole; special tokens that stand in a text are themselves, as in the library; null and repeated doc_ids keep a row each;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import WordTable, flatten, mix64, pieces, spread, word_codes
from tidemark.llm.token_output import BYTE, BYTE_LEVEL, MARKS, word_bpe_path

#: Pieces that a worker keeps, and pairs of tokens whose compatibility it keeps: they save work and have no part in results.
KNOWN_PIECES, KNOWN_PAIRS = 500_000, 2_000_000

#: So many pieces at most go on alone, symbol by symbol, where they are much longer than all others.
FEW = 8


class IntMap:
    """A map from many 64-bit integers to integers from 0 on, by open addressing in flat arrays; -1 where there is none."""

    def __init__(self) -> None:
        self.n = 0
        self._lay(1 << 12)

    def _lay(self, size: int) -> None:
        self.keys, self.values, self.mask = np.full(size, -1, np.int64), np.full(size, -1, np.int32), np.uint64(size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) & self.mask).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are new and distinct."""
        self.n += len(keys)
        if 3 * self.n > len(self.keys):
            old = self.keys >= 0
            keys, values = np.r_[self.keys[old], keys], np.r_[self.values[old], values]
            self._lay(1 << int(4 * self.n).bit_length())
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one place, one gets it
            got = self.keys[slot] == keys
            self.values[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], (slot[~got] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            met = self.keys[slot]
            hit = met == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (met >= 0)
            left, slot = left[go], slot[go]
        return out


class SuffixAutomaton:
    """All suffixes of all strings of a vocabulary, over symbols 0, 1, ...

    A string of the vocabulary is the longest of its state, since it stands at the beginning of itself.
    """

    def __init__(self, strings: list[list[int]], alphabet: int) -> None:
        self.alphabet = alphabet
        self.length, self.link = [0], [-1]
        #: Steps from all states, by state * alphabet + symbol.
        self.step: dict[int, int] = {}
        self._out: list[list[int]] = [[]]
        ends = [self._add(s) for s in strings]
        #: The string whose end is the state, or -1.
        self.string = [-1] * len(self.link)
        for i, state in enumerate(ends):
            self.string[state] = i
        del self._out
        #: The nearest state up the suffix links that is a whole string, or 0; a link goes to a shorter state.
        self.above = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up > 0 and self.string[up] >= 0 else self.above[max(up, 0)]

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, below: int) -> int:
        """The state for the shorter strings of `below`, which have more ends than its longer ones."""
        own = self._new(self.length[state] + 1, self.link[below])
        for s in self._out[below]:
            self.step[own * self.alphabet + s] = self.step[below * self.alphabet + s]
        self._out[own] = list(self._out[below])
        self.link[below] = own
        while state >= 0 and self.step.get(state * self.alphabet + symbol) == below:
            self.step[state * self.alphabet + symbol] = own
            state = self.link[state]
        return own

    def _add(self, string: list[int]) -> int:
        last = 0
        for symbol in string:
            at = last
            to = self.step.get(at * self.alphabet + symbol)
            if to is not None:
                last = to if self.length[to] == self.length[at] + 1 else self._split(at, symbol, to)
                continue
            last = self._new(self.length[at] + 1, 0)
            while at >= 0 and (to := self.step.get(at * self.alphabet + symbol)) is None:
                self.step[at * self.alphabet + symbol] = last
                self._out[at].append(symbol)
                at = self.link[at]
            if at >= 0:
                self.link[last] = to if self.length[to] == self.length[at] + 1 else self._split(at, symbol, to)
        return last


class Merges:
    """The merges of a vocabulary: each token's two parts and its rank, and which tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.pair = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        made = [vocabulary[a + b] for a, b in merges]
        self.parts = dict(zip(made, self.pair, strict=True))
        self.rank = dict(zip(made, range(len(made)), strict=True))
        late = [t for t, (a, b) in self.parts.items() if max(self.rank.get(a, -1), self.rank.get(b, -1)) >= self.rank[t]]
        if late or len(self.parts) < len(made):
            raise ValueError("a token must be made by one merge, after those of its parts")
        self.known = IntMap()
        #: Tokens that are their own encoding.
        self.whole = set(vocabulary.values()) - set(made)
        for token, (a, b) in self.parts.items():
            if a in self.whole and b in self.whole and not self._crosses(a, b, self.rank[token]):
                self.whole.add(token)

    def symbols(self, token: int) -> list[int]:
        """What a token is made of, before any merge."""
        out, rest = [], [token]
        while rest:
            t = rest.pop()
            if t in self.parts:
                rest += reversed(self.parts[t])
            else:
                out.append(t)
        return out

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it is made, and the rank at which each is merged away."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.rank[token], self.parts[token][side]

    def _crosses(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether a merge of rank less than `before` joins what two tokens are made of, across their border.

        Ranks are the order in time, so tokens of two edges meet if each outlives the rank at which they would merge.
        Of equal pairs the one further left merges first: a left edge may be merged away at that very rank, a right
        one may not.
        """
        right_edge = self._edge(right, 0)
        for a, a_until in self._edge(left, 1):
            for b, b_until in right_edge:
                rank = self.pair.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until and rank < before:
                    return True
        return False

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which tokens may stand before which others, pair by pair."""
        key = left.astype(np.int64) << 32 | right
        found = self.known.get(key)
        fresh = np.unique(key[found < 0])
        if len(fresh):
            if self.known.n + len(fresh) > KNOWN_PAIRS:
                self.known = IntMap()
            may = np.fromiter((not self._crosses(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()), np.int32, len(fresh))
            self.known.add(fresh, may)
            found[found < 0] = may[np.searchsorted(fresh, key[found < 0])]
        return found > 0


class Bpe:
    """Encoding and decoding by a tokenizer file of the tokenizers library."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file) as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model['type']} {odd}")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(self.vocabulary, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = sorted(self.merges.whole)
        strings = [self.merges.symbols(t) for t in whole]
        auto = SuffixAutomaton(strings, max(self.vocabulary.values()) + 1)
        self.alphabet = auto.alphabet
        self.link, self.length, self.above = (np.array(x, np.int32) for x in (auto.link, auto.length, auto.above))
        #: For each state its token, or -1.
        self.token = np.array([whole[i] if i >= 0 else -1 for i in auto.string], np.int32)
        self.step = IntMap()
        self.step.add(np.fromiter(auto.step.keys(), np.int64, len(auto.step)), np.fromiter(auto.step.values(), np.int32, len(auto.step)))
        self.size = np.zeros(max([self.alphabet - 1, *self.special.values()]) + 1, np.int32)
        self.size[whole] = [len(s) for s in strings]
        #: Tokens of single characters, within a piece and at its end.
        one = [c for c in self.vocabulary if len(c) == 1]
        self.inner, self.last = (np.full(max(map(ord, one)) + 1, -1, np.int32) for _ in range(2))
        self.inner[[ord(c) for c in one]] = [self.vocabulary[c] for c in one]
        self.last[[ord(c) for c in one]] = [self.vocabulary.get(c + self.suffix, -1) for c in one]
        #: Whether words on either side of white space have no part in one another's ids, and marks after a word are one piece.
        self.by_word = self._split("Ab,; c") == ["ab", ",;", "c"]
        self.table = WordTable(self._encode, KNOWN_PIECES)
        self._lists: tuple = ()
        decoder = (spec.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"no decoder {decoder}")
        #: Without a decoder, tokens are joined by blanks; else each character of a token is a byte.
        self.joined = decoder is None
        names = {i: t.encode() for t, i in self.special.items()} | {i: t.encode() if self.joined else _bytes(t) for t, i in self.vocabulary.items()}
        text = [names[i] + b" " * self.joined if i in names else b"" for i in range(max(names) + 1)]
        self._size = np.array([len(t) for t in text], np.int64)
        self._first = np.r_[0, np.cumsum([len(t) for t in text])][:-1]
        self._text = np.frombuffer(b"".join(text), np.uint8)

    def _split(self, text: str) -> list[str]:
        lib = self.library
        text = lib.normalizer.normalize_str(text) if lib.normalizer else text
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def _pieces(self, text: str) -> list[str]:
        """The pieces of the first split; a special token is one, marked by a control character, which no piece has."""
        out: list[str] = []
        for k, part in enumerate(self._special_at.split(text) if self._special_at else [text]):
            if k % 2:
                out.append("\1" + part)
            elif part:
                out += self._split(part)
        return out

    def _word(self, word: str) -> list[str]:
        """The pieces of a run without white space.

        Marks after Latin-1 letters are a piece of their own, and no normaliser changes such letters in lower case.
        """
        stem = word.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) <= "\xff"):
            own = stem.lower()
            own = own if stem.isascii() else own.translate(BYTE_LEVEL)
            return [own, word[len(stem) :]] if len(stem) < len(word) else [own]
        return self._pieces(word)

    def _encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces, and the number of ids of each: the last token of every prefix, then back from the end.

        Pieces go side by side, place by place, the longest first, so that those that go on are the first of them.
        """
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        order = np.argsort(-size, kind="stable")
        first = (np.cumsum(size) - size)[order]
        size = size[order]
        code = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        symbol = self.inner[np.minimum(code, len(self.inner) - 1)]
        end = first + size - 1
        symbol[end] = self.last[np.minimum(code[end], len(self.last) - 1)]
        special = np.array([k[0] == "\1" for k in keys], bool)[order]
        for i in np.flatnonzero(special):  # as long as they stand there, their whole length is their own
            symbol[first[i] : end[i] + 1] = -1
        plain = np.flatnonzero(~special)
        tokens = np.zeros(len(code), np.int32)
        self._prefixes(symbol, first[plain], size[plain], tokens)
        tokens[end[special]] = [self.special[keys[i][1:]] for i in order[special]]
        step = self.size[tokens].astype(np.int64)
        step[end[special]] = size[special]
        # Back from the end: which prefixes are borders of the encoding.
        border = np.zeros(len(code), bool)
        at, stop = end, first
        while len(at):
            border[at] = True
            at = at - step[at]
            go = at >= stop
            at, stop = at[go], stop[go]
        n = np.add.reduceat(border, (np.cumsum(s := np.fromiter(map(len, keys), np.int64, len(keys))) - s)) if len(keys) else s
        return tokens[border], n.astype(np.int64)

    def _prefixes(self, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> None:
        """Fill in the last token of every prefix of some pieces, the longest piece first."""
        state, matched = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i))  # those longer than i
            if n <= FEW and size[0] - i > FEW:
                for k in range(n):
                    self._rest(symbol[first[k] : first[k] + size[k]].tolist(), i, int(state[k]), int(matched[k]), tokens[first[k] : first[k] + size[k]])
                return
            place = first[:n] + i
            own = symbol[place].astype(np.int64)
            to = self.step.get(state[:n].astype(np.int64) * self.alphabet + own)
            grown = matched[:n] + 1
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                back = self.link[state[stuck]]
                # The first state steps nowhere by a symbol that no token has.
                gone = stuck[back < 0]
                to[gone], grown[gone] = 0, 0
                stuck, back = stuck[back >= 0], back[back >= 0]
                state[stuck] = back
                to[stuck] = self.step.get(back.astype(np.int64) * self.alphabet + own[stuck])
                grown[stuck] = self.length[back] + 1
                stuck = stuck[to[stuck] < 0]
            state[:n], matched[:n] = to, grown
            at = np.where((self.token[to] >= 0) & (self.length[to] == grown), to, self.above[to])
            left = np.arange(n)
            while len(left):
                if not at.all():
                    raise ValueError("a character that the vocabulary has not")
                token = self.token[at]
                before = i - self.length[at]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.merges.compatible(tokens[first[left[inner]] + before[inner]], token[inner])
                tokens[place[left[ok]]] = token[ok]
                left, at = left[~ok], self.above[at[~ok]]

    def _rest(self, symbols: list[int], i: int, state: int, matched: int, tokens: np.ndarray) -> None:
        """The same for one long piece from its place `i` on, symbol by symbol."""
        if not self._lists:
            full = self.step.keys >= 0
            self._lists = (dict(zip(self.step.keys[full].tolist(), self.step.values[full].tolist(), strict=True)), self.link.tolist(), self.length.tolist(), self.above.tolist(), self.token.tolist(), {})
        step, link, length, above, token, known = self._lists
        last = tokens[:i].tolist()
        for i in range(i, len(symbols)):
            symbol = symbols[i]
            while (to := step.get(state * self.alphabet + symbol)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                raise ValueError("a character that the vocabulary has not")
            state, matched = to, matched + 1
            at = to if token[to] >= 0 and length[to] == matched else above[to]
            while at:
                before = i - length[at]
                if before < 0:
                    break
                pair = (last[before], token[at])
                if (ok := known.get(pair)) is None:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    ok = known[pair] = bool(self.merges.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if ok:
                    break
                at = above[at]
            last.append(token[at])
        tokens[:] = last

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the number of ids of each."""
        if self.by_word:
            codes, counts, words = word_codes(texts)
            split = [self._word(w) for w in words]
        else:
            codes, counts, split = np.arange(len(texts)), np.ones(len(texts), np.int64), [self._pieces(t) for t in texts]
        n_pieces = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.empty(int(n_pieces.sum()), object)
        flat[:] = list(chain.from_iterable(split))
        of_word, kinds = pd.factorize(flat)
        first, size, ids = self.table.look_up(list(kinds))
        # From texts to words, to pieces, to ids; each step spreads runs over their places.
        places = of_word[spread((np.cumsum(n_pieces) - n_pieces)[codes], n_pieces[codes])]
        per_word = np.bincount(np.repeat(np.arange(len(split)), n_pieces), size[of_word], len(split)).astype(np.int64)
        n = np.diff(np.r_[0, np.cumsum(per_word[codes])][np.r_[0, np.cumsum(counts)]])
        return ids[spread(first[places], size[places])], n

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of some ids, special ones too, as UTF-8; ids outside of the vocabulary are skipped, bytes that are no text are replaced."""
        ids = ids[(ids >= 0) & (ids < len(self._size))]
        out = self._text[spread(self._first[ids], self._size[ids])].tobytes()
        return out[:-1] if self.joined else out.decode(errors="replace").encode()


def _bytes(token: str) -> bytes:
    """The bytes that a token of a byte-level vocabulary stands for."""
    return bytes(_OF_CHARACTER[c] for c in token) if all(c in _OF_CHARACTER for c in token) else token.encode()


_OF_CHARACTER = {BYTE.get(b, chr(b)): b for b in range(256)}


@lru_cache(maxsize=4)
def bpe(file: str) -> Bpe:
    """The coder of this worker for a tokenizer file."""
    return Bpe(file)


#: Characters encoded at once.
PIECE = 4 << 20


def _encoded(batch: pa.RecordBatch, own: Bpe, column: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, all their ids, number of ids of each) for slices of a batch."""
    texts = [t or "" for t in batch[column].to_pylist()]
    for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), PIECE):
        ids, n = own.texts(texts[part])
        yield part, ids, n


def encode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of `docs` (doc_id, text)."""
    file = file or word_bpe_path()
    schema = StructType([docs.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(file)
        for batch in batches:
            for part, ids, n in _encoded(batch, own, "text"):
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), ids.astype(np.int32, copy=False))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][part.start : part.stop], lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of `encoded` (doc_id, ids); null ids count as none."""
    file = file or word_bpe_path()
    schema = StructType([encoded.schema["doc_id"], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(file)
        for batch in batches:
            texts = [own.decoded(np.array(ids or [], np.int64)).decode() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of `docs` (doc_id, text): encoded, then decoded from the ids."""
    file = file or word_bpe_path()
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    schema = StructType([docs.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(file)
        for batch in batches:
            for part, ids, n in _encoded(batch, own, "text"):
                ends = np.cumsum(n)
                own_ids = [ids[b - k : b] for b, k in zip(ends, n, strict=True)]
                in_hex = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own_ids]
                back = [hashlib.sha256(own.decoded(x)).hexdigest() for x in own_ids]
                columns = [batch["doc_id"][part.start : part.stop], pa.array(n), pa.array(in_hex), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
