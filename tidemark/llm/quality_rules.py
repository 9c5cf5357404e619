"""Quality rules: base counts, and tokeniser fertility with rejection bands per language.

Fertility is measured with two public vocabularies: characters per token under each, the share of byte-fallback tokens
and the entropy of the tokens under the one that falls back to bytes.  A text is read as its words: both vocabularies
split at white space first, so each distinct word of a batch is encoded once and counted as often as it occurs.

The bands come from the corpus itself: for each language, quartiles of each measure over all its documents, with a
fence of some interquartile ranges (at least `least` in absolute terms), set apart for each side.  A document is rejected
when a measure leaves its language's band.  Quartiles are taken with a mergeable sketch, so a language that holds a third of all rows
is no harder than others.  Entropy is compared with what the text's number of tokens allows.

Nulls and edge cases: a null or empty text has zero counts, fails the base rules and is not kept; a null language is a
language of its own; repeated rows are judged separately and alike; a text of any length is read whole; other columns,
whatever their names, come through `keep` as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordTable, flatten, materialise, mix64, packed, pieces, spread, word_codes, type_of

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy_ratio")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_ratio double"


#: Tokens from which texts no longer vary much more than long ones.
SHORT = 600


@dataclass(frozen=True)
class Band:
    """A fence around a language's quartiles: `low` and `high` interquartile ranges, at least `least`; None is no fence.

    Short texts vary more, so a text of n tokens gets the fence times sqrt(1 + short / n).
    """

    low: float | None
    high: float | None
    least: float
    short: float = SHORT


#: Chosen on labelled rows outside the classifier's held-out fold.  Junk breaks into more byte tokens than prose, so that
#: low side is tight.  A short text has a higher entropy ratio, not a lower one, so that side needs no allowance.
BANDS = {
    "chars_per_piece": Band(3.0, 3.0, 0.1),
    "chars_per_byte_token": Band(1.0, 3.0, 0.05, 400),
    "fallback_share": Band(None, 3.0, 0.02),
    "entropy_ratio": Band(1.25, None, 0.1, 0),
}


class Vocabularies:
    """Both vocabularies in one worker."""

    def __init__(self, piece_file: str, rank_file: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self.table = WordTable(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in the first vocabulary, led by the number of tokens in the second."""
        ids = self.piece.encode(words, num_threads=1)
        return flatten([[len(self.byte.encode_ordinary(" " + w)), *x] for w, x in zip(words, ids, strict=True)])


_LOADED: dict[tuple, Vocabularies] = {}


def vocabularies(piece_file: str | None = None, rank_file: str | None = None) -> Vocabularies:
    """The vocabularies of this worker."""
    import public_tokenizers

    key = (piece_file or public_tokenizers.path("piece_bpe_32k.model"), rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    if key not in _LOADED:
        _LOADED[key] = Vocabularies(*key, public_tokenizers.PATTERN)
    return _LOADED[key]


def repeat_words(codes: np.ndarray, counts: np.ndarray, window: int = 5) -> np.ndarray:
    """Of each text: words that lie in a window of words that the text has twice or more."""
    n, owner = len(codes), np.repeat(np.arange(len(counts)), counts)
    if n < window:
        return np.zeros(len(counts), np.int64)
    starts = n - window + 1
    name = mix64(owner[:starts].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + starts].astype(np.uint64))
    at = np.flatnonzero(owner[:starts] == owner[window - 1 :])
    name = name[at]
    order = np.argsort(name, kind="stable")
    equal = name[order][1:] == name[order][:-1]
    twice = np.r_[False, equal] | np.r_[equal, False]
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, at[order[twice]], 1)
    np.add.at(hit, at[order[twice]] + window, -1)
    return np.bincount(owner[np.cumsum(hit[:-1]) > 0], minlength=len(counts)).astype(np.int64)


def dup_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: list[str], vocab: Vocabularies) -> pd.DataFrame:
    """Base counts and fertility of some texts."""
    codes, counts, words = word_codes(texts)
    words = list(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.fromiter((sum(map(w.count, SYMBOLS)) if not w.isalnum() else 0 for w in words), np.int64, len(words))
    led, size, flat = vocab.table.look_up(words)
    n_byte, first, size = flat[led], led + 1, size - 1
    fallback = np.bincount(np.repeat(np.arange(len(words)), size), weights=vocab.is_byte[flat[spread(first, size)]], minlength=len(words))
    owner = np.repeat(np.arange(len(texts)), counts)
    total = lambda per_word: np.bincount(owner, weights=per_word[codes], minlength=len(texts))
    n_tokens, chars = total(size), total(length)
    # Counts of each (text, word), then of each (text, token): words repeat much more than texts have tokens.
    pairs, times = np.unique(owner.astype(np.int64) * max(1, len(words)) + codes, return_counts=True)
    text_of, word_of = np.divmod(pairs, max(1, len(words)))
    each = size[word_of]
    key = np.repeat(text_of, each) * len(vocab.is_byte) + flat[spread(first[word_of], each)]
    kinds, place = np.unique(key, return_inverse=True)
    n = np.bincount(place, weights=np.repeat(times, each), minlength=len(kinds))
    nlogn = np.bincount(kinds // len(vocab.is_byte), weights=n * np.log2(np.maximum(n, 1)), minlength=len(texts))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.log2(n_tokens) - nlogn / n_tokens
        return pd.DataFrame(
            {
                "n_words": counts,
                "word_chars": chars.astype(np.int64),
                "n_symbols": total(symbols).astype(np.int64),
                "n_dup_lines": np.fromiter(map(dup_lines, texts), np.int64, len(texts)),
                "n_repeat_words": repeat_words(codes, counts),
                "n_tokens": n_tokens.astype(np.int64),
                "chars_per_piece": chars / n_tokens,
                "chars_per_byte_token": chars / total(n_byte),
                "fallback_share": total(fallback) / n_tokens,
                "entropy_ratio": entropy / np.log2(n_tokens),
            }
        )


def measures(docs: DataFrame, piece_file: str | None = None, rank_file: str | None = None) -> DataFrame:
    """The measures of each row, with doc_id, lang and a key of the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabularies(piece_file, rank_file)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for part in pieces(np.fromiter(map(len, texts), np.int64, len(texts)), 3 << 20):
                yield pd.concat([batch[["_key", "doc_id", "lang"]].iloc[part].reset_index(drop=True), measure(texts[part], vocab)], axis=1)

    return docs.select(row_key().alias("_key"), "doc_id", "lang", "text").mapInPandas(run, f"_key long, doc_id {type_of(docs, 'doc_id')}, lang string, {SCHEMA}")


def language_bands(measured: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """(lang, <measure>_q1, <measure>_q3) over all rows of each language."""
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), accuracy).alias(m) for m in MEASURES]
    out = measured.filter("n_tokens > 1").groupBy("lang").agg(*quartiles)
    return out.select(F.col("lang").alias("_lang"), *[F.col(m)[i].alias(f"{m}_q{2 * i + 1}") for m in MEASURES for i in (0, 1)])


def judge(measured: DataFrame, bands: dict[str, Band] = BANDS, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """`measured` (measures and lang) with base_failed, `failed` (the bands that it leaves) and kept."""
    joined = measured.join(language_bands(measured), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    names = []
    for m, band in bands.items():
        q1, q3 = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        fence = lambda width, band=band, q1=q1, q3=q3: F.greatest((q3 - q1) * width, F.lit(band.least)) * F.sqrt(1 + band.short / F.col("n_tokens"))
        outside = F.lit(False)
        outside = outside | (F.col(m) < q1 - fence(band.low)) if band.low is not None else outside
        outside = outside | (F.col(m) > q3 + fence(band.high)) if band.high is not None else outside
        names.append(F.when((F.col("n_tokens") > 1) & outside, F.lit(m)))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = joined.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*names)))
    quartiles = [f"{m}_q{i}" for m in bands for i in (1, 3)]
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lang", *quartiles)


def apply(docs: DataFrame, **files: str) -> DataFrame:
    """(doc_id, lang, measures, base_failed, failed, kept) of every row of `docs` (doc_id, text, lang)."""
    return judge(materialise(measures(docs, **files)))


def keep(docs: DataFrame, **files: str) -> DataFrame:
    """The rows of `docs` that pass, with its columns.

    The verdicts are joined by doc_id, language and a hash of the text, so rows that repeat a doc_id keep their own.
    """
    verdicts = judge(materialise(measures(docs, **files))).filter("kept").select("_key").distinct()
    return packed(docs, _key=row_key()).join(verdicts, "_key", "left_semi").select("row.*")


def row_key() -> Column:
    return F.xxhash64("doc_id", "lang", "text")
