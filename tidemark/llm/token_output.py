"""Token ids in Parquet list columns.

`write` tokenises documents in ascending doc_id order and writes one row per document: doc_id, source, n_tokens and
the list of ids.  The files are Parquet v2: the small columns keep dictionary encoding, ids fall back to bit-packed
delta encoding, row groups are small enough to be fetched one by one, and page indexes let a reader that filters on
doc_id or asks for metadata only fetch those pages.  Ids leave with an end id after each document.

Files are in doc_id order, since rows are range-partitioned by doc_id before they are tokenised; so a document's first
position in the whole stream is the sum of n_tokens of the files before, plus those before it in its file.

Nulls and edge cases: a null or empty text has the end id alone; null doc_ids come first; rows with equal doc_ids are
written next to each other in text order; a text of any length is one row; an empty table gives an empty result; other
columns, whatever their names, are not written.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WordTable, flatten, materialise, pieces, spread, type_of

END_ID = 2

#: Words that a worker keeps.
KNOWN = 500_000

#: Bytes of text that are worked on at once.
PIECE = 8 << 20

#: Marks that may follow a word; the apostrophe is not one, since the vocabulary's first split knows endings like 's.
MARKS = "".join(c for c in string.punctuation if c not in "'<>|")

#: Byte-level vocabularies write a byte as its Latin-1 character where that is visible, the others from U+0100 on in turn.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
BYTE_LEVEL = {c: "".join(BYTE.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 256)}

#: What a byte is: ASCII white space, one of MARKS, an ASCII letter, a part of a longer character, or none of these.
BLANK, MARK, LETTER, HIGH = 1, 2, 4, 8
BLANKS = b" \t\n\r\x0b\x0c"
KIND = bytes(BLANK if b in BLANKS else MARK if chr(b) in MARKS else HIGH if b > 127 else LETTER if chr(b).isalpha() else 0 for b in range(256))

#: Options of the files.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "compression": "snappy",
}

SCHEMA = "doc_id {0}, source string, n_tokens int, ids array<int>"


class WordEncoder:
    """Ids of texts, by the distinct words that they hold.

    The tokenizer works on one run of non-space at a time (its normaliser maps characters one by one, and its first
    split is at white space and between letters and marks), so the ids of a text are those of its runs in turn; each
    distinct run is encoded once.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.table = WordTable(self._encode, KNOWN)

    def _encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys.  A word of Latin-1 letters is one run that no normaliser changes but to lower case, so it goes to the model at once."""
        tokenize = self.tokenizer.model.tokenize
        lists = [None] * len(keys)
        others = []
        for i, key in enumerate(keys):
            low = key.lower()
            if _plain(low):
                lists[i] = [t.id for t in tokenize(low if low.isascii() else low.translate(BYTE_LEVEL))]
            else:
                others.append(i)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([keys[i] for i in others], add_special_tokens=False), strict=True):
            lists[i] = e.ids
        return flatten(lists)

    def column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, with the end id after each, and the number of ids of each."""
        codes, counts, words = runs(texts)
        first, size, flat = self.table.look_up(words)
        per_word = size[codes]
        ids = flat[spread(first[codes], per_word)]
        bounds = np.r_[0, np.cumsum(per_word)][np.cumsum(counts)]
        n = np.diff(np.r_[0, bounds])
        return np.insert(ids, bounds, END_ID), n + 1

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.column(pa.array(texts, pa.string()))


def runs(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts cut into runs that the tokenizer works on one by one: (code of each run, number of runs of each text, the distinct runs).

    Cuts are at ASCII white space, which is dropped, and between letters and marks; only those of ASCII, and marks after
    a letter of Latin-1, are told from the bytes, so a run may still hold both.  A-Z is lower-cased, but not in the
    neighbourhood of what may be a special token, which the tokenizer looks for first.
    """
    begin, end, raw = text_bytes(texts)
    data = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(KIND), np.uint8)
    before = np.r_[np.uint8(BLANK), kind[:-1]][: len(kind)]
    before[begin[begin < len(kind)]] = BLANK
    new = (kind != BLANK) & ((before == BLANK) | ((before | kind) == MARK | LETTER))
    marks = np.flatnonzero((before == HIGH) & (kind == MARK))
    # U+00C0 to U+00FF, which are all letters but for the signs of multiplication and division.
    new[marks[(data[marks - 2] == 0xC3) & (data[marks - 1] != 0x97) & (data[marks - 1] != 0xB7)]] = True
    counts = np.diff(np.searchsorted(np.flatnonzero(new), np.r_[begin, end[-1:]]))
    dense = (raw if b"<|" in raw else raw.lower()).translate(None, BLANKS)
    places = np.r_[np.flatnonzero(new[kind != BLANK]), len(dense)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(dense)).dictionary_encode()
    return found.indices.to_numpy(), counts, found.dictionary.to_pylist()


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where each text begins and ends in the UTF-8 bytes of all; a null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    places = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    raw = held[int(places[0]) : int(places[-1])].to_pybytes() if held is not None else b""
    return places[:-1] - places[0], places[1:] - places[0], raw


def _plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """The encoder of this worker for a tokenizer file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, ids) for each row of `docs` (doc_id, text, source), partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file or word_bpe_path())
        for batch in batches:
            texts = batch["text"].cast(pa.string())
            for part in pieces(pc.binary_length(texts).fill_null(0).to_numpy(), PIECE):
                ids, n = own.column(texts[part])
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), ids.astype(np.int32, copy=False))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["source"], pa.array(n.astype(np.int32)), lists], ["doc_id", "source", "n_tokens", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, SCHEMA.format(type_of(docs, "doc_id")))


def write(docs: DataFrame, path: str, file: str | None = None) -> None:
    """Write the token files of `docs` to a folder, in ascending doc_id order."""
    order = ["doc_id", "text"]
    laid = docs.select("doc_id", "source", "text").repartitionByRange("doc_id").sortWithinPartitions(*order)
    tokenise(laid, file).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The rows of the token files."""
    return spark.read.schema(SCHEMA.format(id_type)).parquet(path)


def digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            places = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch["file"], batch["row"], batch["doc_id"], pa.array(np.diff(places).astype(np.int64)), pa.array(crc)], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    # File names carry the partition number, whose order is that of doc_id.
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    rows = read(spark, path, id_type).select("doc_id", "ids", number.cast("long").alias("file"), F.col("_metadata.row_index").alias("row"))
    each = materialise(rows.mapInArrow(run, f"file long, row long, doc_id {id_type}, n_tokens long, ids_crc32 long"))
    totals = each.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "file")
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
