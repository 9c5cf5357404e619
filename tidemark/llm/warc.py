"""Dictionary-compressed WARC archives, written and read by Spark.

Each partition becomes archives of bounded size, so one is never too large to be read whole.  A Zstandard dictionary is
built from the records of an archive and stands, uncompressed, in a leading skippable frame; every record is then a frame
of its own, compressed with the dictionary.
Spark's own text writer commits the files: a line is one frame, and the line separator is an empty skippable frame,
which readers of Zstandard pass over.  So archives can be written to any store that Spark reaches, a retried task
leaves no half-written file, and a reader needs only a Zstandard library and the first frame.

Records with equal payloads of at least `least_bytes` are stored once: the one with the smallest page_id is a
`response`, the others are `revisit` records that refer to it.

Nulls and edge cases: a null html is an empty payload; a null url leaves the record without a target; a null page_id
sorts after all others and its record refers or is referred to as `none`; rows that repeat page_id and payload are
written as often as they occur, all as the type of their page_id; a very long payload is one record, and ends its
archive; other columns, whatever their names, are not written; an empty table writes no record and reads back as an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers of the dictionary frame and of the separating skippable frame, little-endian.
DICTIONARY_MAGIC, EMPTY_FRAME = b"\x5d\x2a\x4d\x18", b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHOLE_URI = "X-Target-URI-Base64"
RECORD_ID, DATE = "<urn:x-page:%s>", "2024-01-01T00:00:00Z"

#: An archive's dictionary is built from its first records up to so many bytes; this many bytes are also what a task buffers.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 8 << 20, 64 << 10

#: Bytes of records from which an archive is full.
ARCHIVE_BYTES = 256 << 20

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) for each page; refers_to is null for a response.

    The smallest page_id of each payload comes from a partial aggregate over slim rows, and is joined back to slim
    rows; the payloads themselves are only joined by page_id, which no group of copies can skew.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    full = pages.select("page_id", "url", payload.alias("payload"))
    slim = full.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1 and first is not null")
    again = slim.join(firsts.drop("times"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    full = full.withColumn("_sha1", F.sha1("payload"))
    joined = full.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "payload", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; the block of a revisit is the HTTP head alone."""
    name = lambda i: RECORD_ID % ("none" if i is None else i)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # As it stands; one with line ends, which no header can hold, is written a second time.
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:
            lines.append(f"{WHOLE_URI}: {base64.b64encode(url.encode()).decode()}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the records' own bytes where they are too few to train one."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, split_point=1.0, accel=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def frames(archive_bytes: int):
    """(archive, place, frame) of the archives of a partition: of each the dictionary, then one frame for each record."""
    none = lambda v: None if v is None or v != v else v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, held, size, archive, place = None, [], 0, 0, 0

        def placed(out: list[bytes]) -> pd.DataFrame:
            nonlocal place
            place += len(out)
            return pd.DataFrame({"archive": archive, "place": range(place - len(out), place), "frame": out})

        for batch in batches:
            out = []
            for page_id, url, payload, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                ids = [None if none(v) is None else int(v) for v in (page_id, refers)]
                data = record(ids[0], none(url), payload, ids[1])
                size += len(data)
                if packer is not None:
                    out.append(packer.compress(data))
                else:
                    held.append(data)
                    if size >= DICTIONARY_SAMPLE or size >= archive_bytes:
                        packer, opened = _open(held)
                        out += opened
                        held = []
                if size >= archive_bytes:
                    yield placed(out)
                    packer, out, size, archive = None, [], 0, archive + 1
            if out:
                yield placed(out)
        if held:
            yield placed(_open(held)[1])

    return run


def _open(held: list[bytes]) -> tuple[zstandard.ZstdCompressor, list[bytes]]:
    made = dictionary(held)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made), write_checksum=True)
    return packer, [DICTIONARY_MAGIC + len(made).to_bytes(4, "little") + made, *map(packer.compress, held)]


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of `pages` (page_id, url, html) to a folder, the first ones of all tasks in archive=0 and so on."""
    out = typed(pages, least_bytes).mapInPandas(frames(archive_bytes), "archive int, place long, frame binary").sortWithinPartitions("archive", "place")
    out.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", EMPTY_FRAME.decode()).text(path)


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of one archive, in order, as in READ."""
    if archive[:4] != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    end = 8 + int.from_bytes(archive[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8:end]))
    stream = io.BufferedReader(_Joined(reader.stream_reader(memoryview(archive)[end:], read_across_frames=True)), 1 << 16)
    number = lambda v: None if v in (None, RECORD_ID % "none") else int(v[len(RECORD_ID) - 3 : -1])
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record must begin here")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.removesuffix(b"\r\n").decode().partition(": ")
            fields[key] = value
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        head, _, payload = block.partition(b"\r\n\r\n")
        kind = fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(head.rpartition(b"Content-Length: ")[2])
        if kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
            raise ValueError("payload and digest differ")
        url = fields.get("WARC-Target-URI")
        url = base64.b64decode(fields[WHOLE_URI]).decode() if WHOLE_URI in fields else url
        yield number(fields["WARC-Record-ID"]), url, size, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


class _Joined(io.RawIOBase):
    """A readable view of the decompressed frames, for buffered line reads."""

    def __init__(self, source: zstandard.ZstdDecompressionReader) -> None:
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for row in parse(content):
                rows.append(row)
                size += len(row[-1] or b"")
                if size > 16 << 20:
                    yield _frame(rows, names)
                    rows, size = [], 0
            if rows:
                yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(_read if payloads else _read_slim, READ if payloads else READ.rpartition(",")[0])


def _read_slim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _read(batches):
        yield batch.drop(columns="payload")
