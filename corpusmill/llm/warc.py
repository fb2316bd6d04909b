"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record.

Writing: the first record (smallest page_id) of each payload is a response, all others with
that payload are revisits of it. Payloads below `least_bytes` are never revisited. Archives
hold about `archive_bytes` of compressed records each and are stored as rows (archive,
records, data) of a Parquet table, so that any store that Spark can write to will do.

Reading: frames are walked by their block headers and decoded one at a time with the
archive's own dictionary; versions, lengths, ids and digests are validated.

Null html is the empty payload; null urls are left out of the record. Rows that repeat a
page_id with its payload are each a response if theirs is the smallest id, and a null
page_id comes after all others. An empty table gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of WARC's zstd format: the skippable frame that carries the dictionary.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICT_SAMPLES = 256
DICT_SAMPLE_BYTES = 16_384
DICT_BYTES = 32_768
_DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> bytes:
    """A dictionary from at most DICT_SAMPLES pages (those of the smallest hashes), DICT_SAMPLE_BYTES of each.

    Tasks send hashes first, and then only the pages up to the DICT_SAMPLES-th: what reaches
    the driver does not grow with the number of tasks times the size of a page.
    """
    hashed = pages.select(F.xxhash64(F.col(id_col), F.col(html_col)).alias("h"), F.substring(F.col(html_col), 1, DICT_SAMPLE_BYTES).alias("x")).filter("x is not null")
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(DICT_SAMPLES).collect()]
    rows = hashed.filter(F.col("h") <= max(least)).groupBy("h").agg(F.min("x").alias("x")).collect() if least else []
    samples = [r["x"].encode()[:DICT_SAMPLE_BYTES] for r in sorted(rows) if r["x"]]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their raw content serves as well
        return b"".join(samples)[:DICT_BYTES].ljust(8, b" ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header block, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if not first:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """(page_id, url, payload length, payload digest, type, refers_to) of a valid record; else ValueError."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not cut or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length and block differ")
    block = rest[:length]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest")
    http, cut, payload = block.partition(b"\r\n\r\n")
    said = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda v: int(v[10:-1]) if v[10:-1] else None
    if fields["WARC-Type"] == "response":
        if len(payload) != said or base32_sha1(payload) != digest:
            raise ValueError("payload digest or length")
        return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), said, digest, "response", None
    if fields["WARC-Type"] != "revisit" or payload:
        raise ValueError("record type")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), said, digest, "revisit", number(fields["WARC-Refers-To"])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and block sizes."""
    if struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise ValueError("no Zstandard frame")
    checksum = 4 if data[at + 4] & 4 else 0
    at += zstd.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + checksum


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decoded frame by frame."""
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE or len(data) < 8 + size:
        raise ValueError("no leading dictionary frame")
    plain = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        end = frame_end(view, at)
        yield plain.decompress(view[at:end])
        at = end


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses.

    Only payloads that occur twice or more meet in the join; the digest table is aggregated
    before it is shuffled, and Spark splits a partition that one hot payload makes large.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = base.withColumn("digest", F.sha2("payload", 256))
    first = (
        keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    )
    joined = keyed.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(marked: DataFrame, dictionary: bytes, archive_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Rows (archive, records, data) of whole archives; each task fills its own, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        task, k, frames, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal k, frames, size
            out = pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{k:06d}.warc.zst"]), pa.array([len(frames)], pa.int64()), pa.array([archive_head(dictionary) + b"".join(frames)], pa.binary())], ["archive", "records", "data"])
            k, frames, size = k + 1, [], 0
            return out

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(press.compress(record(page_id, url, payload, refers_to, refers_to is None)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield close()
        if frames:
            yield close()

    return marked.select(F.col("page_id").cast("bigint"), "url", "payload", F.col("refers_to").cast("bigint")).mapInArrow(run, "archive string, records bigint, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, validated: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for archive, records, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                rows = [(*parse_record(r), archive.as_py()) for r in read_archive(data.as_py())]
                if len(rows) != records.as_py():
                    raise ValueError(f"{archive}: {len(rows)} records, {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return archives.select("archive", "records", "data").mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string")


#: The same rows from the payloads themselves; base 32 is built from groups of five hexadecimal digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
