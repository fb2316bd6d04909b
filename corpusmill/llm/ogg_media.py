"""Media columns in Ogg: write payloads as 8-bit samples in two multiplexed logical streams, and read them back.

The writer lays packets into pages by lacing values and seals each page with its checksum.
The reader trusts nothing: it verifies the capture pattern, checksum and sequence of each
page, demultiplexes the logical streams by serial number, reassembles packets (also across
pages) from lacing values, and derives timestamps from granule positions.

Null text is the empty text; empty text is one padded unit. Equal texts give equal values.
Rows that repeat are stored and read each. An empty table gives an empty one. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 8000
STREAMS = 2
PACKET = 960
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sIIBBq")
_MAGIC = b"pcm-u8\x00\x01"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The Ogg checksum: polynomial 0x04c11db7, most significant bit first, from 0.

    zlib's checksum is the same polynomial with bits reversed; reversing the bits of every
    byte before, and of the result after, turns the one into the other.
    """
    low = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(body: bytes, lacing: bytes, serial: int, sequence: int, granule: int, flags: int) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", page_crc(blank)) + blank[26:]


def _stream_pages(packets: list[bytes], serial: int, first_granule: int = 0) -> list[tuple[int, bytes]]:
    """(sort key, page) of one logical stream; its first packet is its header, alone on its page."""
    pages = [(-1, _page(packets[0], bytes([len(packets[0])]), serial, 0, 0, 2))]
    lacing, body, granule, ended, continued, sequence = bytearray(), bytearray(), first_granule, -1, False, 1

    def flush(last: bool) -> None:
        nonlocal lacing, body, ended, continued, sequence
        flags = (1 if continued else 0) | (4 if last else 0)
        pages.append((granule, _page(bytes(body), bytes(lacing), serial, sequence, ended, flags)))
        continued = bool(lacing) and lacing[-1] == 255
        lacing, body, ended, sequence = bytearray(), bytearray(), -1, sequence + 1

    for packet in packets[1:]:
        for at in range(0, len(packet) + 1, 255):
            if len(lacing) == 255:
                flush(False)
            segment = packet[at : at + 255]
            lacing.append(len(segment))
            body += segment
        granule += len(packet)
        ended = granule
    flush(True)
    return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file: the payload's halves are the sample streams 0 and 1, interleaved by granule position."""
    half = len(payload) // STREAMS
    pages = []
    for k in range(STREAMS):
        samples = payload[k * half : (k + 1) * half if k < STREAMS - 1 else len(payload)]
        head = _ID.pack(_MAGIC, RATE, PACKET, k, STREAMS, len(samples))
        packets = [head, *(samples[i : i + PACKET] for i in range(0, len(samples), PACKET))]
        pages += [(granule, k, i, page) for i, (granule, page) in enumerate(_stream_pages(packets, 0x70636D00 + k))]
    return b"".join(page for *_, page in sorted(pages, key=lambda p: p[:3]))


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """serial -> [(packet, granule position at its end, or -1 for the header)]; ValueError on any damage."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError("no whole page")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of page {sequence} of stream {serial}")
        s = streams.setdefault(serial, {"next": 0, "part": [], "packets": [], "ended": False})
        if sequence != s["next"] or bool(flags & 2) != (sequence == 0) or s["ended"] or bool(flags & 1) != bool(s["part"]):
            raise ValueError(f"page {sequence} of stream {serial} is out of place")
        s["next"] += 1
        s["ended"] = bool(flags & 4)
        body, done = at + 27 + n, []
        for size in lacing:
            s["part"].append(media[body : body + size])
            body += size
            if size < 255:
                done.append(b"".join(s["part"]))
                s["part"] = []
        if (granule == -1) != (not done):
            raise ValueError("granule position without an ended packet")
        position = granule - sum(map(len, done))
        for packet in done:
            position += len(packet)
            s["packets"].append((packet, position))
        at = end
    if any(s["part"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream is not ended")
    return {serial: s["packets"] for serial, s in streams.items()}


def decode(media: bytes) -> tuple[bytes, int, int, float]:
    """(payload, packets, logical streams, seconds): packets stand in the order of their timestamps."""
    parts, n, seconds = {}, 0, 0.0
    for packets in demultiplex(media).values():
        magic, rate, _, k, count, total = _ID.unpack(packets[0][0])
        if magic != _MAGIC:
            raise ValueError("unknown stream header")
        timed = sorted((end - len(packet), packet) for packet, end in packets[1:])
        samples = b"".join(packet for _, packet in timed)
        at = 0
        for start, packet in timed:
            if start != at:
                raise ValueError("granule positions leave a gap")
            at += len(packet)
        if len(samples) != total:
            raise ValueError("samples are missing")
        parts[k] = samples
        n += len(timed)
        seconds = max(seconds, at / rate)
    if sorted(parts) != [*range(count)]:
        raise ValueError("a logical stream is missing")
    return b"".join(parts[k] for k in range(count)), n, count, seconds


def pad(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def features(payload: bytes, packets: int, streams: int, seconds: float) -> str:
    """Level, peak and zero crossings of the samples around 128, with the container's counts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={streams};packets={packets};seconds={seconds:.6f};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def write_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes of the text and `media`, the Ogg file of the padded payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.as_py() or b"" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode(pad(r)) for r in raws], pa.binary())], ["id", "n_bytes", "media"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    return out.withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """Digests and features of stored Ogg files (columns id, n_bytes, media); the payload itself on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                payload, packets, streams, seconds = decode(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, packets, streams, seconds)) + (payload,) * with_payload)
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["payload"] * with_payload
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "n_bytes", *names])

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", payload binary" * with_payload
    return stored.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
