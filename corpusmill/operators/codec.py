"""Lossless compression of documents: a byte model counted by Spark, and a range coder for its integer CDFs.

The coder is the carry-less one of D. Subbotin with 64-bit registers: a code is a number in
[low, low + range), bytes leave when the top ones agree, and a range that is too small is
cut at the next boundary of 2**48. Documents are coded independently, one row each, in the
scan's own partitions; the model's table has at most 257 x 256 cells and is broadcast.

A task codes the documents of about HELD_BYTES together, the next byte of each in one step of
arrays, longest first; the few that go on when fewer than LANES are left are coded one by one.
Payloads are those of `encode_bytes`, to the bit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.model import START, spans, text_bytes

#: Bytes of texts that are coded together, and the fewest texts that are worth a step of arrays.
HELD_BYTES, LANES = 16 << 20, 16

_TOP, _BOTTOM, _MASK = 1 << 56, 1 << 48, (1 << 64) - 1


class Encoder:
    def __init__(self) -> None:
        self.low, self.range, self.out = 0, _MASK, bytearray()

    def put(self, cum: int, freq: int, total: int) -> None:
        if freq < 1 or cum < 0 or cum + freq > total or total >= 1 << 31:
            raise ValueError(f"range {cum}, {freq}, {total}")
        unit = self.range // total
        self.low = (self.low + unit * cum) & _MASK
        self.range = unit * freq
        while True:
            if (self.low ^ (self.low + self.range & _MASK)) >= _TOP:
                if self.range >= _BOTTOM:
                    return
                self.range = -self.low & (_BOTTOM - 1)
            self.out.append(self.low >> 56)
            self.low, self.range = self.low << 8 & _MASK, self.range << 8 & _MASK

    def finish(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(8, "big")


class Decoder:
    def __init__(self, data: bytes) -> None:
        if len(data) < 8:
            raise ValueError("a payload has 8 bytes at least")
        self.data, self.at, self.low, self.range, self.code = data, 8, 0, _MASK, int.from_bytes(data[:8], "big")

    def target(self, total: int) -> int:
        """Where the next symbol's cumulative frequencies lie."""
        self.unit = self.range // total
        value = (self.code - self.low & _MASK) // self.unit
        if value >= total:
            raise ValueError("the payload is damaged")
        return value

    def skip(self, cum: int, freq: int) -> None:
        self.low = (self.low + self.unit * cum) & _MASK
        self.range = self.unit * freq
        while True:
            if (self.low ^ (self.low + self.range & _MASK)) >= _TOP:
                if self.range >= _BOTTOM:
                    return
                self.range = -self.low & (_BOTTOM - 1)
            if self.at >= len(self.data):
                raise ValueError("the payload is cut off")
            self.code = (self.code << 8 | self.data[self.at]) & _MASK
            self.at += 1
            self.low, self.range = self.low << 8 & _MASK, self.range << 8 & _MASK


def model_table(cdf: DataFrame) -> list[list[int]]:
    """257 rows (by previous byte, START first) of 257 cumulative frequencies: seen bytes as counted, all others 1."""
    freq = np.ones((257, 256), np.int64)
    for r in cdf.select("prev", "byte", "freq").collect():
        freq[r["prev"] - START, r["byte"]] = r["freq"]
    return np.concatenate([np.zeros((257, 1), np.int64), freq.cumsum(axis=1)], axis=1).tolist()


def encode_bytes(data: bytes, table: list[list[int]]) -> bytes:
    coder, prev = Encoder(), START
    for b in data:
        cum = table[prev - START]
        coder.put(cum[b], cum[b + 1] - cum[b], cum[256])
        prev = b
    return coder.finish()


def decode_bytes(payload: bytes, n: int, table: list[list[int]]) -> bytes:
    """The n bytes of a payload; it must be the one that encoding them gives."""
    coder, prev, out = Decoder(payload), START, bytearray()
    for _ in range(n):
        cum = table[prev - START]
        prev = bisect_right(cum, coder.target(cum[256])) - 1
        coder.skip(cum[prev], cum[prev + 1] - cum[prev])
        out.append(prev)
    if encode_bytes(bytes(out), table) != payload:
        raise ValueError("the payload is not canonical")
    return bytes(out)


class _Lanes:
    """Coder states side by side, as in Encoder and Decoder."""

    def __init__(self, table: list[list[int]], n: int) -> None:
        cum = np.array(table, np.uint64)
        if (cum[:, 1:] <= cum[:, :-1]).any() or (cum[:, -1] >= 1 << 31).any():
            raise ValueError("frequencies must be positive, and totals below 2**31")
        self.cum, self.freq, self.total = cum[:, :-1].reshape(-1), (cum[:, 1:] - cum[:, :-1]).reshape(-1), cum[:, -1].copy()
        self.low, self.range, self.prev = np.zeros(n, np.uint64), np.full(n, _MASK, np.uint64), np.full(n, START - START, np.int64)

    def narrow(self, k: int, unit: np.ndarray, symbols: np.ndarray) -> None:
        """The first k lanes take a symbol each."""
        at = self.prev[:k] * 256 + symbols
        self.low[:k] += unit * self.cum[at]
        np.multiply(unit, self.freq[at], out=self.range[:k])
        self.prev[:k] = symbols + 1

    def leaving(self, lanes: np.ndarray | slice) -> np.ndarray:
        """Which of the lanes have a byte to leave; ranges that are too small are cut."""
        low, size = self.low[lanes], self.range[lanes]
        apart = (low ^ (low + size)) >= np.uint64(_TOP)
        small = size < np.uint64(_BOTTOM)
        cut = np.flatnonzero(apart & small)
        if len(cut):
            where = cut if isinstance(lanes, slice) else lanes[cut]
            self.range[where] = (~low[cut] + np.uint64(1)) & np.uint64(_BOTTOM - 1)
        out = np.flatnonzero(~apart | small)
        return out if isinstance(lanes, slice) else lanes[out]

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= np.uint64(8)
        self.range[lanes] <<= np.uint64(8)


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts by falling size, how many have a byte at each place, as long as LANES have)."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    most = int(falling[LANES - 1]) if len(falling) >= LANES else 0
    return order, np.searchsorted(-falling, -np.arange(most), side="left")


def encode_texts(values: np.ndarray, offsets: np.ndarray, table: list[list[int]]) -> list[bytes]:
    """`encode_bytes` of each text."""
    order, counts = _steps(np.diff(offsets))
    lanes, starts = _Lanes(table, len(order)), offsets[:-1][order]
    # sixteen bits are sorted by counting
    kind = np.uint16 if len(order) <= 1 << 16 else np.int32
    of, out = [np.zeros(0, kind)], [np.zeros(0, np.uint8)]
    for place, k in enumerate(counts.tolist()):
        lanes.narrow(k, lanes.range[:k] // lanes.total[lanes.prev[:k]], values[starts[:k] + place].astype(np.int64))
        left = lanes.leaving(slice(0, k))
        while len(left):
            of.append(left.astype(kind))
            out.append((lanes.low[left] >> np.uint64(56)).astype(np.uint8))
            lanes.shift(left)
            left = lanes.leaving(left)
    of, out = np.concatenate(of), np.concatenate(out)
    out = out[np.argsort(of, kind="stable")].tobytes()
    ends = np.cumsum(np.bincount(of, minlength=len(order))).tolist()
    payloads, done = [b""] * len(order), len(counts)
    for lane, text in enumerate(order.tolist()):
        coder = Encoder()
        coder.low, coder.range = int(lanes.low[lane]), int(lanes.range[lane])
        prev = int(lanes.prev[lane]) + START
        for b in values[starts[lane] + done : offsets[text + 1]].tolist():
            cum = table[prev - START]
            coder.put(cum[b], cum[b + 1] - cum[b], cum[256])
            prev = b
        payloads[text] = out[ends[lane - 1] if lane else 0 : ends[lane]] + coder.finish()
    return payloads


def _finder(table: list[list[int]], most: int = 1 << 17) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The symbols of (previous byte + 1, target): looked up where totals are small, else searched."""
    cum = np.array(table, np.int64)
    width = int(cum[:, -1].max())
    if width <= most:
        found = np.zeros((257, width), np.uint8)
        for row, c in zip(found, cum, strict=True):
            row[: c[-1]] = np.repeat(np.arange(256, dtype=np.uint8), np.diff(c))
        flat = found.reshape(-1)
        return lambda prev, target: flat[prev * width + target].astype(np.int64)
    edges = (cum[:, :-1] + (np.arange(257) << 32)[:, None]).reshape(-1)
    return lambda prev, target: np.searchsorted(edges, (prev << 32) + target, side="right") - 1 - prev * 256


def decode_texts(payloads: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, table: list[list[int]]) -> np.ndarray:
    """The bytes of all texts, one after another, as `decode_bytes` gives them.

    A payload is what encoding gives if each byte that leaves is the one that the encoder's
    `low` has, and the last 8 bytes are `low` itself.
    """
    if (np.diff(offsets) < 8).any():
        raise ValueError("a payload has 8 bytes at least")
    order, counts = _steps(sizes)
    lanes, n = _Lanes(table, len(order)), len(order)
    at, ends = offsets[:-1][order] + 8, offsets[1:][order]
    code = np.zeros(n, np.uint64)
    for i in range(8):
        code = code << np.uint64(8) | payloads[at - 8 + i]
    begins = np.cumsum(sizes) - sizes
    out, starts = np.zeros(int(sizes.sum()), np.uint8), begins[order]
    find = _finder(table)
    for place, k in enumerate(counts.tolist()):
        prev = lanes.prev[:k]
        total = lanes.total[prev]
        unit = lanes.range[:k] // total
        target = (code[:k] - lanes.low[:k]) // unit
        if (target >= total).any():
            raise ValueError("the payload is damaged")
        symbols = find(prev, target.astype(np.int64))
        out[starts[:k] + place] = symbols
        lanes.narrow(k, unit, symbols)
        left = lanes.leaving(slice(0, k))
        while len(left):
            if (at[left] >= ends[left]).any():
                raise ValueError("the payload is cut off")
            if ((code[left] ^ lanes.low[left]) >= np.uint64(_TOP)).any():
                raise ValueError("the payload is not canonical")
            code[left] = code[left] << np.uint64(8) | payloads[at[left]]
            at[left] += 1
            lanes.shift(left)
            left = lanes.leaving(left)
    done = len(counts)
    for lane in np.flatnonzero(sizes[order] > done).tolist():
        # the eight bytes of the code stand before `at`; coding again from here gives the rest of the payload
        rest = payloads[at[lane] - 8 : ends[lane]].tobytes()
        coder, again = Decoder(rest), Encoder()
        coder.low, coder.range = again.low, again.range = int(lanes.low[lane]), int(lanes.range[lane])
        prev, found = int(lanes.prev[lane]) + START, bytearray()
        for _ in range(int(sizes[order[lane]]) - done):
            cum = table[prev - START]
            prev = bisect_right(cum, coder.target(cum[256])) - 1
            coder.skip(cum[prev], cum[prev + 1] - cum[prev])
            again.put(cum[prev], cum[prev + 1] - cum[prev], cum[256])
            found.append(prev)
        if again.finish() != rest:
            raise ValueError("the payload is not canonical")
        out[starts[lane] + done : starts[lane] + done + len(found)] = np.frombuffer(found, np.uint8)
    whole = sizes[order] <= done
    if (at[whole] != ends[whole]).any() or (code[whole] != lanes.low[whole]).any():
        raise ValueError("the payload is not canonical")
    return out


def _held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about HELD_BYTES in that column."""
    held, size = [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        for i, j in spans(offsets, HELD_BYTES):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= HELD_BYTES // 2:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def compress(documents: DataFrame, table: list[list[int]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, payload) and the columns to keep."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, 1):
            values, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(encode_texts(values, offsets, shared.value), pa.binary()), *batch.columns[2:]], ["id", "n_bytes", "payload", *keep])

    kind = documents.schema[id_col].dataType.simpleString()
    more = "".join(f", `{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *keep).mapInArrow(run, f"id {kind}, n_bytes bigint, payload binary{more}").withColumnRenamed("id", id_col)


def decompress(compressed: DataFrame, table: list[list[int]], id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text) and the columns to keep."""
    shared = compressed.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, 2):
            sizes = batch.column(1).to_numpy()
            for i, j in spans(np.concatenate([[0], np.cumsum(sizes)]), 4 * HELD_BYTES):
                out = decode_texts(*text_bytes(batch.column(2).slice(i, j - i)), sizes[i:j], shared.value)
                bounds = np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(np.int64)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), texts, *(c.slice(i, j - i) for c in batch.columns[3:])], ["id", "text", *keep])

    kind = compressed.schema[id_col].dataType.simpleString()
    more = "".join(f", `{k}` {compressed.schema[k].dataType.simpleString()}" for k in keep)
    carried = [F.col(k).alias(f"kept_{k}") for k in keep]
    return compressed.select(F.col(id_col).alias("id"), "n_bytes", "payload", *carried).mapInArrow(run, f"id {kind}, text string{more}").withColumnRenamed("id", id_col)
