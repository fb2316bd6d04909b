"""Byte models with integer CDFs: counted by Spark, quantised, validated, and applied as code lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.binary import utf8

#: Frequencies of a context add up to about this; every one of the 256 bytes has at least 1.
SCALE = 1 << 16
START = -1
#: Bytes of texts whose cells are held at once.
_AT_ONCE = 1 << 20


def pair_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(prev, byte, n): how often each byte follows each other one; prev is START at a text's begin.

    A task counts all its texts in one table of 257 x 256 cells, and only its used cells are
    shuffled, however long the texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(257 * 256, np.int64)
        for batch in batches:
            for _, _, _, found in _piece_cells(batch.column(0)):
                cells += np.bincount(found, minlength=257 * 256)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used // 256 + START, pa.int32()), pa.array(used % 256, pa.int32()), pa.array(cells[used])], ["prev", "byte", "n"])

    each = documents.select(utf8(F.col(text_col)).alias("data")).mapInArrow(run, "prev int, byte int, n bigint")
    return each.groupBy("prev", "byte").agg(F.sum("n").alias("n"))


def text_bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    data = data.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most so many bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _pairs(values: np.ndarray, offsets: np.ndarray, before_first: int = 0) -> np.ndarray:
    """The cell of each byte with the one before it; before_first stands before the first text's first byte."""
    cells = np.zeros(len(values), np.int32)
    cells[1:] = values[:-1]
    cells[1:] += 1
    cells[offsets[:-1][np.diff(offsets) > 0]] = 0
    cells[:1] = before_first
    cells *= 256
    cells += values
    return cells


def _piece_cells(data: pa.Array, most: int = _AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, offsets, cells) of at most so many bytes at once; a longer text comes in several such pieces."""
    values, offsets = text_bytes(data)
    for i, j in spans(offsets, most):
        for a in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), most):
            b = min(a + most, int(offsets[j]))
            inner = np.clip(offsets[i : j + 1], a, b) - a
            yield i, j, inner, _pairs(values[a:b], inner, int(values[a - 1]) + 1 if a > offsets[i] else 0)


def byte_counts(documents: DataFrame, group: str, text_col: str = "text", most: int = 4096) -> DataFrame:
    """(group, byte, n) of all texts of a group; a task keeps the counts of at most so many groups before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            names, places, counts = [], [], []
            for name, c in held.items():
                used = np.flatnonzero(c)
                names += [name] * len(used)
                places.append(used)
                counts.append(c[used])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["g", "byte", "n"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = held.setdefault(name, np.zeros(256, np.int64))
                values = np.frombuffer(data.as_buffer(), np.uint8)
                for a in range(0, len(values), _AT_ONCE):
                    c += np.bincount(values[a : a + _AT_ONCE], minlength=256)
                if len(held) > most:
                    yield send()
        if held:
            yield send()

    rows = documents.select(F.col(group).cast("string").alias("g"), utf8(F.col(text_col)).alias("data"))
    return rows.mapInArrow(run, "g string, byte int, n bigint").groupBy(F.col("g").alias(group), "byte").agg(F.sum("n").alias("n"))


def byte_cdf(pairs: DataFrame) -> DataFrame:
    """(prev, byte, freq, cum, total) of every seen pair: integer frequencies, 1 + floor(count * SCALE / context's count).

    Bytes that never follow a context have frequency 1 there, too: they stand after the seen
    ones, and total counts them. At most 257 x 256 rows.
    """
    counts = pairs.groupBy("prev", "byte").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("prev")
    before = whole.orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    freq = 1 + F.floor(F.col("n") * SCALE / F.sum("n").over(whole)).cast("bigint")
    out = counts.withColumn("freq", freq)
    unseen = 256 - F.count(F.lit(1)).over(whole)
    return out.select("prev", "byte", "freq", F.coalesce(F.sum("freq").over(before), F.lit(0)).alias("cum"), (F.sum("freq").over(whole) + unseen).alias("total"))


def cdf_violations(cdf: DataFrame) -> DataFrame:
    """(prev, symbols, violations): rows whose frequency, running sum or total is not what a CDF must have."""
    w = Window.partitionBy("prev").orderBy("byte")
    expected = F.coalesce(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = (F.col("freq") < 1) | (F.col("cum") != expected) | (F.col("cum") + F.col("freq") > F.col("total")) | (F.col("total") >= 1 << 31)
    return cdf.select("prev", bad.alias("bad")).groupBy("prev").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.col("bad").cast("bigint")).alias("violations"))


def code_lengths(documents: DataFrame, cdf: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, bits): the ideal length of each text under the CDF, looked up in its 257 x 256 cells. No shuffle."""
    bits = np.zeros(257 * 256)
    for r in cdf.select("prev", "byte", "freq", "total").collect():
        bits[(r["prev"] - START) * 256 + r["byte"]] = np.log2(r["total"] / r["freq"])
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for i, j, offsets, cells in _piece_cells(batch.column(1)):
                sums[i:j] += np.add.reduceat(np.append(shared.value[cells], 0.0), offsets[:-1]) * (np.diff(offsets) > 0)
                sizes[i:j] += np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sums, pa.float64())], ["id", "n_bytes", "bits"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("data")).mapInArrow(run, f"id {kind}, n_bytes bigint, bits double")


#: Frequencies of a CDF of logits add up to about this, and in all to less than MOST_TOTAL.
MOST_TOTAL = 1 << 31


def symbol_range(frequencies: Column, symbol: Column, escapes: bool = False) -> Column:
    """struct<cum, freq, total> of one symbol of array<bigint> frequencies; with escapes 256 symbols of frequency 1 follow. Null for a symbol that is none."""
    n = F.size(frequencies)
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    total = add(frequencies) + (256 if escapes else 0)
    inside = symbol < n
    cum = F.when(inside, add(F.slice(frequencies, 1, F.least(symbol, n).cast("int")))).otherwise(add(frequencies) + symbol - n)
    freq = F.when(inside, F.get(frequencies, symbol.cast("int"))).otherwise(F.lit(1).cast("bigint"))
    good = (symbol >= 0) & (symbol < n + (256 if escapes else 0)) & (total < MOST_TOTAL)
    return F.when(good, F.struct(cum.alias("cum"), freq.alias("freq"), total.alias("total")))


def uniform_range(symbol: Column, vocabulary: Column, escapes: bool = False) -> Column:
    """struct<cum, freq, total> where no context says anything: each symbol has frequency 1."""
    total = (vocabulary + (256 if escapes else 0)).cast("bigint")
    return F.when((symbol >= 0) & (symbol < total), F.struct(symbol.cast("bigint").alias("cum"), F.lit(1).cast("bigint").alias("freq"), total.alias("total")))


def range_is_valid(r: Column) -> Column:
    """Whether a struct<cum, freq, total> can be coded."""
    return (r["freq"] > 0) & (r["cum"] >= 0) & (r["cum"] + r["freq"] <= r["total"]) & (r["total"] < MOST_TOTAL)
