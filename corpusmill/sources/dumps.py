"""Dumps of scores: FLOAT rows, log probabilities in 16 bits, and files of labelled digests.

Files come from Spark's binaryFile and text sources. A dump is read one file to a task; rows
that follow from it stand in as many rows of the table. Damaged files stop the job with the
reason.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed values of the 16-bit dump: magic and the size of its header.
MAGIC, HEADER = b"_logits_", 20


class DumpError(ValueError):
    """A file that is no valid dump."""


def float_dump(values: Column) -> Column:
    """BINARY of array<float>: little-endian, four bytes each."""
    return _pack_floats(values)


@F.pandas_udf(BinaryType())
def _pack_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.asarray(v, "<f4").tobytes())


def parse_float_dump(data: bytes) -> np.ndarray:
    if not data or len(data) % 4:
        raise DumpError(f"{len(data)} bytes are no FLOATs")
    out = np.frombuffer(data, "<f4")
    if not np.isfinite(out).all():
        raise DumpError(f"value {int(np.flatnonzero(~np.isfinite(out))[0])} is not finite")
    return out


def encode_log_probs(n_ctx: int, tokens: np.ndarray, rows: np.ndarray) -> bytes:
    """A dump of chunks of n_ctx tokens and the log probabilities (rows, vocabulary) of their evaluated positions."""
    chunks, vocabulary = len(tokens) // n_ctx, rows.shape[1]
    out = bytearray(MAGIC + struct.pack("<Iii", n_ctx, vocabulary, chunks) + np.asarray(tokens, "<i4").tobytes())
    for row in np.asarray(rows, np.float32):
        least = row.min()
        scale = np.float32((row.max() - least) / np.float32(65535))
        q = np.zeros(len(row) + len(row) % 2, "<u2")
        if scale > 0:
            q[: len(row)] = np.rint((row - least) / scale)
        out += struct.pack("<ff", scale, least) + q.tobytes()
    return bytes(out)


def parse_log_probs(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n_ctx, chunks, tokens by chunk, log probabilities by evaluated position)."""
    if len(data) < HEADER or data[:8] != MAGIC:
        raise DumpError("magic")
    n_ctx, vocabulary, chunks = struct.unpack_from("<Iii", data, 8)
    evaluated = n_ctx - 1 - n_ctx // 2
    if n_ctx < 2 or vocabulary < 1 or chunks < 1 or evaluated < 1:
        raise DumpError("sizes")
    width = 8 + 2 * (vocabulary + vocabulary % 2)
    begin = HEADER + 4 * n_ctx * chunks
    if len(data) != begin + evaluated * chunks * width:
        raise DumpError(f"{len(data)} bytes, {begin + evaluated * chunks * width} are due")
    tokens = np.frombuffer(data, "<i4", n_ctx * chunks, HEADER).reshape(chunks, n_ctx)
    if (tokens < 0).any() or (tokens >= vocabulary).any():
        raise DumpError("a token is outside the vocabulary")
    rows = np.frombuffer(data, [("scale", "<f4"), ("least", "<f4"), ("q", "<u2", vocabulary + vocabulary % 2)], evaluated * chunks, begin)
    if not (rows["scale"] >= 0).all() or not np.isfinite(rows["scale"]).all() or not np.isfinite(rows["least"]).all():
        raise DumpError("scale")
    return n_ctx, chunks, tokens, rows["least"][:, None] + rows["scale"][:, None] * rows["q"][:, :vocabulary].astype(np.float32)


def read_log_probs(dumps: DataFrame) -> DataFrame:
    """(path, chunk, position, target, log_probs) of rows (path, content), as binaryFile gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_ctx, chunks, tokens, values = parse_log_probs(content)
                first = n_ctx // 2
                each = n_ctx - 1 - first
                position = np.tile(np.arange(first, n_ctx - 1), chunks)
                chunk = np.repeat(np.arange(chunks), each)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))
                columns = [pa.array([path] * len(values), pa.string()), pa.array(chunk, pa.int64()), pa.array(position, pa.int64()), pa.array(tokens[chunk, position + 1].astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["path", "chunk", "position", "target", "log_probs"])

    return dumps.select("path", "content").mapInArrow(run, "path string, chunk bigint, position bigint, target bigint, log_probs array<float>")


def compare_log_probs(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row over the positions of two dumps (joined by chunk and position): rows, n, max_abs, rms and max_target_abs; targets must agree."""
    pair = actual.alias("a").join(expected.alias("e"), ["chunk", "position"])
    gap = F.zip_with("a.log_probs", "e.log_probs", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    same = F.when(F.col("a.target") == F.col("e.target"), F.col("a.target")).otherwise(F.raise_error(F.lit("targets differ")).cast("bigint"))
    each = pair.select(gap.alias("gap"), same.cast("int").alias("t"))
    each = each.select(F.size("gap").cast("bigint").alias("n"), F.array_max("gap").alias("most"), F.aggregate("gap", F.lit(0.0), lambda s, x: s + x * x).alias("sq"), F.get("gap", F.col("t")).alias("at_target"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.max("most").alias("max_abs"), F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"), F.max("at_target").alias("max_target_abs"))


def read_hashes(lines: DataFrame, line_col: str = "value", path_col: str = "path") -> DataFrame:
    """(path, label, sha256) of lines 'label digest'; other lines and labels that repeat in a file raise."""
    parts = F.split(F.trim(line_col), r"\s+")
    good = (F.size(parts) == 2) & parts[1].rlike("^[0-9a-f]{64}$")
    checked = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("no label and digest: "), F.col(line_col))).cast("array<string>"))
    rows = lines.select(path_col, checked.alias("p")).groupBy(path_col, F.col("p")[0].alias("label")).agg(F.min(F.col("p")[1]).alias("sha256"), F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") == 1, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("label twice: "), F.col("label"))))
    return rows.select(F.col(path_col).alias("path"), "label", once.alias("sha256"))


def read_hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, sha256) of all files under a path."""
    return read_hashes(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")))
