"""The GGUF container: files to tables of metadata, tensors and tensor rows, and back.

Files are read with Spark's binaryFile source, so any store that Spark reads will do; each
file is parsed by one task from its header on. Damaged files stop the job with the reason.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENT = 32
#: Fixed values of the format: magic, scalar types (id: name, struct code), string and array ids.
MAGIC = b"GGUF"
SCALARS = {0: ("uint8", "B"), 1: ("int8", "b"), 2: ("uint16", "H"), 3: ("int16", "h"), 4: ("uint32", "I"), 5: ("int32", "i"), 6: ("float32", "f"), 7: ("bool", "B"), 10: ("uint64", "Q"), 11: ("int64", "q"), 12: ("float64", "d")}
STRING, ARRAY = 8, 9
#: Fixed values of the tensor types that can be sized: id: (name, bytes of a block, values of a block).
TENSOR_TYPES = {0: ("F32", 4, 1), 1: ("F16", 2, 1), 2: ("Q4_0", 18, 32), 8: ("Q8_0", 34, 32), 12: ("Q4_K", 144, 256), 14: ("Q6_K", 210, 256)}


class GgufError(ValueError):
    """A file that is no valid container."""


def encode(metadata: list[tuple[str, int, object]], tensors: list[tuple[str, list[int], int, bytes]]) -> bytes:
    """A version 3 file of (key, type, value) and (name, dimensions with the fastest first, type, data).

    An array's value is (element type, values).
    """
    out = bytearray(MAGIC + struct.pack("<IQQ", 3, len(tensors), len(metadata)))

    def string(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    def value(kind: int, v: object) -> bytes:
        if kind == STRING:
            return string(v)
        if kind == ARRAY:
            element, values = v
            return struct.pack("<IQ", element, len(values)) + b"".join(value(element, x) for x in values)
        return struct.pack("<" + SCALARS[kind][1], v)

    for key, kind, v in metadata:
        out += string(key) + struct.pack("<I", kind) + value(kind, v)
    data = bytearray()
    for name, dims, kind, raw in tensors:
        out += string(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, len(data))
        data += raw
    out += bytes(-len(out) % ALIGNMENT)
    return bytes(out + data)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise GgufError(f"{n} bytes are asked for at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int | float:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def string(self) -> str:
        return self.take(self.number("Q")).decode()

    def value(self, kind: int, inside: bool = False) -> object:
        if kind == STRING:
            return self.string()
        if kind == ARRAY and not inside:
            element, n = self.number("I"), self.number("Q")
            if n > len(self.data):
                raise GgufError("more elements than bytes")
            return [self.value(element, True) for _ in range(n)]
        if kind not in SCALARS:
            raise GgufError(f"value type {kind}")
        v = self.number(SCALARS[kind][1])
        if kind == 7:
            if v > 1:
                raise GgufError(f"boolean {v}")
            return bool(v)
        return v


def parse_metadata(data: bytes) -> list[tuple[str, str, object]]:
    """[(key, type, value)] of a file or of so much of its begin; what follows the keys is not looked at."""
    return _metadata(_Cursor(data))[0]


def _metadata(c: _Cursor) -> tuple[list[tuple[str, str, object]], int]:
    if c.take(4) != MAGIC:
        raise GgufError("magic")
    if c.number("I") not in (2, 3):
        raise GgufError("version")
    n_tensors, n_keys = c.number("Q"), c.number("Q")
    metadata: dict[str, tuple[str, object]] = {}
    for _ in range(n_keys):
        key, kind = c.string(), c.number("I")
        if key in metadata:
            raise GgufError(f"key {key} twice")
        metadata[key] = ("string" if kind == STRING else "array" if kind == ARRAY else SCALARS.get(kind, ("?",))[0], c.value(kind))
    return [(k, t, v) for k, (t, v) in metadata.items()], n_tensors


def parse(data: bytes) -> tuple[list[tuple[str, str, object]], list[tuple[str, list[int], int, int, int]], int]:
    """([(key, type, value)], [(name, dims, type, offset, bytes)], where the tensors' data begins)."""
    c = _Cursor(data)
    metadata, n_tensors = _metadata(c)
    tensors: dict[str, tuple[list[int], int, int, int]] = {}
    for _ in range(n_tensors):
        name, rank = c.string(), c.number("I")
        dims = [c.number("Q") for _ in range(rank)]
        kind, offset = c.number("I"), c.number("Q")
        if name in tensors:
            raise GgufError(f"tensor {name} twice")
        if kind not in TENSOR_TYPES:
            raise GgufError(f"tensor type {kind}")
        _, size, block = TENSOR_TYPES[kind]
        count = int(np.prod(dims, dtype=object)) if dims else 1
        if not count or count % block:
            raise GgufError(f"shape of {name}")
        tensors[name] = (dims, kind, offset, count // block * size)
    begin = -(-c.at // ALIGNMENT) * ALIGNMENT
    end = 0
    for name, (_, _, offset, size) in sorted(tensors.items(), key=lambda t: t[1][2]):
        if offset < end or begin + offset + size > len(data):
            raise GgufError(f"data of {name} overlaps or is cut off")
        end = offset + size
    return metadata, [(k, *v) for k, v in tensors.items()], begin


def dequantize(kind: int, raw: bytes) -> np.ndarray:
    """FLOAT values of data of any of TENSOR_TYPES; scales must be finite."""
    if kind == 0:
        out = np.frombuffer(raw, "<f4")
    elif kind == 1:
        out = np.frombuffer(raw, "<f2").astype(np.float32)
    elif kind == 8:
        b = np.frombuffer(raw, [("d", "<f2"), ("q", "i1", 32)])
        out = (b["d"].astype(np.float32)[:, None] * b["q"].astype(np.float32)).reshape(-1)
    elif kind == 2:
        b = np.frombuffer(raw, [("d", "<f2"), ("q", "u1", 16)])
        nibbles = np.concatenate([b["q"] & 15, b["q"] >> 4], axis=1).astype(np.float32) - np.float32(8)
        out = (b["d"].astype(np.float32)[:, None] * nibbles).reshape(-1)
    elif kind == 12:
        b = np.frombuffer(raw, [("d", "<f2"), ("dmin", "<f2"), ("s", "u1", 12), ("q", "u1", 128)])
        low, high = b["s"][:, :4], b["s"][:, 4:8]
        step = np.concatenate([low & 63, (b["s"][:, 8:] & 15) | (low >> 6 << 4)], axis=1).astype(np.float32)
        least = np.concatenate([high & 63, (b["s"][:, 8:] >> 4) | (high >> 6 << 4)], axis=1).astype(np.float32)
        halves = b["q"].reshape(-1, 4, 1, 32)
        q = np.concatenate([halves & 15, halves >> 4], axis=2).reshape(-1, 8, 32).astype(np.float32)
        d, dmin = (b[k].astype(np.float32)[:, None] for k in ("d", "dmin"))
        out = ((d * step)[:, :, None] * q - (dmin * least)[:, :, None]).reshape(-1)
    else:
        b = np.frombuffer(raw, [("l", "u1", 128), ("h", "u1", 64), ("s", "i1", 16), ("d", "<f2")])
        l, h = b["l"].reshape(-1, 2, 2, 32), b["h"].reshape(-1, 2, 1, 32)
        low = np.concatenate([l & 15, l >> 4], axis=2)
        high = np.concatenate([h & 3, h >> 2 & 3, h >> 4 & 3, h >> 6], axis=2)
        q = (low | high << 4).astype(np.float32).reshape(-1, 16, 16) - np.float32(32)
        out = ((b["d"].astype(np.float32)[:, None] * b["s"].astype(np.float32))[:, :, None] * q).reshape(-1)
    if not np.isfinite(out).all():
        raise GgufError("a value is not finite")
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under a path. A file is one value, so it has less than 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _each(stored: DataFrame, rows: Callable[[str, bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from rows(path, content)

    return stored.select("path", "content").mapInArrow(run, schema)


def metadata_of(stored: DataFrame) -> DataFrame:
    """(path, key, type, value, text, integer, real): values as JSON, and strings, whole numbers and reals in columns of their own."""

    def rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        found = parse_metadata(content)
        is_int = lambda v: isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63
        columns = {
            "path": pa.array([path] * len(found), pa.string()), "key": pa.array([k for k, _, _ in found], pa.string()), "type": pa.array([t for _, t, _ in found], pa.string()),
            "value": pa.array([json.dumps(v) for _, _, v in found], pa.string()), "text": pa.array([v if isinstance(v, str) else None for _, _, v in found], pa.string()),
            "integer": pa.array([v if is_int(v) else None for _, _, v in found], pa.int64()), "real": pa.array([v if isinstance(v, float) else None for _, _, v in found], pa.float64()),
        }
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return _each(stored, rows, "path string, key string, type string, value string, text string, integer bigint, real double")


def tensors_of(stored: DataFrame) -> DataFrame:
    """(path, name, dims, type, offset, nbytes)."""

    def rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        found = [(path, n, d, TENSOR_TYPES[k][0], o, size) for n, d, k, o, size in parse(content)[1]]
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["path", "name", "dims", "type", "offset", "nbytes"])

    return _each(stored, rows, "path string, name string, dims array<bigint>, type string, offset bigint, nbytes bigint")


def rows_of(stored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, name, row, values): rows as FLOAT arrays, dequantised; of the named tensors only, where names are given."""
    wanted = None if names is None else {*names}

    def rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        _, tensors, begin = parse(content)
        for name, dims, kind, offset, size in tensors:
            if wanted is None or name in wanted:
                values = dequantize(kind, content[begin + offset : begin + offset + size])
                width = dims[0] if dims else 1
                n = len(values) // width
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(np.arange(n), pa.int64()), lists], ["path", "name", "row", "values"])

    return _each(stored, rows, "path string, name string, row bigint, values array<float>")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_of(files(spark, path))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    return tensors_of(files(spark, path))


def read_rows(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    return rows_of(files(spark, path), names)


#: Keys of a model's sizes, after its architecture's name: column -> (key, default or None where it must be there).
CONFIG = {
    "layers": ("block_count", None), "width": ("embedding_length", None), "inner": ("feed_forward_length", None), "heads": ("attention.head_count", None),
    "key_heads": ("attention.head_count_kv", "heads"), "context": ("context_length", None),
}


def model_config(metadata: DataFrame) -> DataFrame:
    """(path, architecture, layers, width, inner, heads, key_heads, context, vocabulary) of each file; a missing key raises, key_heads falls back to heads."""
    named = metadata.filter("key = 'general.architecture'").select("path", F.col("text").alias("architecture"))
    rows = metadata.join(F.broadcast(named), "path")
    part = lambda k: F.max(F.when(F.col("key") == F.concat(F.col("architecture"), F.lit(f".{k}")), F.col("integer")))
    pieces = F.max(F.when(F.col("key") == "tokenizer.ggml.tokens", F.size(F.from_json("value", "array<string>"))))
    flat = rows.groupBy("path", "architecture").agg(*(part(k).alias(c) for c, (k, _) in CONFIG.items()), F.coalesce(part("vocab_size"), pieces).alias("vocabulary"))
    need = lambda c, v: F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"no {c}")).cast("bigint"))
    sizes = [need(c, F.coalesce(F.col(c), F.col(default)) if default else F.col(c)).alias(c) for c, (_, default) in CONFIG.items()]
    return flat.select("path", "architecture", *sizes, need("vocabulary", F.col("vocabulary")).cast("bigint").alias("vocabulary"))


def expected_tensors(config: DataFrame) -> DataFrame:
    """(path, name, dims, matrix): what a decoder of these sizes consists of, the output matrix excepted."""
    w, inner, keys = F.col("width"), F.col("inner"), F.col("width") / F.col("heads") * F.col("key_heads")
    item = lambda name, dims, matrix: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.array(*(d.cast("bigint") for d in dims)).alias("dims"), F.lit(matrix).alias("matrix"))
    layer = lambda i, name, dims, matrix: item(F.concat(F.lit("blk."), i.cast("string"), F.lit(f".{name}.weight")), dims, matrix)
    per_layer = lambda i: F.array(
        layer(i, "attn_norm", [w], False), layer(i, "attn_q", [w, w], True), layer(i, "attn_k", [w, keys], True), layer(i, "attn_v", [w, keys], True), layer(i, "attn_output", [w, w], True),
        layer(i, "ffn_norm", [w], False), layer(i, "ffn_gate", [w, inner], True), layer(i, "ffn_up", [w, inner], True), layer(i, "ffn_down", [inner, w], True),
    )
    whole = F.array(item("token_embd.weight", [w, F.col("vocabulary")], True), item("output_norm.weight", [w], False))
    each = F.concat(whole, F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("layers") - 1), per_layer)))
    return config.select("path", F.explode(each).alias("t")).select("path", "t.name", "t.dims", "t.matrix")


def check_tensors(expected: DataFrame, tensors: DataFrame) -> DataFrame:
    """(path, name, issue): missing, shape or type (vectors are F32 or F16) of what is expected, by one left join."""
    found = tensors.select("path", "name", F.col("dims").alias("has"), "type")
    both = expected.join(found, ["path", "name"], "left")
    issues = F.array(
        F.when(F.col("has").isNull(), F.lit("missing")), F.when(F.col("has") != F.col("dims"), F.lit("shape")), F.when(~F.col("matrix") & ~F.col("type").isin("F32", "F16"), F.lit("type"))
    )
    return both.select("path", "name", F.explode(F.array_compact(issues)).alias("issue"))


def inventory(tensors: DataFrame) -> DataFrame:
    """(type, tensors, nbytes) over all files."""
    return tensors.groupBy("type").agg(F.count(F.lit(1)).alias("tensors"), F.sum("nbytes").alias("nbytes"))
