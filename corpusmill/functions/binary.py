"""Bytes as tokens, digests, half floats and the 56-byte container header, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the container header: magic, version, and the flag for byte escapes.
HEADER_MAGIC_HEX = "44544c5a"
HEADER_VERSION = 1
HEADER_ESCAPES = 1
HEADER_BYTES = 56


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def byte_tokens(data: Column) -> Column:
    """array<int> of the bytes of a binary column, 0 to 255, one token each."""
    # Latin-1 has one character for each byte, with the byte's number
    each = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.ascii(c))
    return F.when(F.octet_length(data) > 0, each).otherwise(F.array().cast("array<int>"))


def codec_symbols(tokens: Column, missing: Column, vocabulary: int = 256) -> Column:
    """Tokens with those that the vocabulary can't emit as escapes: vocabulary + byte."""
    return F.transform(tokens, lambda t: F.when(F.array_contains(missing, t), t + vocabulary).otherwise(t))


def symbol_bytes(symbols: Column, vocabulary: int = 256) -> Column:
    """The binary that codec symbols stand for: the inverse of codec_symbols over byte tokens."""
    return F.unhex(F.array_join(F.transform(symbols, lambda s: F.lpad(F.hex(F.when(s >= vocabulary, s - vocabulary).otherwise(s)), 2, "0")), ""))


def digest_of_tokens(tokens: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal tokens joined by commas."""
    return F.sha2(F.array_join(tokens.cast("array<string>"), ","), 256)


def little_endian(value: Column, size: int) -> Column:
    """Lower-case hex of a non-negative integer in `size` bytes, lowest first."""
    big = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.lower(F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(size)))))


def from_little_endian(hexed: Column, at: int, size: int) -> Column:
    """The integer in bytes at .. at + size of a hex string (below 2**63)."""
    return F.conv(F.concat(*(F.substring(hexed, 2 * (at + i) + 1, 2) for i in reversed(range(size)))), 16, 10).cast("bigint")


def header_hex(model_sha256: Column, n_ctx: Column, overlap: Column, length: Column, escapes: Column) -> Column:
    """The header: magic, u16 version, u16 flags, 32-byte model digest, u32 window, u32 overlap, u64 length; null if it is invalid."""
    out = F.concat(F.lit(HEADER_MAGIC_HEX), little_endian(F.lit(HEADER_VERSION), 2), little_endian(F.when(escapes, HEADER_ESCAPES).otherwise(0), 2), F.lower(model_sha256), little_endian(n_ctx, 4), little_endian(overlap, 4), little_endian(length, 8))
    return F.when((n_ctx > 0) & (overlap >= 0) & (overlap < n_ctx) & (length >= 0) & (F.length(model_sha256) == 64), out)


def parse_header(hexed: Column) -> Column:
    """struct(escapes, model_sha256, n_ctx, overlap, orig_len) of a valid header, else null."""
    flags, n_ctx, overlap = from_little_endian(hexed, 6, 2), from_little_endian(hexed, 40, 4), from_little_endian(hexed, 44, 4)
    valid = (F.length(hexed) == 2 * HEADER_BYTES) & (F.substring(hexed, 1, 8) == HEADER_MAGIC_HEX) & (from_little_endian(hexed, 4, 2) == HEADER_VERSION) & (flags <= HEADER_ESCAPES) & (n_ctx > 0) & (overlap < n_ctx)
    return F.when(valid, F.struct((flags == HEADER_ESCAPES).alias("escapes"), F.substring(hexed, 17, 64).alias("model_sha256"), n_ctx.alias("n_ctx"), overlap.alias("overlap"), from_little_endian(hexed, 48, 8).alias("orig_len")))


def half_to_double(bits: Column) -> Column:
    """The value of 16 bits as an IEEE half float; null where it is not finite."""
    sign = F.when(bits.bitwiseAND(0x8000) > 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(0x3FF)
    value = F.when(exponent == 0, fraction * F.lit(2.0**-24)).otherwise((fraction + 1024) * F.pow(F.lit(2.0), exponent.cast("double") - 25))
    return F.when(exponent < 31, sign * value)
