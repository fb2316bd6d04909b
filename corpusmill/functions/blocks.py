"""Blocks of 4, 6 and 8 bits as Column expressions: values, exact integer parts and dots in a fixed FLOAT order.

Bytes of a block are array<int> from 0 to 255 (functions.binary.byte_tokens), scales FLOAT.
Blocks of 256 values have eight (4 bits) or sixteen (6 bits) scales of their own. Layouts are
those of the container format that sources.gguf reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.vectors import as_float, let

Q8, Q4, SUPER = 32, 32, 256


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index.cast("int"))


def half_even(x: Column) -> Column:
    """The nearest integer, ties to the even one."""
    return F.rint(x.cast("double")).cast("bigint")


def ordered_sum(values: Column) -> Column:
    """Sum of FLOATs from left to right, each step rounded to FLOAT."""
    return F.aggregate(values, F.lit(0.0).cast("float"), lambda s, x: as_float(s + x))


def signed_bytes(unsigned: Column) -> Column:
    """array<int> of bytes from 0 to 255 as -128 .. 127."""
    return F.transform(unsigned, lambda b: F.when(b > 127, b - 256).otherwise(b))


def q4_0_quants(qs: Column) -> Column:
    """32 integers from -8 to 7 of 16 bytes: low halves first, then high ones."""
    return F.concat(F.transform(qs, lambda b: b.bitwiseAND(15) - 8), F.transform(qs, lambda b: F.shiftright(b, 4) - 8))


def block_dot(weight_scales: Column, weight_quants: Column, scales: Column, quants: Column) -> Column:
    """Blocks of 32 against blocks of 32: exact integer sums, each times (weight scale * scale), added from left to right.

    weight_scales, scales: array<float>; weight_quants, quants: array<array<int>>. 8- and 4-bit weights alike.
    """
    sums = F.zip_with(weight_quants, quants, lambda w, q: F.aggregate(F.zip_with(w, q, lambda a, b: a * b), F.lit(0), lambda s, x: s + x))
    return ordered_sum(F.zip_with(F.zip_with(weight_scales, scales, lambda a, b: as_float(a * b)), sums, lambda d, s: as_float(d * s.cast("float"))))


def q4_k_scales(packed: Column) -> Column:
    """array<struct<scale, least>> of the eight parts, from 12 bytes of 6-bit numbers."""

    def one(i: Column) -> Column:
        low, high = _at(packed, i), _at(packed, i + 4)
        before = _at(packed, F.greatest(i - 4, F.lit(0)))
        scale = F.when(i < 4, low.bitwiseAND(63)).otherwise(high.bitwiseAND(15).bitwiseOR(F.shiftleft(F.shiftright(before, 6), 4)))
        least = F.when(i < 4, high.bitwiseAND(63)).otherwise(F.shiftright(high, 4).bitwiseOR(F.shiftleft(F.shiftright(low, 6), 4)))
        return F.struct(scale.alias("scale"), least.alias("least"))

    return F.transform(F.sequence(F.lit(0), F.lit(7)), one)


def q4_k_values(d: Column, dmin: Column, packed: Column, qs: Column) -> Column:
    """256 FLOATs: (d * scale) * quant - (dmin * least)."""

    def part(s: Column, k: Column) -> Column:
        step, least = as_float(d * s["scale"].cast("float")), as_float(dmin * s["least"].cast("float"))
        own = F.slice(qs, F.floor(k / 2).cast("int") * 32 + 1, 32)
        return F.transform(own, lambda b: as_float(as_float(step * F.when(k % 2 == 0, b.bitwiseAND(15)).otherwise(F.shiftright(b, 4)).cast("float")) - least))

    return F.flatten(F.transform(q4_k_scales(packed), part))


def q6_k_quants(ql: Column, qh: Column) -> Column:
    """256 integers from -32 to 31: four low bits of 128 bytes, two high ones of 64."""

    def one(i: Column) -> Column:
        half, within = F.floor(i / 128), i % 128
        part, place = F.floor(within / 32), within % 32
        low = _at(ql, half * 64 + place + 32 * (part % 2))
        low = F.when(part < 2, low.bitwiseAND(15)).otherwise(F.shiftright(low, 4))
        high = _at(qh, half * 32 + place)
        high = F.when(part == 0, high).when(part == 1, F.shiftright(high, 2)).when(part == 2, F.shiftright(high, 4)).otherwise(F.shiftright(high, 6)).bitwiseAND(3)
        return low.bitwiseOR(F.shiftleft(high, 4)) - 32

    return F.transform(F.sequence(F.lit(0), F.lit(255)), one)


def q6_k_values(d: Column, scales: Column, quants: Column) -> Column:
    """256 FLOATs: (d * scale of their 16) * quant."""
    return F.transform(quants, lambda q, i: as_float(as_float(d * _at(scales, F.floor(i / 16)).cast("float")) * q.cast("float")))


def value_dot(values: Column, scales: Column, quants: Column) -> Column:
    """FLOAT weights against 8-bit blocks of 32: value * (scale * quant), added from left to right."""
    activations = F.flatten(F.zip_with(scales, quants, lambda d, q: F.transform(q, lambda x: as_float(d * x.cast("float")))))
    return ordered_sum(F.zip_with(values, activations, lambda w, a: as_float(w * a)))


def q8_k(values: Column) -> Column:
    """struct<d, q, bsums> of 256 FLOATs: the first of the largest magnitude becomes -127, ties go to even, at most 127.

    bsums: exact sums of sixteen. All zeros give d = 0.
    """
    zero = F.lit(0.0).cast("float")
    first = F.aggregate(values, zero, lambda m, x: F.when(F.abs(x) > F.abs(m), x).otherwise(m))

    def scaled(top: Column) -> Column:
        inverse = as_float(F.lit(-127.0).cast("float") / top)
        q = F.transform(values, lambda x: F.when(top == zero, F.lit(0)).otherwise(F.least(F.lit(127), half_even(as_float(inverse * x)).cast("int"))))
        return F.struct(F.when(top == zero, zero).otherwise(as_float(F.lit(1.0).cast("float") / inverse)).alias("d"), q.alias("q"))

    sums = lambda s: F.struct(s["d"].alias("d"), s["q"].alias("q"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.slice(s["q"], k * 16 + 1, 16), F.lit(0), lambda a, x: a + x)).alias("bsums"))
    return let(let(first, scaled), sums)


def q6_k_q8_k_dot(blocks: Column) -> Column:
    """Sum over array<struct<d, scales, quants, a (scale), q>>: integer sums in eight lanes by place, lanes added from left to right."""

    def lanes(b: Column) -> Column:
        parts = F.transform(b["quants"], lambda w, i: w * _at(b["q"], i) * _at(b["scales"], F.floor(i / 16)))
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(F.filter(parts, lambda x, i: i % 8 == k), F.lit(0), lambda s, x: s + x))

    start = F.array_repeat(F.lit(0.0).cast("float"), 8)
    step = lambda b: let(as_float(b["d"] * b["a"]), lambda d: F.transform(lanes(b), lambda n: as_float(d * n.cast("float"))))
    return ordered_sum(F.aggregate(blocks, start, lambda s, b: F.zip_with(s, step(b), lambda x, y: as_float(x + y))))
