"""Layers of a sequence model over tables of vectors: matrix products, attention over a window of the past."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.vectors import let


def centroids(vectors: DataFrame, label: str, values: str) -> DataFrame:
    """(label, weights): the mean vector of each label, the rows of a matrix; sums meet after partial aggregation."""
    cells = vectors.select(label, F.posexplode(values).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("w"))
    rows = cells.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("cells"))
    return rows.select(label, F.transform("cells", lambda c: c["w"]).alias("weights"))


#: Rows of a matrix that is broadcast to all vectors; a larger one goes in parts of about so many.
MATRIX_ROWS = 4096
#: Buckets of vectors that meet a part of a larger matrix in different tasks.
MATRIX_BUCKETS = 32


def matrix_product(vectors: DataFrame, matrix: DataFrame, key: str, values: str, row: str, weights: str) -> DataFrame:
    """(key, row, y): each vector's product with each matrix row, in DOUBLE, left to right.

    A matrix of at most MATRIX_ROWS rows is attached to each vector as one array. A larger one
    is dealt to parts by a hash of its row keys, and every vector meets every part.
    """
    n = matrix.count()
    parts = 1 if n <= MATRIX_ROWS else math.ceil(2 * n / MATRIX_ROWS)
    part = F.pmod(F.xxhash64(row), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    packed = matrix.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(weights).alias("w")))).alias("rows"))
    if parts == 1:
        joined = vectors.select(key, values, F.lit(0).alias("part")).join(F.broadcast(packed), "part")
    else:
        packed = packed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(MATRIX_BUCKETS - 1))))
        bucket = F.pmod(F.xxhash64(key, values), F.lit(MATRIX_BUCKETS)).cast("int").alias("bucket")
        joined = vectors.select(key, values, bucket, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(packed, ["part", "bucket"])
    out = joined.select(key, values, F.explode("rows").alias("m"))
    y = F.aggregate(F.zip_with(values, "m.w", lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)
    return out.select(key, F.col("m.r").alias(row), y.alias("y"))


#: Vectors of a sequence that one task sorts.
ATTENTION_ROWS = 4096


def causal_attention(vectors: DataFrame, key: str, sequence: str, values: str, n_ctx: int) -> DataFrame:
    """(key, pos, weights, output): softmax of scaled dots with the n_ctx last vectors of the sequence, itself included.

    Ranges of keys are cut into blocks of about ATTENTION_ROWS; a block's first rows see the
    last n_ctx - 1 rows of the blocks before it, which are copied to it. So a sequence of any
    length spreads over tasks, and no pair is joined. Keys of a sequence are distinct integers.
    """
    n = vectors.count()
    cuts = vectors.stat.approxQuantile(key, [i / 64 for i in range(1, 64)], 0.004) if n > ATTENTION_ROWS else []
    block = F.lit(0)
    for cut in sorted({*cuts}):
        block = block + (F.col(key) > F.lit(cut)).cast("int")
    placed = vectors.select(key, F.col(sequence).alias("_s"), F.col(values).alias("_v"), block.alias("_b"))
    own = Window.partitionBy("_s", "_b").orderBy(key)
    backwards = Window.partitionBy("_s", "_b").orderBy(F.col(key).desc())
    counts = placed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = placed.withColumn("_r", F.row_number().over(own)).join(offsets, ["_s", "_b"]).withColumn("pos", (F.col("_r") - 1 + F.col("_o")).cast("bigint"))
    # the last rows of a block go to the next blocks that need them, whichever those are
    last = numbered.withColumn("_e", F.row_number().over(backwards)).filter(F.col("_e") < n_ctx).select("_s", "_v", key, "pos")
    starts = offsets.select("_s", F.col("_b").alias("_to"), F.col("_o").alias("_from")).filter("_from > 0")
    copied = last.join(starts, "_s").filter((F.col("pos") < F.col("_from")) & (F.col("pos") >= F.col("_from") - (n_ctx - 1)))
    both = numbered.select("_s", "_b", key, "_v", "pos", F.lit(True).alias("_own")).union(copied.select("_s", F.col("_to").alias("_b"), key, "_v", "pos", F.lit(False).alias("_own")))
    frame = Window.partitionBy("_s", "_b").orderBy("pos").rowsBetween(-(n_ctx - 1), 0)
    framed = both.withColumn("past", F.collect_list("_v").over(frame)).filter("_own").select(key, F.col("_v").alias(values), "pos", "past")
    dot = lambda v: F.aggregate(F.zip_with(values, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    powers = lambda scores: let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    shares = lambda p: let(total(p), lambda m: F.transform(p, lambda x: x / m))
    # each step is computed once for a row, not once for each element of the output
    weights = let(let(F.transform("past", lambda v: dot(v) / F.sqrt(F.size(values).cast("double"))), powers), shares)
    output = lambda p: F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: total(F.zip_with(p, "past", lambda q, v: q * F.get(v, i).cast("double"))))
    both = let(weights, lambda p: F.struct(p.alias("weights"), output(p).alias("output")))
    return framed.select(key, "pos", both.alias("both")).select(key, "pos", "both.weights", "both.output")
