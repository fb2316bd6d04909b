"""Comparing vectors: cosine and error metrics by row and in all, worst rows, largest differences, artifact digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_metrics(pairs: DataFrame, actual: str, expected: str, key: str) -> DataFrame:
    """(key, n, dot, aa, bb, sq, cosine, max_abs, rms) of two array columns, in DOUBLE, left to right. No shuffle."""

    def fold(f) -> Column:  # noqa: ANN001
        return F.aggregate(F.zip_with(actual, expected, lambda a, b: f(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, x: s + x)

    out = pairs.select(
        F.col(key), F.size(actual).cast("bigint").alias("n"), fold(lambda a, b: a * b).alias("dot"), fold(lambda a, b: a * a).alias("aa"), fold(lambda a, b: b * b).alias("bb"),
        fold(lambda a, b: (a - b) * (a - b)).alias("sq"), F.array_max(F.zip_with(actual, expected, lambda a, b: F.abs(a.cast("double") - b.cast("double")))).alias("max_abs"),
    )
    return out.withColumns({"cosine": cosine("dot", "aa", "bb"), "rms": F.sqrt(F.col("sq") / F.col("n"))})


def cosine(dot: str, aa: str, bb: str) -> Column:
    """1 for two zero vectors, 0 for one."""
    a, b = F.col(aa), F.col(bb)
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.col(dot) / (F.sqrt(a) * F.sqrt(b)))


def overall(metrics: DataFrame) -> DataFrame:
    """One row over all rows: n, cosine, max_abs, rms, and the smallest cosine of a row."""
    sums = metrics.agg(F.sum("n").alias("n"), F.sum("dot").alias("dot"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"), F.sum("sq").alias("sq"), F.max("max_abs").alias("max_abs"), F.min("cosine").alias("min_row_cosine"))
    return sums.select("n", cosine("dot", "aa", "bb").alias("cosine"), "max_abs", F.sqrt(F.col("sq") / F.col("n")).alias("rms"), "min_row_cosine")


def worst_rows(metrics: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of lowest cosine; ties by the larger error, then the smaller key."""
    return metrics.orderBy(F.col("cosine").asc(), F.col("max_abs").desc(), F.col(key).asc()).limit(k)


def top_differences(pairs: DataFrame, actual: str, expected: str, key: str, k: int) -> DataFrame:
    """(key, i, diff): the k elements that differ most; ties by key, then place."""
    each = F.transform(F.arrays_zip(F.col(actual).alias("a"), F.col(expected).alias("b")), lambda p, i: F.struct(i.alias("i"), F.abs(p["a"].cast("double") - p["b"].cast("double")).alias("diff")))
    return pairs.select(F.col(key), F.explode(each).alias("e")).select(key, F.col("e.i").cast("bigint").alias("i"), "e.diff").orderBy(F.col("diff").desc(), key, "i").limit(k)


def artifact_agreement(artifacts: DataFrame, label: str, digest: str) -> DataFrame:
    """(label, artifacts, distinct_digests, agree): whether all artifacts of a label have one digest."""
    counts = artifacts.groupBy(label, digest).agg(F.count(F.lit(1)).alias("n")).groupBy(label)
    out = counts.agg(F.sum("n").alias("artifacts"), F.count(F.lit(1)).alias("distinct_digests"))
    return out.withColumn("agree", F.col("distinct_digests") == 1)
