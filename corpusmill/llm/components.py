"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.scratch import discard, materialize


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with the m of least (u, m) where a = u.

    The second key makes Spark deal out the aggregate anew: only a join of two plain shuffles
    can have a hub's large partition split.
    """
    left, right = edges.withColumn("_k", F.xxhash64("a")), least.withColumn("_l", F.xxhash64("u"))
    return left.join(right, (F.col("a") == F.col("u")) & (F.col("_k") == F.col("_l")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return _beside(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _beside(down, least.withColumnRenamed("a", "u")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars about b already: each a stands in one row, and never as a b."""
    up, down = F.lit(1).alias("up"), F.lit(1).alias("down")
    ends = edges.select(F.col("a").alias("node"), up, F.lit(0).alias("down")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), down))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is connected to; roots themselves are left out.

    Edges stay in written tables between rounds. A hub with a third of all edges only meets
    aggregates with partial sums, and joins whose large partitions Spark splits. Rounds end when
    the edges are stars; their number is logarithmic in the nodes.
    """
    current = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(current):
        after = materialize(_small_star(_large_star(current).distinct()).distinct(), "stars")
        discard(current)
        current = after
    out = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._scratch_path = current._scratch_path  # noqa: SLF001
    return out
