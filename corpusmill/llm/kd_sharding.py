"""K-d tree sharding by bytes. DataFrame functions only.

Each node is cut at the weighted median (weights: bytes) of its widest metadata dimension.
Medians are found by counting: every pass sums bytes by (node, bin) over all rows in one
aggregate, and the bin that holds the median is divided again. The driver only sees
nodes x BINS sums. Ties in the dimension are cut by the text's checksum, then by the id, so
a value, source or text that holds a third of all bytes is divided like any other, and a
group of equal texts is divided only where the cut falls into it.

Null text has size 1 (no bytes plus one) and the checksum of the empty text. Null metadata
is a value of its own. Rows that repeat an id are placed on one side together where the
whole key ties. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.scratch import materialize

BINS = 2048
#: A cut may leave this part of a node's bytes unresolved when the bin is not a single value.
TOLERANCE = 1 / 4096
SLOT_ROWS = 50_000


@dataclass
class Node:
    """rows and bytes of an inner node or leaf; cut: the upper bounds (dimension, checksum, id) of the left side."""

    leaves: int
    first: int
    dim: int = 0
    cut: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


def metadata(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc, size, crc and the dimensions d0 (size), d1.. (checksums of the categories, -1 for null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint") + 1
    crcs = [F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(-1)).cast("bigint").alias(f"d{i}") for i, c in enumerate(category_cols, 1)]
    return documents.select(F.col(id_col).cast("bigint").alias("doc"), size.alias("size"), F.crc32(text).alias("crc"), size.alias("d0"), *crcs, F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("tie"))


def _node_of(nodes: list[Node], tree: Node) -> Column:
    """The index in `nodes` of each row's node, as nested conditions over the tree above."""
    index = {id(n): i for i, n in enumerate(nodes)}

    def walk(n: Node) -> Column:
        if id(n) in index or n.left is None:
            return F.lit(index.get(id(n), -1))
        return F.when(_goes_left(n), walk(n.left)).otherwise(walk(n.right))

    return walk(tree)


def _goes_left(n: Node) -> Column:
    keys = [F.col(f"d{n.dim}"), F.col("crc"), F.col("tie")][: len(n.cut)]
    out = F.lit(True)
    for key, bound in reversed(list(zip(keys, n.cut, strict=True))):
        out = (key < bound) | ((key == bound) & out)
    return out


def _choose(values: list[int], n: int) -> Column:
    """values[node] as a column."""
    out = F.lit(values[-1])
    for i in range(n - 1):
        out = F.when(F.col("node") == i, F.lit(values[i])).otherwise(out)
    return out


def _cut_level(table: DataFrame, tree: Node, nodes: list[Node], dims: int, spans: list[int]) -> None:
    """Give each of the nodes a dimension and a cut."""
    here = table.withColumn("node", _node_of(nodes, tree)).filter("node >= 0")
    keys = [f"d{i}" for i in range(dims)] + ["crc", "tie"]
    stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(k).alias(f"{w}_{k}") for k in keys for w, f in (("lo", F.min), ("hi", F.max)))).collect()}
    goal, live = {}, []
    for i, n in enumerate(nodes):
        if (s := stats.get(i)) is None:
            n.cut = [0]
            continue
        n.dim = max(range(dims), key=lambda d: ((s[f"hi_d{d}"] - s[f"lo_d{d}"]) / spans[d], -d))
        goal[i] = s["bytes"] * (n.leaves // 2) / n.leaves
        live.append(i)
    # by node: the key in question (0: dimension, 1: checksum, 2: id), its range, bytes below the range
    state = {i: {"k": 0, "lo": stats[i][f"lo_d{nodes[i].dim}"], "hi": stats[i][f"hi_d{nodes[i].dim}"], "below": 0, "fixed": []} for i in live}
    while live:
        n = len(nodes)
        of = lambda f: [f(i) if i in live else 0 for i in range(n)]
        names = of(lambda i: [f"d{nodes[i].dim}", "crc", "tie"][state[i]["k"]])
        value = F.lit(0).cast("bigint")
        for i in live:
            value = F.when(F.col("node") == i, F.col(names[i])).otherwise(value)
        keep = F.lit(False)
        for i in live:
            s, fixed = state[i], [F.col(f"d{nodes[i].dim}"), F.col("crc")]
            row = (F.col("node") == i) & F.col(names[i]).between(s["lo"], s["hi"])
            for c, v in zip(fixed, s["fixed"], strict=False):
                row &= c == v
            keep |= row
        width = of(lambda i: max(1, -(-(state[i]["hi"] - state[i]["lo"] + 1) // BINS)))
        bins = F.floor((value - _choose(of(lambda i: state[i]["lo"]), n)) / _choose([w or 1 for w in width], n))
        sums = here.filter(keep).groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(value).alias("least"), F.max(value).alias("most")).collect()
        per: dict[int, list] = {}
        for r in sums:
            per.setdefault(r["node"], []).append(r)
        for i in [*live]:
            s, total = state[i], stats[i]["bytes"]
            below, before = s["below"], None
            for r in sorted(per[i], key=lambda r: r["bin"]):
                if below + r["bytes"] >= goal[i]:
                    break
                below, before = below + r["bytes"], r
            single = r["least"] == r["most"]
            small = r["bytes"] <= total * TOLERANCE or r["rows"] == 1
            if small or (single and s["k"] == 2):
                # end before this bin or after it, whichever is nearer to the goal
                after = goal[i] - below > below + r["bytes"] - goal[i]
                bound = r["most"] if after else before["most"] if before is not None else r["least"] - 1
                nodes[i].cut = [*s["fixed"], bound]
                live.remove(i)
            elif single:
                s["fixed"].append(r["least"])
                s |= {"k": s["k"] + 1, "below": below}
                name = ["", "crc", "tie"][s["k"]]
                s |= {"lo": stats[i][f"lo_{name}"], "hi": stats[i][f"hi_{name}"]}
            else:
                s |= {"lo": r["least"], "hi": r["most"], "below": below}


def build_tree(table: DataFrame, leaves: int, dims: int) -> Node:
    """A tree of so many leaves; each level is cut by passes over the whole table, for all its nodes at once."""
    tree = Node(leaves, 0)
    ends = table.agg(*(f(f"d{i}").alias(f"{w}{i}") for i in range(dims) for w, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = [max(1, (ends[f"hi{i}"] or 0) - (ends[f"lo{i}"] or 0)) for i in range(dims)]
    level = [tree]
    while level := [n for n in level if n.leaves > 1]:
        _cut_level(table, tree, level, dims, spans)
        for n in level:
            n.left = Node(n.leaves // 2, n.first)
            n.right = Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)
        level = [x for n in level for x in (n.left, n.right)]
    return tree


def shard_by_bytes(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: leaves of the tree are the shards, slots are gapless from 0 in each.

    Give the number of shards, or the bytes that a leaf should have.
    """
    table = materialize(metadata(documents, id_col, text_col, category_cols), "kd")
    total = table.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    leaves = shards or max(1, math.ceil((total["b"] or 0) / target_bytes))
    tree = build_tree(table, leaves, 1 + len(category_cols))

    def leaf(n: Node) -> Column:
        return F.lit(n.first) if n.left is None else F.when(_goes_left(n), leaf(n.left)).otherwise(leaf(n.right))

    # slots: rank within pieces of a shard that stay small at any size, plus the rows of the pieces before
    pieces = max(1, math.ceil(total["n"] / leaves / SLOT_ROWS))
    placed = table.select("doc", "size", "crc", leaf(tree).cast("int").alias("shard"), F.pmod(F.xxhash64("doc", "crc"), F.lit(pieces)).alias("piece"))
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc", "crc", "size")
    ranked = placed.withColumn("at", F.row_number().over(inside)).join(offsets, ["shard", "piece"])
    return ranked.select(F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - 1 + F.col("offset")).cast("bigint").alias("slot"))
