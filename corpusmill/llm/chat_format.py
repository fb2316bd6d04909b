"""Cumulative-snapshot collapse: keep the maximal conversations, then render them. DataFrame functions only.

Loggers often store a conversation again after every turn. A conversation whose turns are a
proper prefix of another's is dropped; of conversations with equal turns the one with the
smallest id stays.

Turns stand in the order of (turn, role, text), nulls first; rows that repeat in all of
(conv_id, turn, role, text) are one turn. Null roles render as 'unknown' and null texts as
empty, but are told apart from those. Rows with a null conversation id are one conversation.
Texts are rendered as they are: one that holds a mark of a role or an end is not escaped.
An empty table gives no rows. Extra columns are ignored.

All turns are sorted once by their whole key into ranges of about equal rows, so that no
conversation, turn number or null, whatever its share of the rows, is sorted by one task.
Positions and prefix hashes come from sums over ranges, then inside a range; only hashes and
numbers are shuffled for them, texts again when the chosen ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.scratch import discard, materialize

#: Turns to a rendered row: a longer conversation is rendered in several rows, whose texts concatenate.
SEGMENT_TURNS = 256
_PARTS = 4
_PREFIX = ["pos", *(f"p{i}" for i in range(_PARTS))]


def _said(role: Column, text: Column) -> Column:
    """The digest of a turn; lengths keep fields apart, a null is told from an empty text."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat_ws("|", part(role), part(text)), 256)


def number_turns(turns: DataFrame, id_col: str = "conv_id", ranges: int | None = None) -> DataFrame:
    """The distinct turns as a written table: conv, range, row (ascending in the order of all turns), role, text, digest.

    ranges: into how many ranges all turns are sorted; None leaves it to the session.
    """
    key = ["conv", "turn", "role", "text"]
    base = turns.select(F.col(id_col).alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    ordered = (base.repartitionByRange(ranges, *key) if ranges else base.repartitionByRange(*key)).sortWithinPartitions(*key)
    numbered = ordered.select("conv", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row"), "role", "text", _said(F.col("role"), F.col("text")).alias("digest"))
    return materialize(numbered, "turns")


def conversation_ranges(numbered: DataFrame) -> DataFrame:
    """By conversation and range: c, r, ahead (row + ahead is the position in the conversation, from 1) and n_turns."""
    counts = numbered.groupBy("conv", "range").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n"))
    conv = Window.partitionBy("conv")
    before = conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least") + 1
    return counts.select(F.col("conv").alias("c"), F.col("range").alias("r"), ahead.alias("ahead"), F.sum("n").over(conv).alias("n_turns"))


def _in_range() -> Column:
    return F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))


def rolling_prefixes(numbered: DataFrame, places: DataFrame) -> DataFrame:
    """One row per turn: conv, n_turns, pos (from 1) and p0..p3, the sums of the digests of turns 1..pos.

    Two conversations agree in (pos, p0..p3) if and, but for a 128-bit coincidence, only if
    their first pos turns are equal.
    """
    placed = numbered.select("conv", "range", "row", "digest").join(places, _in_range())
    placed = placed.select("conv", "range", "n_turns", (F.col("row") + F.col("ahead")).alias("pos"), "digest")
    mixed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit("|"), F.col("digest")), 256)
    hashed = placed.select("conv", "range", "n_turns", "pos", mixed.alias("h"))
    hashed = hashed.select("conv", "range", "n_turns", "pos", *(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(_PARTS)))
    running = Window.partitionBy("conv", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = materialize(hashed.select("conv", "range", "n_turns", "pos", *(F.sum(f"h{i}").over(running).alias(f"p{i}") for i in range(_PARTS))), "inside")
    # few conversations lie in several ranges: only those have something to add
    sums = inside.groupBy("conv", "range").agg(F.max(F.struct(*_PREFIX)).alias("last"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("conv").alias("c"), F.col("range").alias("r"), *(F.sum(f"last.p{i}").over(before).alias(f"o{i}") for i in range(_PARTS))).filter("o0 is not null")
    out = inside.join(earlier, _in_range(), "left")
    return out.select("conv", "n_turns", "pos", *((F.col(f"p{i}") + F.coalesce(f"o{i}", F.lit(0))).alias(f"p{i}") for i in range(_PARTS)))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv of the conversations that are no proper prefix of another and the first of their equals."""
    proper = prefixes.filter("pos < n_turns").select(*_PREFIX).distinct()
    # min() passes nulls by; a null id counts only where there is no other
    first = prefixes.filter("pos = n_turns").groupBy(*_PREFIX).agg(F.min("conv").alias("conv"))
    return first.join(proper, _PREFIX, "left_anti").select("conv")


def render(numbered: DataFrame, places: DataFrame, kept: DataFrame, segment_turns: int = SEGMENT_TURNS, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, segment, n_turns, text): each turn as '<|role|>\\ntext<|end|>\\n', in segments of so many turns."""
    chosen = places.join(kept, F.col("c").eqNullSafe(F.col("conv")), "left_semi")
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    turns = numbered.select("conv", "range", "row", said.alias("said")).join(chosen, _in_range())
    turns = turns.select("conv", "n_turns", (F.col("row") + F.col("ahead")).alias("pos"), "said")
    segment = F.floor((F.col("pos") - 1) / segment_turns)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "said")))
    out = turns.groupBy("conv", segment.alias("segment"), "n_turns").agg(F.array_join(F.transform(ordered, lambda t: t["said"]), "").alias("text"))
    return out.select(F.col("conv").alias(id_col), F.col("segment").cast("bigint").alias("segment"), F.col("n_turns").cast("bigint").alias("n_turns"), "text")


def collapse_and_render(turns: DataFrame, id_col: str = "conv_id", segment_turns: int = SEGMENT_TURNS, ranges: int | None = None) -> DataFrame:
    """The maximal conversations of a log of snapshots, rendered."""
    numbered = number_turns(turns, id_col, ranges)
    places = materialize(conversation_ranges(numbered), "places")
    prefixes = materialize(rolling_prefixes(numbered, places), "prefixes")
    kept = materialize(maximal_conversations(prefixes), "kept")
    discard(prefixes)
    return render(numbered, places, kept, segment_turns, id_col)


#: Equal turns by comparison of whole lists, with neither hashes nor ranges.
ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns,
        list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
      FROM t GROUP BY conv_id),
longer AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.n_turns < b.n_turns AND a.said[1] IS NOT DISTINCT FROM b.said[1] AND a.said = b.said[1:a.n_turns]),
kept AS (SELECT c.* FROM c ANTI JOIN longer USING (conv_id)
         QUALIFY row_number() OVER (PARTITION BY said ORDER BY conv_id) = 1)
SELECT conv_id, CAST(g AS BIGINT) AS segment, n_turns,
  array_to_string(list_transform(said[g * 256 + 1 : g * 256 + 256],
    lambda s: '<|' || coalesce(s.r, 'unknown') || '|>' || chr(10) || coalesce(s.x, '') || '<|end|>' || chr(10)), '') AS text
FROM kept, LATERAL (SELECT unnest(range((n_turns + 255) // 256)) AS g)
"""
