"""Queries over blocks of 4, 6 and 8 bits, FLOAT layers, symbol ranges and vocabularies, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import sql_functions as S
from corpusmill.functions import binary as B
from corpusmill.functions import blocks as K
from corpusmill.functions import vectors as V
from corpusmill.operators import codec, model, vocabulary
from corpusmill.plans.reference import _CDF_SQL, _Q8, N_CTX, OVERLAP, _cdf, _q8, query, table
from corpusmill.sources import dumps, gguf


def _digest_bytes(text: Column, mark: str, n: int) -> Column:
    """n bytes (array<int>) from digests of the text: stands in for the blocks of a weight file."""
    hexed = F.concat(*(F.sha2(F.concat(text, F.lit(f"{mark}{k}")), 256) for k in range(-(-n // 32))))
    return F.slice(B.byte_tokens(F.unhex(hexed)), 1, n)


def _digest_sql(mark: str, n: int) -> str:
    hexed = " || ".join(f"sha256(text || '{mark}{k}')" for k in range(-(-n // 32)))
    return f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: CAST('0x' || h AS INTEGER))[1:{n}]"


def _scale(step: float, m: int) -> Column:
    return (F.lit(step) * (F.col("item_id") % m + 1)).cast("float")


def _q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "benchmark").select("item_id", _digest_bytes(F.col("text"), "#", 140).alias("y"), _digest_bytes(F.col("text"), "@", 256).alias("a"))
    return y.select("item_id", "a", K.q4_k_values(_scale(2.0**-7, 7), _scale(2.0**-8, 5), F.slice("y", 1, 12), F.slice("y", 13, 128)).alias("v"))


def _q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "benchmark").select("item_id", _digest_bytes(F.col("text"), "#", 208).alias("y"), _digest_bytes(F.col("text"), "@", 256).alias("a"))
    return y.select("item_id", "a", _scale(2.0**-7, 7).alias("d"), K.signed_bytes(F.slice("y", 193, 16)).alias("scales"), K.q6_k_quants(F.slice("y", 1, 128), F.slice("y", 129, 64)).alias("q"))


_Q4_SQL = f"""
b AS (SELECT item_id, {_digest_sql('#', 140)} AS y, {_digest_sql('@', 256)} AS a, CAST(0.0078125 * (item_id % 7 + 1) AS FLOAT) AS d, CAST(0.00390625 * (item_id % 5 + 1) AS FLOAT) AS dmin FROM benchmark),
r AS (SELECT *, y[1:12] AS sc, y[13:140] AS qs, i // 32 AS k FROM b, LATERAL (SELECT unnest(range(256)) AS i)),
s AS (SELECT item_id, i, a[i + 1] - 128 AS act, d, dmin,
  CASE WHEN k < 4 THEN sc[k + 1] & 63 ELSE (sc[k + 5] & 15) | ((sc[k - 3] >> 6) << 4) END AS step,
  CASE WHEN k < 4 THEN sc[k + 5] & 63 ELSE (sc[k + 5] >> 4) | ((sc[k + 1] >> 6) << 4) END AS least,
  CASE WHEN k % 2 = 0 THEN qs[k // 2 * 32 + i % 32 + 1] & 15 ELSE qs[k // 2 * 32 + i % 32 + 1] >> 4 END AS q FROM r),
v AS (SELECT item_id, i, act, CAST(CAST(CAST(d * CAST(step AS FLOAT) AS FLOAT) * CAST(q AS FLOAT) AS FLOAT) - CAST(dmin * CAST(least AS FLOAT) AS FLOAT) AS FLOAT) AS v FROM s)
"""
_Q6_SQL = f"""
b AS (SELECT item_id, {_digest_sql('#', 208)} AS y, {_digest_sql('@', 256)} AS a, CAST(0.0078125 * (item_id % 7 + 1) AS FLOAT) AS d FROM benchmark),
r AS (SELECT *, i // 128 AS half, i % 128 // 32 AS part, i % 32 AS l FROM b, LATERAL (SELECT unnest(range(256)) AS i)),
s AS (SELECT item_id, i, d, a[i + 1] - 128 AS act, CASE WHEN y[193 + i // 16] > 127 THEN y[193 + i // 16] - 256 ELSE y[193 + i // 16] END AS sc,
  ((CASE WHEN part < 2 THEN y[half * 64 + l + 32 * (part % 2) + 1] & 15 ELSE y[half * 64 + l + 32 * (part % 2) + 1] >> 4 END)
   | (((y[129 + half * 32 + l] >> CAST(2 * part AS INTEGER)) & 3) << 4)) - 32 AS q FROM r),
v AS (SELECT item_id, i, act, sc, q, d, CAST(CAST(d * CAST(sc AS FLOAT) AS FLOAT) * CAST(q AS FLOAT) AS FLOAT) AS v FROM s)
"""
_VALUE_DOT_SQL = """, p AS (SELECT item_id, list(CAST(v * CAST(CAST(0.015625 * (i // 32 + 1) AS FLOAT) * CAST(act AS FLOAT) AS FLOAT) AS FLOAT) ORDER BY i) AS p FROM v GROUP BY item_id)
SELECT item_id, CAST(list_reduce(list_prepend(CAST(0 AS FLOAT), p), lambda s, x: CAST(s + x AS FLOAT)) AS DOUBLE) AS dot FROM p"""


def _activations(a: Column) -> tuple[Column, Column]:
    """(scales, quants) of eight blocks of 32 from 256 bytes."""
    k = F.sequence(F.lit(0), F.lit(7))
    return F.transform(k, lambda i: (F.lit(0.015625) * (i + 1)).cast("float")), F.transform(k, lambda i: F.transform(F.slice(a, i * 32 + 1, 32), lambda x: x - 128))


@query(f"WITH {_Q4_SQL} SELECT item_id, i, CAST(v AS DOUBLE) AS value FROM v")
def q4_k_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 4-bit blocks of 256 with eight scales and minima."""
    return _q4(spark, sf_dir).select("item_id", F.posexplode("v").alias("i", "v")).select("item_id", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("value"))


@query(f"WITH {_Q4_SQL} {_VALUE_DOT_SQL}")
def q4_k_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-bit blocks of 256 against 8-bit blocks of 32, added value by value in FLOAT."""
    return _q4(spark, sf_dir).select("item_id", K.value_dot(F.col("v"), *_activations(F.col("a"))).cast("double").alias("dot"))


@query(f"WITH {_Q6_SQL} SELECT item_id, i, CAST(v AS DOUBLE) AS value FROM v")
def q6_k_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 6-bit blocks of 256 with sixteen scales."""
    v = _q6(spark, sf_dir).select("item_id", K.q6_k_values(F.col("d"), F.col("scales"), F.col("q")).alias("v"))
    return v.select("item_id", F.posexplode("v").alias("i", "v")).select("item_id", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("value"))


@query(f"WITH {_Q6_SQL} {_VALUE_DOT_SQL}")
def q6_k_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6-bit blocks of 256 against 8-bit blocks of 32, added value by value in FLOAT."""
    q = _q6(spark, sf_dir).select("item_id", "a", K.q6_k_values(F.col("d"), F.col("scales"), F.col("q")).alias("v"))
    return q.select("item_id", K.value_dot(F.col("v"), *_activations(F.col("a"))).cast("double").alias("dot"))


@query(f"""WITH {_Q6_SQL}, l AS (SELECT item_id, i % 8 AS lane, CAST(CAST(any_value(d) * CAST(0.5 AS FLOAT) AS FLOAT) * CAST(sum(q * act * sc) AS FLOAT) AS FLOAT) AS x FROM v GROUP BY item_id, i % 8),
o AS (SELECT item_id, list(x ORDER BY lane) AS x FROM l GROUP BY item_id)
SELECT item_id, CAST(list_reduce(list_prepend(CAST(0 AS FLOAT), x), lambda s, y: CAST(s + y AS FLOAT)) AS DOUBLE) AS dot FROM o""")
def q6_k_q8_k_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6-bit against 8-bit blocks of 256: exact integer sums in eight lanes."""
    act = F.transform(F.col("a"), lambda x: x - 128)
    block = F.struct("d", "scales", F.col("q").alias("quants"), F.lit(0.5).cast("float").alias("a"), act.alias("q"))
    return _q6(spark, sf_dir).select("item_id", K.q6_k_q8_k_dot(F.array(block)).cast("double").alias("dot"))


_IN_ORDER = "CAST(list_reduce(list_prepend(CAST(0 AS FLOAT), list(x ORDER BY blk)), lambda s, y: CAST(s + y AS FLOAT)) AS DOUBLE)"
_BLOCKS = """, e AS (SELECT a.vec_id, a.blk, CAST(CAST({w} * b.d AS FLOAT) * CAST(list_sum(list_transform(list_zip({q}, b.q), lambda z: z[1] * z[2])) AS FLOAT) AS FLOAT) AS x FROM {a} a JOIN q b ON {on} AND a.blk = b.blk)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, scales, quants) of the embeddings in 8-bit blocks."""
    each = _q8(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("blk", "d", "q"))).alias("b"))
    return each.select("vec_id", F.transform("b", lambda b: b["d"]).alias("scales"), F.transform("b", lambda b: b["q"]).alias("quants"))


@query(f"WITH {_Q8} {_BLOCKS.format(w='a.d', q='a.q', a='q', on='a.vec_id + 1 = b.vec_id')} SELECT vec_id, {_IN_ORDER} AS dot FROM e GROUP BY vec_id")
def q8_block_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled dots of each vector with the next, both in 8-bit blocks, block after block in FLOAT."""
    b = _blocks(spark, sf_dir)
    after = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("scales").alias("s"), F.col("quants").alias("r"))
    return b.join(after, "vec_id").select("vec_id", K.block_dot(F.col("scales"), F.col("quants"), F.col("s"), F.col("r")).cast("double").alias("dot"))


@query(f"""WITH {_Q8}, h AS (SELECT vec_id, {_digest_sql('#', 32).replace('text', 'CAST(vec_id AS VARCHAR)')} AS y FROM embeddings),
w AS (SELECT vec_id, blk, list_concat(list_transform(y[blk * 16 + 1 : blk * 16 + 16], lambda b: (b & 15) - 8), list_transform(y[blk * 16 + 1 : blk * 16 + 16], lambda b: (b >> 4) - 8)) AS n FROM h, LATERAL (SELECT unnest([0, 1]) AS blk))
{_BLOCKS.format(w='CAST(0.25 AS FLOAT)', q='a.n', a='w', on='a.vec_id = b.vec_id')} SELECT vec_id, {_IN_ORDER} AS dot FROM e GROUP BY vec_id""")
def q4_block_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-bit blocks of 32 against the first two 8-bit blocks of each vector."""
    y = _digest_bytes(F.col("vec_id").cast("string"), "#", 32)
    weights = F.transform(F.array(F.lit(1), F.lit(17)), lambda at: K.q4_0_quants(F.slice(y, at, 16)))
    scale = F.array_repeat(F.lit(0.25).cast("float"), 2)
    b = _blocks(spark, sf_dir)
    return b.select("vec_id", K.block_dot(scale, weights, F.slice("scales", 1, 2), F.slice("quants", 1, 2)).cast("double").alias("dot"))


@query("""
WITH g AS (SELECT vec_id // 4 AS grp, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY vec_id // 4),
m AS (SELECT grp, x, list_reduce(list_prepend(CAST(0 AS FLOAT), x), lambda m, y: CASE WHEN abs(y) > abs(m) THEN y ELSE m END) AS top FROM g WHERE len(x) = 256),
s AS (SELECT grp, x, top, CAST(CAST(-127 AS FLOAT) / top AS FLOAT) AS inv FROM m),
q AS (SELECT grp, CASE WHEN top = 0 THEN 0 ELSE CAST(CAST(1 AS FLOAT) / inv AS DOUBLE) END AS d, list_transform(x, lambda y: CASE WHEN top = 0 THEN 0 ELSE least(127, CAST(round_even(CAST(CAST(inv * y AS FLOAT) AS DOUBLE), 0) AS INTEGER)) END) AS q FROM s)
SELECT grp, d, array_to_string(q, ',') AS q, array_to_string(list_transform(range(16), lambda k: CAST(list_sum(q[k * 16 + 1 : k * 16 + 16]) AS INTEGER)), ',') AS bsums FROM q
""")
def q8_k_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embeddings to a block of 256 values in 8 bits, with sums of sixteen."""
    g = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    whole = g.select("grp", F.flatten(F.transform("e", lambda r: r["embedding"])).alias("x")).filter(F.size("x") == K.SUPER)
    out = whole.select("grp", K.q8_k(F.col("x")).alias("b"))
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("grp", F.col("b.d").cast("double").alias("d"), said("b.q").alias("q"), said("b.bsums").alias("bsums"))


@query("SELECT k, CAST(CASE WHEN k % 8 IN (4, -4) THEN 2 * round(k / 16.0) ELSE round(k / 8.0) END AS BIGINT) AS even FROM range(-80, 81) r(k)")
def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths rounded to the nearest integer, halves to the even one."""
    return spark.range(-80, 81).select(F.col("id").alias("k"), K.half_even(F.col("id") / 8).alias("even"))


def _ramp(size: Column, first: float) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.lit(first) + i / 64).cast("float"))


@query("""
WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y, list_transform(range(len(a.embedding)), lambda i: CAST(i / 64.0 AS FLOAT)) AS bias FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)
SELECT vec_id, i, CAST(CAST(CAST(x[i + 1] + y[i + 1] AS FLOAT) + bias[i + 1] AS FLOAT) AS DOUBLE) AS z FROM p, LATERAL (SELECT unnest(range(len(x))) AS i)
""")
def residual_and_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector plus the next, plus a bias, in FLOAT."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    z = V.add_floats(V.add_floats(F.col("embedding"), F.col("y")), _ramp(F.size("embedding"), 0.0))
    return both.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("z").cast("double").alias("z"))


@query("""
WITH l AS (SELECT vec_id, embedding AS e, list_transform(range(0, 8), lambda k: list_reduce(list_prepend(CAST(0 AS FLOAT), list_transform(range(CAST(k AS BIGINT), len(embedding), 8), lambda i: embedding[i + 1] * embedding[i + 1])), lambda a, x: CAST(a + x AS FLOAT))) AS L FROM embeddings),
s AS (SELECT vec_id, e, CAST(CAST(CAST(L[1] + L[2] AS FLOAT) + CAST(L[3] + L[4] AS FLOAT) AS FLOAT) + CAST(CAST(L[5] + L[6] AS FLOAT) + CAST(L[7] + L[8] AS FLOAT) AS FLOAT) AS FLOAT) AS ss FROM l),
r AS (SELECT vec_id, e, CAST(CAST(1 AS FLOAT) / CAST(sqrt(CAST(CAST(CAST(ss / CAST(len(e) AS FLOAT) AS FLOAT) + CAST(0.00001 AS FLOAT) AS FLOAT) AS DOUBLE)) AS FLOAT) AS FLOAT) AS r FROM s)
SELECT vec_id, i, CAST(CAST(CAST(e[i + 1] * r AS FLOAT) * CAST(1 + i / 64.0 AS FLOAT) AS FLOAT) AS DOUBLE) AS y FROM r, LATERAL (SELECT unnest(range(len(e))) AS i)
""")
def rms_norm_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings over their root mean square times weights, every step in FLOAT."""
    y = V.rms_norm_float(F.col("embedding"), _ramp(F.size("embedding"), 1.0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(y).alias("i", "y"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("y").cast("double").alias("y"))


ROTATED = 32


@query(f"""
WITH p AS (SELECT vec_id, embedding AS e, vec_id % 16 AS pos, i, i % {ROTATED // 2} AS j FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)),
a AS (SELECT *, pos * pow(10000.0, -2.0 * j / {ROTATED}) AS t, CAST(e[j + 1] AS DOUBLE) AS lo, CAST(e[j + 1 + {ROTATED // 2}] AS DOUBLE) AS hi FROM p)
SELECT vec_id, i, round(CASE WHEN i >= {ROTATED} THEN CAST(e[i + 1] AS DOUBLE) WHEN i < {ROTATED // 2} THEN lo * cos(t) - hi * sin(t) ELSE lo * sin(t) + hi * cos(t) END, 6) + 0.0 AS y FROM a
""")
def rotary_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the dimensions turned, each with the one half a turn away; the rest stays."""
    turned = V.rotate_halves(F.col("embedding"), F.col("vec_id") % 16, ROTATED)
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(turned).alias("i", "y"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query("""
WITH m AS (SELECT vec_id, embedding AS e, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings),
w AS (SELECT vec_id, list_transform(e, lambda x: exp(greatest(CAST(x AS DOUBLE) - top, -88.0))) AS w FROM m),
f AS (SELECT vec_id, list_transform(w, lambda x: 1 + CAST(floor(x / list_sum(w) * 16777216) AS BIGINT)) AS f FROM w),
s AS (SELECT vec_id, f, unnest([vec_id % len(f), len(f) + vec_id % 256]) AS symbol FROM f)
SELECT vec_id, symbol, CASE WHEN symbol < len(f) THEN CAST(coalesce(list_sum(f[1:symbol]), 0) AS BIGINT) ELSE CAST(list_sum(f) AS BIGINT) + symbol - len(f) END AS cum,
  CASE WHEN symbol < len(f) THEN f[symbol + 1] ELSE 1 END AS freq, CAST(list_sum(f) AS BIGINT) + 256 AS total FROM s
""")
def symbol_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is coded for a token and for a byte escape, from logits with 256 escapes after the vocabulary."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", V.softmax_frequencies(F.col("embedding")).alias("f"))
    each = f.select("vec_id", "f", F.explode(F.array(F.col("vec_id") % F.size("f"), F.size("f") + F.col("vec_id") % 256)).alias("symbol"))
    out = each.select("vec_id", "symbol", model.symbol_range(F.col("f"), F.col("symbol"), True).alias("r"))
    return out.filter(model.range_is_valid(F.col("r"))).select("vec_id", "symbol", "r.cum", "r.freq", "r.total")


@query("SELECT vec_id, vec_id % 320 AS symbol, vec_id % 320 AS cum, CAST(1 AS BIGINT) AS freq, CAST(320 AS BIGINT) AS total FROM embeddings")
def uniform_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is coded before there is a context: 64 tokens and 256 escapes alike."""
    symbol = F.col("vec_id") % 320
    out = table(spark, sf_dir, "embeddings").select("vec_id", symbol.alias("symbol"), model.uniform_range(symbol, F.lit(64), True).alias("r"))
    return out.select("vec_id", "symbol", "r.cum", "r.freq", "r.total")


@query(f"WITH {_CDF_SQL}, n AS (SELECT prev, count(*) AS symbols FROM cdf GROUP BY prev) SELECT prev, symbols, CASE (prev + 1) % 5 WHEN 0 THEN 0 WHEN 1 THEN symbols WHEN 2 THEN symbols WHEN 3 THEN symbols ELSE 1 END AS violations FROM n")
def cdf_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged rows of the byte model are found: a first frequency of 0, shifted sums, too large a total, a last range beyond it."""
    kind = (F.col("prev") + 1) % 5
    ends = _cdf(spark, sf_dir)
    edges = ends.groupBy("prev").agg(F.min("byte").alias("first"), F.max("byte").alias("last"))
    damaged = ends.join(F.broadcast(edges), "prev").withColumns({
        "freq": F.when((kind == 1) & (F.col("byte") == F.col("first")), 0).when((kind == 4) & (F.col("byte") == F.col("last")), F.col("total") + 1).otherwise(F.col("freq")),
        "cum": F.when(kind == 2, F.col("cum") + 1).otherwise(F.col("cum")),
        "total": F.when(kind == 3, F.lit(1 << 31)).otherwise(F.col("total")),
    })
    return model.cdf_violations(damaged).withColumn("prev", F.col("prev").cast("bigint"))


#: A small vocabulary after the 256 bytes: (piece, score, type); pieces in all the notations that are read.
PIECES = [("th", -1.0, 1), ("the", -2.0, 1), ("▁the", -3.0, 1), ("▁", -9.0, 1), ("er", -1.5, 1), ("in", -1.5, 1), ("ing", -2.5, 1), ("Ġin", -4.0, 1), ("on", -1.0, 1), ("and", -2.0, 4), ("▁and", -2.0, 1), ("en", -1.0, 1), ("que", -2.0, 1), ("ent", -3.0, 1), ("<s>", 0.0, 3), ("ion", -2.0, 1), ("tion", -2.0, 1), ("re", -1.0, 1), ("▁de", -1.0, 1), ("ein", -1.0, 1)]
MERGES = ["t h", "i n", "e r", "o n", "e n", "in g", "th e", "i on", "t ion", "r e", "en t", "a nd", "q ue"]


def small_vocabulary(spark: SparkSession, escaped: bool = True) -> DataFrame:
    """(id, piece, score, token_type): bytes as <0xNN> (or as the characters that show them), then PIECES."""
    shown = {b: c for c, b in vocabulary._shown().items()}  # noqa: SLF001
    rows = [(b, f"<0x{b:02X}>" if escaped else shown[b], 0.0, 6) for b in range(256)]
    return spark.createDataFrame(rows + [(256 + i, *p) for i, p in enumerate(PIECES)], "id int, piece string, score double, token_type int")


def _piece_sql() -> str:
    space = lambda p: p.replace("▁", " ").replace("Ġ", " ")
    return ", ".join(f"({256 + i}, '{space(p).encode().hex().upper()}')" for i, (p, _, t) in enumerate(PIECES) if t != 3 and len(p) > 1)


@query(f"SELECT id, CASE WHEN id < 256 THEN printf('%02X', id) ELSE h END AS bytes, id <> 270 AS emittable FROM range(256) r(id) LEFT JOIN (VALUES {_piece_sql()}) p(pid, h) ON id = pid UNION ALL SELECT id, h, id <> 270 FROM (VALUES {_piece_sql()}, (259, '20'), (270, '3C733E')) p(id, h)")
def vocabulary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that a vocabulary's pieces stand for, and which may be emitted."""
    return vocabulary.read_vocabulary(small_vocabulary(spark)).select(F.col("id").cast("bigint").alias("id"), F.hex("bytes").alias("bytes"), "emittable")


@query("SELECT CAST(256 AS BIGINT) AS covered, '' AS missing")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single bytes that a vocabulary can emit."""
    return vocabulary.byte_coverage(vocabulary.read_vocabulary(small_vocabulary(spark)))


@query(f"""
WITH RECURSIVE v(id, h) AS (VALUES {_piece_sql()}),
t AS (SELECT item_id, hex(encode(text)) AS x FROM benchmark),
s AS (SELECT item_id, x, 1 AS pos, CAST([] AS INTEGER[]) AS ids FROM t
  UNION ALL
  SELECT s.item_id, x, s.pos + coalesce(m.n, 2), list_append(s.ids, coalesce(m.id, CAST('0x' || substr(x, s.pos, 2) AS INTEGER)))
  FROM s LEFT JOIN LATERAL (SELECT id, length(h) AS n FROM v WHERE substr(s.x, s.pos, length(h)) = h ORDER BY length(h) DESC, id LIMIT 1) m ON true WHERE s.pos <= length(x))
SELECT item_id, CAST(len(ids) AS BIGINT) AS n_tokens, sha256(array_to_string(ids, ',')) AS digest FROM s WHERE pos > length(x)
""")
def piece_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the longest pieces of a vocabulary, bytes where none fits."""
    out = vocabulary.tokenize_by_longest(table(spark, sf_dir, "benchmark"), vocabulary.read_vocabulary(small_vocabulary(spark)), ["item_id"])
    return out.select("item_id", F.size("tokens").cast("bigint").alias("n_tokens"), B.digest_of_tokens(F.col("tokens")).alias("digest"))


@query()
def merge_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by merges of adjacent tokens, lowest rank first; and whether the tokens' bytes are the text."""
    pieces = vocabulary.read_vocabulary(small_vocabulary(spark, escaped=False))
    merges = vocabulary.parse_merges(spark.createDataFrame([*enumerate(MERGES)], "rank int, merge string"))
    texts = table(spark, sf_dir, "benchmark")
    out = vocabulary.tokenize_by_merges(texts, pieces, merges, ["item_id"])
    back = vocabulary.detokenize(out, pieces, ["item_id"])
    joined = out.join(back, "item_id").join(texts, "item_id")
    return joined.select("item_id", F.size("tokens").cast("bigint").alias("n_tokens"), B.digest_of_tokens(F.col("tokens")).alias("digest"), (F.col("data") == F.col("text").cast("binary")).alias("same"))


@query("SELECT doc_id, lang, octet_length(encode(text)) AS orig_len, sha256(text) AS digest FROM documents WHERE lang IS NOT NULL")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as header and payload in one value; read back by the model that the header names, and decoded."""
    documents = table(spark, sf_dir, "documents").filter("lang is not null")
    cells = codec.model_table(_cdf(spark, sf_dir))
    packed = codec.compress(documents, cells, keep=("lang",))
    header = B.header_hex(F.sha2("lang", 256), F.lit(N_CTX), F.lit(OVERLAP), F.col("n_bytes"), F.lit(True))
    stored = packed.select("doc_id", F.concat(F.unhex(header), F.col("payload")).alias("container"))
    models = documents.select("lang").distinct().select("lang", F.sha2("lang", 256).alias("model_sha256"))
    opened = stored.select("doc_id", B.parse_header(F.lower(F.hex(F.substring("container", 1, B.HEADER_BYTES)))).alias("h"), F.substring("container", B.HEADER_BYTES + 1, 1 << 30).alias("payload"))
    named = opened.select("doc_id", "h.model_sha256", F.col("h.orig_len").alias("n_bytes"), "payload").join(F.broadcast(models), "model_sha256")
    back = codec.decompress(named, cells, keep=("lang", "n_bytes"))
    return back.select("doc_id", "lang", F.col("n_bytes").alias("orig_len"), F.sha2("text", 256).alias("digest"))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the embeddings as container files of at most 64 vectors, each with one FLOAT tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for part, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.array([v["embedding"] for v in vectors], "<f4")
                contents.append(gguf.encode([("general.architecture", 8, "rows"), ("rows.part", 4, part)], [("vectors", [values.shape[1], len(values)], 0, values.tobytes())]))
            yield pa.RecordBatch.from_arrays([pa.array([str(p) for p in batch.column(0).to_pylist()]), pa.array(contents, pa.binary())], ["path", "content"])

    part = F.floor(F.col("vec_id") / 64).alias("part")
    parts = table(spark, sf_dir, "embeddings").groupBy(part).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    return parts.mapInArrow(run, "path string, content binary")


@query("SELECT CAST(vec_id // 64 AS VARCHAR) AS path, vec_id % 64 AS \"row\", i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)")
def container_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor rows read back from container files, by the tensor's name."""
    rows = gguf.rows_of(_containers(spark, sf_dir), ["vectors"])
    return rows.select("path", "row", F.posexplode("values").alias("i", "x")).select("path", "row", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


@query("SELECT CAST(vec_id // 64 AS VARCHAR) AS path, 'vectors' AS name, 'F32' AS type, CAST(sum(len(embedding)) * 4 AS BIGINT) AS nbytes, vec_id // 64 AS part FROM embeddings GROUP BY vec_id // 64")
def container_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory and metadata of container files."""
    stored = _containers(spark, sf_dir)
    keys = gguf.metadata_of(stored).filter("key = 'rows.part'").select("path", F.col("integer").alias("part"))
    return gguf.tensors_of(stored).join(keys, "path").select("path", "name", "type", "nbytes", "part")


@query()
def logits_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each vector's little-endian FLOATs."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(dumps.float_dump(V.require_finite(F.col("embedding"))), 256).alias("digest"))


@query(f"SELECT doc_id, octet_length(encode(text)) AS n_bytes, greatest(0, CAST(floor((n_chars - {OVERLAP}) / {N_CTX - OVERLAP}.0) AS BIGINT)) AS win, round(n_chars / 1000.0 / (1 + exp(-n_chars / 1000.0)), 6) AS gate FROM documents")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that are registered for SQL, called from SQL."""
    S.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("corpusmill_documents")
    return spark.sql(f"SELECT doc_id, CAST(size(byte_tokens(text)) AS BIGINT) AS n_bytes, window_id(n_chars, {N_CTX}, {OVERLAP}) AS win, round(silu(n_chars / 1000.0D), 6) AS gate FROM corpusmill_documents")
