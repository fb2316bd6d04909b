"""Queries over the tables of a data folder, each over whole tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import binary as B
from corpusmill.functions import vectors as V
from corpusmill.operators import codec, compare, layers, model, windows
from corpusmill.session import shared_folder, spread
from corpusmill.streaming import bytes as byte_stream

N_CTX, OVERLAP = 256, 64
TOP = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Byte numbers of a text in DuckDB.
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS INTEGER))"


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS digest FROM documents")
def sha256_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each text."""
    data = B.utf8(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ',')) AS digest FROM (SELECT doc_id, {_BYTES.format('text')} AS t FROM documents)")
def byte_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as byte tokens."""
    tokens = B.byte_tokens(B.utf8(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), B.digest_of_tokens(F.col("t")).alias("digest"))


@query("SELECT conv_id, turn, text = text AS same FROM conversations")
def detokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens turned into codec symbols and back: equal to the text."""
    missing = F.array(*(F.lit(b) for b in range(128, 256)))
    symbols = B.codec_symbols(B.byte_tokens(B.utf8(F.col("text"))), missing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (B.symbol_bytes(symbols) == B.utf8(F.col("text"))).alias("same"))


@query(f"SELECT conv_id, turn, CAST(len(list_filter(t, lambda x: x >= 128)) AS BIGINT) AS escapes, sha256(array_to_string(list_transform(t, lambda x: CASE WHEN x >= 128 THEN x + 256 ELSE x END), ',')) AS digest FROM (SELECT conv_id, turn, {_BYTES.format('text')} AS t FROM conversations)")
def codec_symbols_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec symbols for a vocabulary without the bytes from 128 on."""
    missing = F.array(*(F.lit(b) for b in range(128, 256)))
    symbols = B.codec_symbols(B.byte_tokens(B.utf8(F.col("text"))), missing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", symbols.alias("s")).select("conv_id", "turn", F.size(F.filter("s", lambda x: x >= 256)).cast("bigint").alias("escapes"), B.digest_of_tokens(F.col("s")).alias("digest"))


@query(f"SELECT CAST(b AS BIGINT) AS byte, count(*) AS n FROM (SELECT unnest({_BYTES.format('text')}) AS b FROM documents) GROUP BY b")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each byte occurs."""
    each = model.pair_counts(table(spark, sf_dir, "documents"))
    return each.groupBy(F.col("byte").cast("bigint").alias("byte")).agg(F.sum("n").alias("n"))


@query(f"""
WITH b AS (SELECT DISTINCT lang, unnest({_BYTES.format('text')}) AS b FROM documents)
SELECT lang, count(*) AS seen, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM range(256) r(x) WHERE x NOT IN (SELECT b FROM b c WHERE c.lang = b.lang)) AS missing
FROM b GROUP BY lang
""")
def byte_coverage_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that each language's texts have and lack."""
    seen = model.byte_counts(table(spark, sf_dir, "documents"), "lang").groupBy("lang").agg(F.collect_set("byte").alias("s"))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(255)), "s")
    return seen.select("lang", F.size("s").cast("bigint").alias("seen"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query(f"""
WITH p AS (SELECT doc_id, unnest(range(octet_length(encode(text)))) AS pos, octet_length(encode(text)) AS n FROM documents),
w AS (SELECT doc_id, n, pos, greatest(0, CAST(floor((pos - {OVERLAP}) / {N_CTX - OVERLAP}.0) AS BIGINT)) AS win FROM p)
SELECT doc_id, win AS "window", win * {N_CTX - OVERLAP} AS start, min(pos) AS score_from, max(pos) + 1 AS score_to FROM w GROUP BY doc_id, win
""")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context windows of each text's bytes."""
    streams = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(B.utf8(F.col("text"))).alias("n"))
    return windows.plan_windows(streams, "n", N_CTX, OVERLAP).select("doc_id", "window", "start", "score_from", "score_to")


@query(f"""
WITH t AS (SELECT doc_id, {_BYTES.format('text')} AS t FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(t))) AS j, t FROM t),
k AS (SELECT doc_id, CAST(t[j + 1] AS BIGINT) AS target, (j - 1) % {N_CTX} AS pos, (j - 1) // {N_CTX} AS chunk, len(t) // {N_CTX} AS chunks FROM p),
s AS (SELECT doc_id, count(*) AS targets, CAST(sum(target) AS BIGINT) AS target_sum FROM k WHERE pos BETWEEN {N_CTX // 2} AND {N_CTX - 2} AND chunk < chunks GROUP BY doc_id)
SELECT doc_id, CAST(len(t) // {N_CTX} AS BIGINT) AS chunks, coalesce(targets, 0) AS targets, coalesce(target_sum, 0) AS target_sum FROM t LEFT JOIN s USING (doc_id)
""")
def evaluation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text's whole chunks of bytes are evaluated on: the targets in their second halves."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", B.byte_tokens(B.utf8(F.col("text"))).alias("t"))
    out = tokens.select("doc_id", F.floor(F.size("t") / N_CTX).alias("chunks"), windows.chunk_targets(F.col("t"), N_CTX).alias("x"))
    return out.select("doc_id", "chunks", F.size("x").cast("bigint").alias("targets"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("target_sum"))


_CDF_SQL = f"""
t AS (SELECT doc_id, {_BYTES.format('text')} AS t FROM documents),
p AS (SELECT doc_id, unnest(list_zip(list_prepend(-1, t), t)) AS z FROM t),
pairs AS (SELECT doc_id, CAST(z[1] AS BIGINT) AS prev, CAST(z[2] AS BIGINT) AS byte, count(*) AS n FROM p WHERE z[2] IS NOT NULL GROUP BY ALL),
counts AS (SELECT prev, byte, sum(n) AS n FROM pairs GROUP BY prev, byte),
f AS (SELECT prev, byte, 1 + CAST(floor(n * {model.SCALE} / sum(n) OVER (PARTITION BY prev)) AS BIGINT) AS freq FROM counts),
cdf AS (SELECT prev, byte, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY prev ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum,
  CAST(sum(freq) OVER (PARTITION BY prev) + 256 - count(*) OVER (PARTITION BY prev) AS BIGINT) AS total FROM f)
"""


def _cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.byte_cdf(model.pair_counts(table(spark, sf_dir, "documents")))


@query(f"WITH {_CDF_SQL} SELECT prev, byte, freq, cum, total FROM cdf")
def cdf_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's byte model as integer CDFs."""
    return _cdf(spark, sf_dir).select(F.col("prev").cast("bigint").alias("prev"), F.col("byte").cast("bigint").alias("byte"), "freq", "cum", "total")


@query(f"WITH {_CDF_SQL} SELECT prev, count(*) AS symbols, CAST(0 AS BIGINT) AS violations FROM cdf GROUP BY prev")
def cdf_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row of the byte model breaks a rule of CDFs."""
    return model.cdf_violations(_cdf(spark, sf_dir)).withColumn("prev", F.col("prev").cast("bigint"))


@query(f"WITH {_CDF_SQL} SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, round(sum(-log2(freq / total) * n) / sum(n), 6) AS bits_per_byte FROM pairs JOIN cdf USING (prev, byte) GROUP BY doc_id")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bits the corpus's byte model needs for a byte of each text."""
    documents = table(spark, sf_dir, "documents")
    out = model.code_lengths(documents, model.byte_cdf(model.pair_counts(documents))).filter("n_bytes > 0")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", F.round(F.col("bits") / F.col("n_bytes"), 6).alias("bits_per_byte"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS digest FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text range-coded under the byte model and decoded again: the digest of what comes back."""
    documents = table(spark, sf_dir, "documents")
    weights = codec.model_table(_cdf(spark, sf_dir))
    back = codec.decompress(codec.compress(documents, weights), weights)
    return back.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("digest"))


@query()
def compressed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text and of its payload."""
    packed = codec.compress(table(spark, sf_dir, "documents"), codec.model_table(_cdf(spark, sf_dir)))
    return packed.select("doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"))


_HEX_LE = "list_aggregate(list_transform(range(0, {1}), lambda i: printf('%02x', CAST(({0} >> CAST(8 * i AS INTEGER)) & 255 AS INTEGER))), 'string_agg', '')"


@query(f"""
SELECT doc_id, '44544c5a' || '0100' || (CASE WHEN octet_length(encode(text)) % 2 = 1 THEN '0100' ELSE '0000' END) || sha256(lang) || '{N_CTX.to_bytes(4, 'little').hex()}' || '{OVERLAP.to_bytes(4, 'little').hex()}'
  || {_HEX_LE.format('octet_length(encode(text))', 8)} AS header, octet_length(encode(text)) AS orig_len, sha256(lang) AS model FROM documents
""")
def container_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 56-byte header for each text, and what is parsed from it."""
    size = F.octet_length(B.utf8(F.col("text"))).cast("bigint")
    header = B.header_hex(F.sha2("lang", 256), F.lit(N_CTX), F.lit(OVERLAP), size, size % 2 == 1)
    out = table(spark, sf_dir, "documents").select("doc_id", header.alias("header")).withColumn("p", B.parse_header(F.col("header")))
    return out.select("doc_id", "header", "p.orig_len", F.col("p.model_sha256").alias("model"))


_Q8 = """
v AS (SELECT vec_id, embedding AS e FROM embeddings),
b AS (SELECT vec_id, blk, e[blk * 32 + 1 : blk * 32 + 32] AS x FROM v, LATERAL (SELECT unnest(range(len(e) // 32)) AS blk)),
s AS (SELECT vec_id, blk, x, list_max(list_transform(x, lambda y: abs(y))) / CAST(127 AS FLOAT) AS d FROM b),
q AS (SELECT vec_id, blk, x, d, list_transform(x, lambda y: CASE WHEN d = 0 THEN 0 ELSE
  greatest(-127, least(127, CAST(trunc((y / d) + (CASE WHEN y / d < 0 THEN CAST(-0.5 AS FLOAT) ELSE CAST(0.5 AS FLOAT) END)) AS INTEGER))) END) AS q FROM s)
"""


def _q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.blocks(F.col("embedding"))).alias("blk", "x"))
    scaled = e.withColumn("d", V.q8_scale(F.col("x")))
    return scaled.withColumn("q", V.q8_values(F.col("x"), F.col("d")))


@query(f"WITH {_Q8} SELECT vec_id, blk, CAST(d AS DOUBLE) AS d, array_to_string(q, ',') AS q FROM q")
def q8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in 8-bit blocks of 32."""
    return _q8(spark, sf_dir).select("vec_id", F.col("blk").cast("bigint").alias("blk"), F.col("d").cast("double").alias("d"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@query(f"WITH {_Q8} SELECT a.vec_id, a.blk, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS dot FROM q a JOIN q b ON a.vec_id + 1 = b.vec_id AND a.blk = b.blk")
def q8_int_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact integer dots of each quantised block with the next vector's."""
    q = _q8(spark, sf_dir).select("vec_id", "blk", "q")
    after = q.select((F.col("vec_id") - 1).alias("vec_id"), "blk", F.col("q").alias("r"))
    return q.join(after, ["vec_id", "blk"]).select("vec_id", F.col("blk").cast("bigint").alias("blk"), V.int_dot(F.col("q"), F.col("r")).alias("dot"))


_LANES = " + ".join(f"(L[{k}] + L[{k + 1}])" for k in (1, 3, 5, 7))


@query("""
WITH l AS (SELECT vec_id, list_transform(range(0, 8), lambda k: list_reduce(list_prepend(CAST(0 AS FLOAT), list_transform(range(CAST(k AS BIGINT), len(embedding), 8), lambda i: embedding[i + 1] * embedding[i + 1])), lambda a, x: CAST(a + x AS FLOAT))) AS L FROM embeddings)
SELECT vec_id, CAST(CAST(CAST(L[1] + L[2] AS FLOAT) + CAST(L[3] + L[4] AS FLOAT) AS FLOAT) + CAST(CAST(L[5] + L[6] AS FLOAT) + CAST(L[7] + L[8] AS FLOAT) AS FLOAT) AS DOUBLE) AS squares FROM l
""")
def dot_eight_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of squares in FLOAT in the fixed order of eight lanes."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", V.dot_float(e, e).cast("double").alias("squares"))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, restored): restored from 8-bit blocks, in FLOAT."""
    e = table(spark, sf_dir, "embeddings")
    blocks = F.transform(V.blocks(F.col("embedding")), lambda x: F.struct(x.alias("x"), V.q8_scale(x).alias("d")))
    values = F.flatten(F.transform(blocks, lambda b: F.transform(V.q8_values(b["x"], b["d"]), lambda q: V.as_float(q.cast("float") * b["d"]))))
    return e.select("vec_id", "embedding", values.alias("restored"))


_PAIRED = f"WITH {_Q8}, r AS (SELECT vec_id, blk * 32 + i AS i, CAST(x[i + 1] AS DOUBLE) AS a, CAST(CAST(q[i + 1] AS FLOAT) * d AS DOUBLE) AS b FROM q, LATERAL (SELECT unnest(range(32)) AS i))"
_ROWS = f"{_PAIRED}, m AS (SELECT vec_id, count(*) AS n, sum(a * b) AS dot, sum(a * a) AS aa, sum(b * b) AS bb, sum((a - b) * (a - b)) AS sq, max(abs(a - b)) AS max_abs FROM r GROUP BY vec_id)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.row_metrics(_restored(spark, sf_dir), "embedding", "restored", "vec_id")


@query(f"{_ROWS} SELECT vec_id, round(dot / (sqrt(aa) * sqrt(bb)), 9) AS cosine, max_abs, round(sqrt(sq / n), 9) AS rms FROM m")
def compare_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding against its restored 8-bit form."""
    return _metrics(spark, sf_dir).select("vec_id", F.round("cosine", 9).alias("cosine"), "max_abs", F.round("rms", 9).alias("rms"))


@query(f"{_ROWS} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(dot) / (sqrt(sum(aa)) * sqrt(sum(bb))), 9) AS cosine, max(max_abs) AS max_abs, round(sqrt(sum(sq) / sum(n)), 9) AS rms, round(min(dot / (sqrt(aa) * sqrt(bb))), 9) AS min_row_cosine FROM m")
def compare_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against their restored 8-bit forms."""
    out = compare.overall(_metrics(spark, sf_dir))
    return out.select("n", F.round("cosine", 9).alias("cosine"), "max_abs", F.round("rms", 9).alias("rms"), F.round("min_row_cosine", 9).alias("min_row_cosine"))


@query(f"{_ROWS} SELECT vec_id, round(dot / (sqrt(aa) * sqrt(bb)), 9) AS cosine, max_abs FROM m ORDER BY dot / (sqrt(aa) * sqrt(bb)), max_abs DESC, vec_id LIMIT {TOP}")
def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that 8-bit blocks serve worst."""
    return compare.worst_rows(_metrics(spark, sf_dir), "vec_id", TOP).select("vec_id", F.round("cosine", 9).alias("cosine"), "max_abs")


@query(f"{_PAIRED} SELECT vec_id, i, abs(a - b) AS diff FROM r ORDER BY diff DESC, vec_id, i LIMIT {TOP}")
def top_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements that 8-bit blocks change most."""
    return compare.top_differences(_restored(spark, sf_dir), "embedding", "restored", "vec_id", TOP)


@query("""
WITH m AS (SELECT vec_id, label, embedding AS e, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings),
n AS (SELECT *, ln(list_sum(list_transform(e, lambda x: exp(CAST(x AS DOUBLE) - top)))) AS norm FROM m)
SELECT vec_id, round(CAST(e[label % len(e) + 1] AS DOUBLE) - top - norm, 6) AS target_logprob FROM n
""")
def target_log_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-softmax of embeddings taken as logits, at the label."""
    logs = V.log_softmax(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(logs, (F.col("label") % F.size("embedding")).cast("int")), 6).alias("target_logprob"))


@query("""
WITH m AS (SELECT vec_id, embedding AS e, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings),
w AS (SELECT vec_id, list_transform(e, lambda x: exp(greatest(CAST(x AS DOUBLE) - top, -88.0))) AS w FROM m),
f AS (SELECT vec_id, unnest(range(len(w))) AS i, unnest(w) AS x, list_sum(w) AS z FROM w),
n AS (SELECT vec_id, i, 1 + CAST(floor(x / z * 16777216) AS BIGINT) AS freq FROM f)
SELECT vec_id, i, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum,
  CAST(sum(freq) OVER (PARTITION BY vec_id) AS BIGINT) AS total FROM n
""")
def softmax_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings taken as logits, as integer CDFs of 24 bits."""
    freq = table(spark, sf_dir, "embeddings").select("vec_id", V.softmax_frequencies(F.col("embedding")).alias("f"))
    whole = freq.select("vec_id", "f", V.running_sums(F.col("f")).alias("c"), F.aggregate("f", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))
    each = whole.select("vec_id", "total", F.posexplode(F.arrays_zip(F.col("f").alias("freq"), F.col("c").alias("cum"))).alias("i", "x"))
    return each.select("vec_id", F.col("i").cast("bigint").alias("i"), "x.freq", "x.cum", "total")


@query("""
WITH r AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding AS e, 1 / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding) + 1e-5) AS s FROM embeddings)
SELECT vec_id, i, round(CAST(e[i + 1] AS DOUBLE) * s, 6) + 0.0 AS y FROM r
""")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings over their root mean square."""
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.rms_norm(F.col("embedding"))).alias("i", "y"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query("""
WITH p AS (SELECT vec_id, embedding AS e, len(embedding) AS n, unnest(range(len(embedding) // 2)) AS j, vec_id % 16 AS pos FROM embeddings),
a AS (SELECT *, pos * pow(10000.0, -2.0 * j / n) AS t FROM p)
SELECT vec_id, j, round(CAST(e[2 * j + 1] AS DOUBLE) * cos(t) - CAST(e[2 * j + 2] AS DOUBLE) * sin(t), 6) + 0.0 AS x, round(CAST(e[2 * j + 1] AS DOUBLE) * sin(t) + CAST(e[2 * j + 2] AS DOUBLE) * cos(t), 6) + 0.0 AS y FROM a
""")
def rotary_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent pairs turned by their position."""
    turned = V.rotate_pairs(F.col("embedding"), F.col("vec_id") % 16)
    out = table(spark, sf_dir, "embeddings").select("vec_id", turned.alias("t"))
    out = out.select("vec_id", "t", F.explode(F.sequence(F.lit(0), (F.size("t") / 2).cast("int") - 1)).alias("j"))
    return out.select("vec_id", F.col("j").cast("bigint").alias("j"), (F.round(F.get("t", 2 * F.col("j")), 6) + 0.0).alias("x"), (F.round(F.get("t", 2 * F.col("j") + 1), 6) + 0.0).alias("y"))


@query("""
WITH b AS (SELECT x AS bits, (x >> 10) & 31 AS e, x & 1023 AS f, CASE WHEN x >= 32768 THEN -1.0 ELSE 1.0 END AS s FROM range(65536) r(x))
SELECT bits, CAST(CASE WHEN e = 0 THEN s * f * pow(2.0, -24) WHEN e < 31 THEN s * (f + 1024) * pow(2.0, e - 25) END AS DOUBLE) + 0.0 AS value FROM b
""")
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 65,536 half floats."""
    return spark.range(65536).select(F.col("id").alias("bits"), (B.half_to_double(F.col("id").cast("int")) + 0.0).alias("value"))


_CENTROIDS = "c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS w FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i), x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), y AS (SELECT vec_id, c.label, sum(CAST(x AS DOUBLE) * w) AS y FROM x JOIN c USING (i) GROUP BY vec_id, c.label)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return layers.matrix_product(e, layers.centroids(e, "label", "embedding"), "vec_id", "embedding", "label", "weights")


@query(f"WITH {_CENTROIDS} SELECT vec_id, label, round(y, 6) + 0.0 AS y FROM y")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding times the matrix of label means."""
    return _logits(spark, sf_dir).select("vec_id", "label", (F.round("y", 6) + 0.0).alias("y"))


@query(f"WITH {_CENTROIDS} SELECT vec_id, label, round(y / (1 + exp(-y)) * y, 6) + 0.0 AS gated FROM y")
def gated_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """silu(y) * y of the matrix product."""
    y = F.col("y")
    return _logits(spark, sf_dir).select("vec_id", "label", (F.round(V.silu(y) * y, 6) + 0.0).alias("gated"))


@query("""
WITH v AS (SELECT vec_id, label, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
s AS (SELECT a.vec_id, a.pos, b.e AS v, list_sum(list_transform(list_zip(a.e, b.e), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(len(a.e)) AS s FROM v a JOIN v b ON a.label = b.label AND b.pos BETWEEN a.pos - 7 AND a.pos),
w AS (SELECT vec_id, pos, v, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s),
p AS (SELECT vec_id, pos, v, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM w)
SELECT vec_id, pos, i, round(sum(p * CAST(v[i + 1] AS DOUBLE)), 6) + 0.0 AS y FROM p, LATERAL (SELECT unnest(range(len(v))) AS i) GROUP BY vec_id, pos, i
""")
def causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attention head over the last eight vectors of each label."""
    out = layers.causal_attention(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 8)
    each = out.select("vec_id", "pos", F.posexplode("output").alias("i", "y"))
    return each.select("vec_id", "pos", F.col("i").cast("bigint").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query("WITH a AS (SELECT lang || '/' || CAST(n_chars AS VARCHAR) AS label, sha256(text) AS d FROM documents) SELECT label, count(*) AS artifacts, count(DISTINCT d) AS distinct_digests, count(DISTINCT d) = 1 AS agree FROM a GROUP BY label")
def artifact_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all texts of a language and length have one digest."""
    a = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.col("n_chars").cast("string")).alias("label"), F.sha2("text", 256).alias("digest"))
    return compare.artifact_agreement(a, "label", "digest")


_PATTERNS = ["http", "password", "token = ", "!!", "@"]


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT unnest(" + repr(_PATTERNS) + ") AS pattern) SELECT pattern, count(*) AS lines FROM l JOIN p ON contains(line, pattern) GROUP BY pattern")
def banned_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by the banned substring that they contain."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    found = F.filter(F.array(*(F.lit(p) for p in _PATTERNS)), lambda p: F.col("line").contains(p))
    return lines.select(F.explode(found).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH t AS (SELECT label, count(*) * 64 AS n FROM embeddings GROUP BY label),
s AS (SELECT label, n, n // 32 * 34 AS nbytes, (n // 32 * 34 + 31) // 32 * 32 AS padded FROM t)
SELECT CAST(label AS BIGINT) AS label, n, nbytes, CAST(coalesce(sum(padded) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s
""")
def tensor_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each label's vectors stand in a container of 8-bit blocks, aligned to 32 bytes."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count(F.lit(1)) * 64).alias("n"))
    size = (F.floor(F.col("n") / 32) * 34).cast("bigint")
    s = t.select("label", "n", size.alias("nbytes"), (F.ceil(size / 32) * 32).cast("bigint").alias("padded"))
    # one row per tensor: a directory, not data
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    return s.select(F.col("label").cast("bigint").alias("label"), "n", "nbytes", F.coalesce(F.sum("padded").over(before), F.lit(0)).alias("offset"))


@query("SELECT source, count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, max(octet_length(encode(text))) AS longest FROM documents GROUP BY source")
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte totals by source, from a stream of the documents' files that runs until it has read them all."""
    name = f"totals_{uuid.uuid4().hex}"
    return byte_stream.drain(spark, f"{sf_dir}/documents.parquet", name, f"{shared_folder(spark)}/{name}")
