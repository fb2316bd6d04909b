"""Vocabularies, dumps, containers and blocks against known values and plain versions."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import blocks, vectors
from corpusmill.operators import codec, layers, model, vocabulary
from corpusmill.plans import quantized, reference
from corpusmill.sources import dumps, gguf
from tests.test_reference import DATA, tiny_model


def byte_pieces(extra):
    return [(b, f"<0x{b:02X}>", 0.0, None) for b in range(256)] + [(256 + i, p, s, None) for i, (p, s) in enumerate(extra)]


def read(spark, extra):
    return vocabulary.read_vocabulary(spark.createDataFrame(byte_pieces(extra), "id int, piece string, score double, token_type int"))


def texts(spark, *values):
    return spark.createDataFrame([*enumerate(values)], "k int, text string")


def tokens(df):
    return [r["tokens"] for r in sorted(df.collect(), key=lambda r: r["k"])]


def test_merges_in_known_cases(spark):
    pieces = read(spark, [("ab", 0.0), ("ba", 0.0), ("aba", 0.0)])
    merges = vocabulary.parse_merges(spark.createDataFrame([(0, "a b"), (1, "b a"), (2, "ab a")], "rank int, merge string"))
    got = vocabulary.tokenize_by_merges(texts(spark, "ab", "aba", "baba", "", None, "é"), pieces, merges, ["k"])
    assert tokens(got) == [[256], [258], [98, 258], [], [], [0xC3, 0xA9]]
    back = vocabulary.detokenize(got, pieces, ["k"]).collect()
    assert sorted((r["k"], bytes(r["data"])) for r in back) == [(0, b"ab"), (1, b"aba"), (2, b"baba"), (3, b""), (4, b""), (5, "é".encode())]
    with pytest.raises(Exception, match="merge"):
        vocabulary.parse_merges(spark.createDataFrame([(0, "a  b")], "rank int, merge string")).collect()


def test_merges_against_a_plain_version(spark):
    pieces = vocabulary.read_vocabulary(quantized.small_vocabulary(spark))
    merges = vocabulary.parse_merges(spark.createDataFrame([*enumerate(quantized.MERGES)], "rank int, merge string"))
    own = vocabulary.collect_pieces(pieces, vocabulary.merge_table(pieces, merges))
    docs = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + ["the " * 500, "ingining", ""]
    for text in docs:
        ids = [own.byte_ids[b] for b in text.encode()]
        while True:
            ranked = [(own.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in own.merges]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [own.merges[ids[i], ids[i + 1]][1]]
        assert own.by_merges(text.encode()) == ids


def test_longest_pieces_in_known_cases(spark):
    pieces = read(spark, [("\u2581hello", 0.0), ("he", 5.0), ("he", 7.0)])
    assert tokens(vocabulary.tokenize_by_longest(texts(spark, " hello!", "hehello", "\u2581", None), pieces, ["k"])) == [[256, 33], [258, 258, 108, 108, 111], [0xE2, 0x96, 0x81], []]


def test_pieces_and_rules(spark):
    cases = {"<0x0A>": b"\n", "<0x+F>": b"\x0f", "<0xZZ>": b"<0xZZ>", "\u0120in": b" in", "\u00e9": b"\xe9", "\u2581de": b" de", "a\u2581": "a\u2581".encode(), "": b"", "\u4e2d": "\u4e2d".encode()}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", vocabulary.piece_bytes(F.col("p")).alias("b")).collect()
    assert {r["p"]: bytes(r["b"]) for r in rows} == cases
    typed = spark.createDataFrame([(0, "a", 0.0, 1), (1, "a", 0.0, 3), (2, "a", float("inf"), 4), (3, "b", 0.0, 6)], "id int, piece string, score double, token_type int")
    v = vocabulary.read_vocabulary(typed)
    assert [r["emittable"] for r in v.orderBy("id").collect()] == [True, False, True, True]
    assert {r["issue"]: r["n"] for r in vocabulary.violations(v, 5).collect()} == {"repeated piece": 1, "repeated byte": 1, "score not finite": 1, "length": 1}
    assert vocabulary.byte_coverage(v).first()["covered"] == 2
    with pytest.raises(Exception, match="token type"):
        vocabulary.read_vocabulary(typed.withColumn("token_type", F.lit(9))).collect()


def test_vocabulary_and_config_of_a_container(spark):
    stored = spark.createDataFrame([("m", tiny_model())], "path string, content binary")
    metadata = gguf.metadata_of(stored)
    config = gguf.model_config(metadata)
    assert tuple(config.first())[1:] == ("llama", 1, 4, 6, 2, 1, 16, 256)
    assert gguf.check_tensors(gguf.expected_tensors(config), gguf.tensors_of(stored)).count() == 0
    short = gguf.tensors_of(stored).filter("name != 'output_norm.weight'").withColumn("dims", F.when(F.col("name") == "blk.0.ffn_up.weight", F.array(F.lit(4), F.lit(5)).cast("array<bigint>")).otherwise(F.col("dims")))
    assert sorted(tuple(r)[1:] for r in gguf.check_tensors(gguf.expected_tensors(config), short).collect()) == [("blk.0.ffn_up.weight", "shape"), ("output_norm.weight", "missing")]
    pieces = vocabulary.vocabulary_of(metadata)
    assert pieces.count() == 256 and vocabulary.byte_coverage(vocabulary.read_vocabulary(pieces)).first()["missing"] == ""
    assert vocabulary.merges_of(metadata).count() == 0 and vocabulary.kinds_of(metadata).first()["kind"] == "bytes"
    assert gguf.parse_metadata(tiny_model()[:4800])[0] == ("general.architecture", "string", "llama")
    assert gguf.rows_of(stored, ["output.weight"]).count() == 256
    with pytest.raises(Exception, match="no width"):
        gguf.model_config(metadata.filter("key != 'llama.embedding_length'")).collect()


def test_container_blocks_equal_column_expressions(spark):
    rng = np.random.default_rng(3)
    q4 = np.zeros(5, [("d", "<f2"), ("m", "<f2"), ("s", "u1", 12), ("q", "u1", 128)])
    q6 = np.zeros(5, [("l", "u1", 128), ("h", "u1", 64), ("s", "i1", 16), ("d", "<f2")])
    for name in ("s", "q"):
        q4[name] = rng.integers(0, 256, q4[name].shape)
    for name in ("l", "h"):
        q6[name] = rng.integers(0, 256, q6[name].shape)
    q6["s"] = rng.integers(-128, 128, (5, 16))
    q4["d"], q4["m"], q6["d"] = (rng.normal(0, 1, 5).astype(np.float16) for _ in range(3))
    rows = [(i, float(q4["d"][i]), float(q4["m"][i]), q4["s"][i].tolist(), q4["q"][i].tolist(), float(q6["d"][i]), q6["l"][i].tolist(), q6["h"][i].tolist(), q6["s"][i].tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, d float, m float, s array<int>, q array<int>, e float, l array<int>, h array<int>, t array<int>")
    c = F.col
    got = df.select("i", blocks.q4_k_values(c("d"), c("m"), c("s"), c("q")).alias("x"), blocks.q6_k_values(c("e"), c("t"), blocks.q6_k_quants(c("l"), c("h"))).alias("y")).orderBy("i").collect()
    assert (np.array([r["x"] for r in got], np.float32).reshape(-1) == gguf.dequantize(12, q4.tobytes())).all()
    assert (np.array([r["y"] for r in got], np.float32).reshape(-1) == gguf.dequantize(14, q6.tobytes())).all()


def test_eight_bit_blocks_of_256(spark):
    x = [0.0] * 256
    x[3], x[4], x[9] = -2.0, 2.0, 1.0
    rows = spark.createDataFrame([(0, [0.0] * 256), (1, x)], "k int, x array<float>").select("k", blocks.q8_k(F.col("x")).alias("b")).orderBy("k").collect()
    assert rows[0]["b"]["d"] == 0 and set(rows[0]["b"]["q"]) == {0}
    b = rows[1]["b"]
    # the first of the largest magnitude is negative and becomes -127; halves go to the even integer
    assert (b["q"][3], b["q"][4], b["q"][9], b["bsums"][0]) == (-127, 127, 64, 64) and b["d"] == pytest.approx(2 / 127)


def test_log_probability_dumps(spark):
    rng = np.random.default_rng(1)
    n_ctx, chunks, size = 8, 3, 7
    tokens_ = rng.integers(0, size, n_ctx * chunks)
    rows = np.log(rng.dirichlet(np.ones(size), 3 * chunks)).astype(np.float32)
    data = dumps.encode_log_probs(n_ctx, tokens_, rows)
    assert len(data) == 20 + 4 * 24 + 9 * (8 + 16)
    table = dumps.read_log_probs(spark.createDataFrame([("a", data)], "path string, content binary"))
    got = sorted(table.collect(), key=lambda r: (r["chunk"], r["position"]))
    assert [(r["chunk"], r["position"]) for r in got] == [(c, p) for c in range(3) for p in (4, 5, 6)]
    assert [r["target"] for r in got] == [int(tokens_[c * 8 + p + 1]) for c in range(3) for p in (4, 5, 6)]
    assert np.abs(np.array([r["log_probs"] for r in got]) - rows).max() < 1e-3
    other = table.withColumn("log_probs", F.transform("log_probs", lambda v: (v + 0.5).cast("float")))
    c = dumps.compare_log_probs(table, other).first()
    assert (c["rows"], c["n"]) == (9, 63) and c["max_abs"] == pytest.approx(0.5, abs=1e-5) and c["rms"] == pytest.approx(0.5, abs=1e-5) and c["max_target_abs"] == pytest.approx(0.5, abs=1e-5)
    for bad in (data[:-1], b"x" + data[1:], data[:20] + b"\xff\xff\xff\xff" + data[24:], data[:8] + struct.pack("<I", 1) + data[12:]):
        with pytest.raises(dumps.DumpError):
            dumps.parse_log_probs(bad)


def test_float_dumps_and_hash_files(spark, tmp_path):
    values = [1.5, -0.0, 3e-40]
    row = spark.createDataFrame([(values,)], "v array<float>").select(dumps.float_dump(F.col("v")).alias("b")).first()
    assert bytes(row["b"]) == struct.pack("<3f", *values) and dumps.parse_float_dump(bytes(row["b"])).tolist() == [np.float32(v) for v in values]
    for bad in (b"", b"abc", struct.pack("<f", float("nan"))):
        with pytest.raises(dumps.DumpError):
            dumps.parse_float_dump(bad)
    sha = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "a.txt").write_text(f"one {sha}\ntwo  {sha}\n")
    (tmp_path / "b.txt").write_text(f"two {sha}\none {sha}\n")
    assert sorted((r["label"], r["sha256"]) for r in dumps.read_hash_files(spark, str(tmp_path)).collect()) == [("one", sha)] * 2 + [("two", sha)] * 2
    for bad in ("one", f"one {sha} x", "one abc", f"one {sha}\none {sha}"):
        with pytest.raises(Exception, match="label"):
            dumps.read_hashes(spark.createDataFrame([("f", line) for line in bad.split("\n")], "path string, value string")).collect()
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([1.0, float("nan")],)], "v array<float>").select(vectors.require_finite(F.col("v"))).collect()


def test_attention_in_blocks_equals_one_block(spark, monkeypatch):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.lit(0).alias("label"), "embedding")
    rows = lambda: sorted((r["vec_id"], r["pos"], r["output"]) for r in layers.causal_attention(e, "vec_id", "label", "embedding", 20).collect())
    whole = rows()
    monkeypatch.setattr(layers, "ATTENTION_ROWS", 10)
    assert rows() == whole


def test_ranges_are_checked():
    with pytest.raises(ValueError):
        codec.Encoder().put(0, 0, 4)
    with pytest.raises(ValueError):
        codec.Encoder().put(3, 2, 4)


def test_key_heads(spark):
    assert [r[0] for r in spark.range(8).select(vectors.key_head(F.col("id"), 8, 2)).collect()] == [0] * 4 + [1] * 4
    with pytest.raises(ValueError):
        vectors.key_head(F.lit(0), 6, 4)


def test_escape_ranges(spark):
    f = F.array(*(F.lit(x).cast("bigint") for x in (5, 1, 9)))
    got = [r[0] for r in spark.range(-1, 260).select(model.symbol_range(f, F.col("id"), True)).collect()]
    assert got[0] is None and [tuple(r) for r in got[1:5]] == [(0, 5, 271), (5, 1, 271), (6, 9, 271), (15, 1, 271)] and tuple(got[259]) == (270, 1, 271) and got[260] is None


@pytest.mark.parametrize("name", ["merge_tokenize", "logits_digest", "compressed_sizes"])
def test_queries_without_sql(spark, name):
    rows = reference.QUERIES[name](spark, DATA).collect()
    if name == "merge_tokenize":
        assert len(rows) == 40 and all(r["same"] for r in rows)
    elif name == "logits_digest":
        e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
        assert {r["vec_id"]: r["digest"] for r in rows} == {k: hashlib.sha256(np.array(v, "<f4").tobytes()).hexdigest() for k, v in e.items()}
    else:
        bits = {r["doc_id"]: r["bits_per_byte"] * r["n_bytes"] for r in reference.QUERIES["bits_per_byte"](spark, DATA).collect()}
        # the coder's cost over the model's own: what its 8 closing bytes and its rounding need
        assert all(bits[r["doc_id"]] / 8 - 1 <= r["payload_bytes"] <= bits[r["doc_id"]] / 8 + 10 for r in rows if r["n_bytes"])
