"""Texts coded side by side, byte counts in pieces, and the queries made of them."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill import sql_functions
from corpusmill.operators import codec, model
from corpusmill.plans import quantized


def texts_and_table(seed=4):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(range(97, 123), [30, *[1] * 25], k=rng.choice([0, 1, 5, 80, 900]))) for _ in range(120)] + [rng.randbytes(4000), b""]
    freq = [[1 + (b == 97) * 60000 + rng.randrange(40) for b in range(256)] for _ in range(257)]
    return texts, [np.concatenate([[0], np.cumsum(f)]).tolist() for f in freq]


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *(len(t) for t in texts)])


@pytest.mark.parametrize("scale", [1, 9000])
def test_side_by_side_as_one_by_one(scale):
    texts, table = texts_and_table()
    table = [[c * scale for c in row] for row in table]
    payloads = codec.encode_texts(*joined(texts), table)
    assert payloads == [codec.encode_bytes(t, table) for t in texts]
    sizes = np.array([len(t) for t in texts])
    assert codec.decode_texts(*joined(payloads), sizes, table).tobytes() == b"".join(texts)
    for at in (3, 120, payloads.index(codec.encode_bytes(max(texts[:120], key=len), table))):
        for damaged in (payloads[at][:-1], payloads[at] + b"x", payloads[at][:-1] + bytes([payloads[at][-1] ^ 1])):
            with pytest.raises(ValueError):
                codec.decode_texts(*joined([*payloads[:at], damaged, *payloads[at + 1 :]]), sizes, table)


def test_container_with_repeated_ids(spark, tmp_path):
    """Rows of equal id stay rows of their own, as in the SQL."""
    spark.createDataFrame([(1, "ab", "x"), (1, "cde", "x"), (2, "é", "y"), (3, "z", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quantized.container_roundtrip(spark, str(tmp_path)).select("doc_id", "lang", "orig_len").collect()
    assert sorted(tuple(r) for r in got) == [(1, "x", 2), (1, "x", 3), (2, "y", 2)]


def test_cells_in_pieces():
    texts = [b"", b"abcabc", b"x" * 50, b"", b"yz", b"q" * 7]
    whole = np.zeros(257 * 256, np.int64)
    for t in texts:
        for a, b in zip([-1, *t[:-1]], t, strict=False):
            whole[(a - model.START) * 256 + b] += 1
    for most in (1, 3, 7, 1000):
        found = [c for _, _, _, c in model._piece_cells(pa.array(texts), most)]
        assert (np.bincount(np.concatenate(found), minlength=257 * 256) == whole).all() and max(map(len, found)) <= most


def test_cells_take_little_memory():
    column = pa.array(["some text " * 500] * 4000 + ["one long text " * 1_000_000])
    tracemalloc.start()
    total = sum(len(c) for _, _, _, c in model._piece_cells(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 34_000_000 and peak < 30 << 20


def test_code_lengths_of_a_long_text(spark, monkeypatch):
    texts = [(1, "ab" * 700_000), (2, "abba"), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    cdf = model.byte_cdf(model.pair_counts(df))
    bits = {(r["prev"], r["byte"]): np.log2(r["total"] / r["freq"]) for r in cdf.collect()}
    got = {r["id"]: r for r in model.code_lengths(df, cdf).collect()}
    for i, t in texts:
        want = sum(bits[a, b] for a, b in zip([model.START, *t.encode()[:-1]], t.encode(), strict=False)) if t else 0
        assert got[i]["n_bytes"] == len(t) and got[i]["bits"] == pytest.approx(want)


def test_sql_byte_tokens_of_all_bytes_and_long_texts(spark):
    sql_functions.register(spark)
    texts = ["", "aé€𝄞\x00\n", "".join(map(chr, range(1, 400))), "ab" * 300_000]
    got = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", F.expr("byte_tokens(t)").alias("b")).collect()
    assert {r["i"]: bytes(r["b"]) for r in got} == {i: t.encode() for i, t in enumerate(texts)}
    assert spark.sql("SELECT byte_tokens(CAST(NULL AS STRING)) AS b").first()["b"] == []
