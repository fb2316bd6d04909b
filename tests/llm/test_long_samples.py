"""Labelled texts beyond the sample's length are fitted on by pieces."""

import random

import numpy as np
import pytest

from corpusmill.llm import language_id, toxicity


def test_language_with_long_texts_only(spark):
    rng = random.Random(2)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, text("abcdef", 60), "x") for i in range(60)] + [(100 + i, text("uvwxyz", 5000), "y") for i in range(12)]
    assert min(len(r[1]) for r in rows if r[2] == "y") > language_id.SAMPLE_CHARS
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: k for i, _, k in rows}


def test_toxic_class_in_long_texts_only(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        own = rng.choices([*words, *["idiot"] * 6 * toxic], k=4500 if toxic else 60)
        rows.append((i, " ".join(own), "en"))
        labels.append((i, int(toxic)))
    assert min(len(t) for i, t, _ in rows if i % 3 == 0) > toxicity.SAMPLE_BYTES
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, net).collect()}
    assert sum(got[i] == y for i, y in labels) >= 0.95 * len(labels)


def test_every_labelled_row_and_whole_texts_teach(spark, monkeypatch):
    """Rows beyond any count, and words anywhere in a long text, are learned from; shards are averaged."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    seen = []
    kept = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, counts, size: seen.append((rows.count(), counts, size, rows.selectExpr("sum(octet_length(text))").first()[0])) or kept(rows, counts, size))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        own = rng.choices(words, k=4500 if i % 10 == 0 else 60)
        rows.append((i, " ".join(own + ["idiot", "scum"] * 3 * toxic), "en"))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), held_out_of=None)
    (n, counts, size, read), *_ = seen
    assert n == sum(counts.values()) > 400 and size == read > toxicity.SAMPLE_BYTES * 40
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, net).collect()}
    assert sum(got[i] == y for i, y in labels) >= 0.95 * len(labels)


@pytest.mark.parametrize("sharpness", [1.0, 16.0, None])
def test_gradients_of_pieces(sharpness):
    net, rng = toxicity.new_network(4), np.random.default_rng(2)
    rows = toxicity.buckets(rng.integers(0, 2**63, 100).astype(np.uint64))
    bounds, y, weight = np.array([0, 5, 5, 70, 100]), np.array([1, 0, 1, 0]), np.array([0.7, 1.1, 0.7, 1.1])
    want, got = toxicity.gradients(net, rows, bounds, y, weight, sharpness), toxicity.batch_gradients(net, rows, bounds, y, weight, sharpness, 16)
    assert abs(got.loss - want.loss) < 1e-5
    for a, b in [(got.out, want.out), (got.out_bias, want.out_bias), (got.words, want.words), *((got.filters[w], want.filters[w]) for w in toxicity.FILTERS), *((got.bias[w], want.bias[w]) for w in toxicity.FILTERS)]:
        assert np.allclose(a, b, atol=1e-5)
