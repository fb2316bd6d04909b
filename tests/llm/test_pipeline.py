"""The pipeline stage by stage against plain versions, on documents with planted cases."""

import random

import pytest

import corpus_pipeline
from corpusmill.llm import bpe, language_id, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import brute as classes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    real = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rng = random.Random(0)
    rows = [tuple(r) for r in real]
    clean = rows[10][1].split()
    rows += [(1000, rows[10][1], "en", "s", 1), (1001, " ".join(clean[:60]), "en", "s", 1), (1002, " ".join(clean[:60][:-1] + ["other"]), "en", "s", 1)]
    rows += [(1003, items[0][1] + " " + " ".join(rng.sample(clean, min(20, len(clean)))), "en", "s", 1), (1004, None, "en", "s", 0), (1005, "12 34 !!", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = {r["doc_id"] for r in out.collect()}
        if k < 4:
            assert out.columns == columns and out.count() == len(after)
        if k == 0:
            _, _, _, rejected = language_id.train(docs)[0].predict([*before.values()])
            assert after == {i for i, r in zip(before, rejected, strict=True) if not r} and not {1004, 1005} & after
        elif k == 1:
            net = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            import pyarrow as pa

            s = toxicity.score_bytes(net, *toxicity.text_bytes(pa.array([*before.values()], pa.string())))
            assert after == {i for i, v in zip(before, s, strict=True) if v < 0.5}
        elif k == 2:
            assert after == {*classes([*before.items()]).values()} and 1002 not in after
        elif k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert after == {r[0] for r in contaminated([*before.items()], items) if not r[5]} and 1003 not in after
        else:
            codec = bpe.Codec(bpe.PerfectHash(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), P.PATTERN)
            for r in out.collect():
                assert r["token_ids"] == codec.encode(before[r["doc_id"]]) and codec.decode(r["token_ids"]).decode() == before[r["doc_id"]]
        docs = out
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
