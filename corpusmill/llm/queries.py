"""The numbered queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat_format, decontaminate, hpylm, kd_sharding, language_id, near_dedup, ogg_media, toxicity, warc
from corpusmill.llm.scratch import materialize, small_batches
from corpusmill.session import spread

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    small_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.collapse_and_render(table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, from models of the documents that are not held out."""
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    out = language_id.identify(documents, language_id.train(documents))
    return out.select("doc_id", (language_id.id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file, and what is read back from the stored table."""
    small_batches(spark)
    return ogg_media.read_media(materialize(ogg_media.write_media(table(spark, sf_dir, "documents")), "media"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = kd_sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the public multilingual ranks."""
    import public_tokenizers

    small_batches(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the model of the documents that are not held out."""
    small_batches(spark)
    held_out = language_id.id_crc("doc_id") % 5 == 1
    out = hpylm.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    small_batches(spark)
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard archives and read back from them."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    archives = materialize(warc.write_archives(warc.mark_revisits(pages), warc.train_dictionary(pages)), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, from labels of the documents that are not held out."""
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    out = toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (language_id.id_crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bagminhash_dedup": op1_bagminhash_dedup,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_language_id": op3_language_id,
    "op4_ogg_media": op4_ogg_media,
    "op5_kd_shards": op5_kd_shards,
    "op6_bpe": op6_bpe,
    "op7_hpylm": op7_hpylm,
    "op8_decontamination": op8_decontamination,
    "op9_warc_zstd": op9_warc_zstd,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_snapshots": chat_format.ORACLE_SQL,
    "op8_decontamination": decontaminate.ORACLE_SQL,
    "op9_warc_zstd": warc.ORACLE_SQL,
}
