"""Running byte statistics of a stream of documents, kept by a checkpointed query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.binary import utf8


def running_totals(documents: DataFrame, group: str = "source", text_col: str = "text") -> DataFrame:
    """(group, docs, bytes, longest) of a static or streaming table: partial sums per task, then one row of state per group."""
    size = F.octet_length(utf8(F.col(text_col))).cast("bigint")
    return documents.groupBy(group).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("bytes"), F.max(size).alias("longest"))


def drain(spark: SparkSession, path: str, name: str, checkpoint: str, files_per_trigger: int = 8) -> DataFrame:
    """Run the totals over all files now under `path`, a few per trigger, resuming where the checkpoint stands; the final table."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern may stand for one file as well as for a folder of them
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    query = running_totals(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
