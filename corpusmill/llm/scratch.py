"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import shared_folder

ARROW_ROWS = 512
#: Shuffle files of a query that is written go when it ends, not when the driver collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there.

    An executor that is lost afterwards costs a re-read, not a re-computation, and what
    a sampling or ordering step decided stays decided. by: a column whose values get a folder each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._scratch_path = path  # noqa: SLF001
    return again


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch: with long texts the default of 10,000 rows is gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filter_by_text(documents: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, all their columns, for whose texts `keep` says so; it is given one Arrow column at a time. No shuffle."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
