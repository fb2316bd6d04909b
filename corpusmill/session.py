"""Folders that the driver and all executors share, and scans that keep all cores busy."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer parts than half the cores (say, a file of one row group) dealt out over the cores; others as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan
