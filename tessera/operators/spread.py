"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its scan has fewer splits than there are cores, as with one small file. Large
    tables have more splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def widened(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as a shuffle has, for work that is heavy for few bytes, which adaptive coalescing goes by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
