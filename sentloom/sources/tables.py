"""Parquet tables as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` when the scan has fewer splits than the session has cores.

    A table in one unsplittable file would keep all row-wise work (parsing, tokenising) in one
    task. A table of many splits comes back as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def read_texts(
    spark: SparkSession, path: str, key: str | list[str], columns: list[str]
) -> DataFrame:
    """Selected columns of a table of texts, with enough partitions for the row-wise work."""
    keys = [key] if isinstance(key, str) else key
    return spread(spark.read.parquet(path).select(*keys, *columns), *keys)
