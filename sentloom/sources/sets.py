"""Sharded record sets that become visible as a whole.

A set is written to a folder of its own. Only when all its shards are there does a manifest, one small
file, name that folder and list each shard with its rows and a checksum. Readers go by the latest
manifest, so they never see half a set, and a write that fails leaves the set before it in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentloom.schemas import RECORDS
from sentloom.session import scratch
from sentloom.sources.sinks import write_splits

SPLITS = ("train", "validation")
_MANIFEST = "folder string, kind string, split string, shard string, n_rows bigint, checksum bigint, version bigint"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(folder, kind, split, shard, n_rows, checksum, version) of all sets committed below ``path``."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the latest set, a row per shard; an error if there is none."""
    found = manifests(spark, path)
    version = found.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError(f"no committed set below {path}")
    return found.filter(F.col("version") == version)


def _shards(spark: SparkSession, folder: str, kind: str, split: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RECORDS[kind])
    return spark.read.schema(f"{fields}, shard string").parquet(f"{folder}/{split}")


def _checksum(kind: str) -> Column:
    """The same for any order of the rows; sums of 32-bit hashes don't overflow."""
    return F.sum(F.shiftrightunsigned(F.xxhash64(*[f.name for f in RECORDS[kind]]), 32))


def _counted(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    parts = [
        _shards(spark, folder, kind, split).groupBy("shard")
        .agg(F.count("*").alias("n_rows"), _checksum(kind).alias("checksum"))
        .select(F.lit(split).alias("split"), "shard", "n_rows", "checksum")
        for split in SPLITS
    ]
    return parts[0].unionByName(parts[1])


def write_set(records: DataFrame, path: str, kind: str, *id_cols: str, **split) -> DataFrame:
    """Write records as train and validation shards below ``path`` and commit them; ``split`` are the
    options of ``write_splits``. Returns the set's manifest.

    Of two writers at once the later one fails at its manifest, whose number is then taken.
    """
    spark = records.sparkSession
    before = manifests(spark, path).agg(F.max("version")).first()[0]
    folder, version = f"{path}/set-{uuid.uuid4().hex}", (before or 0) + 1
    with scratch(spark):
        write_splits(records, folder, kind, *id_cols, **split)
    rows = _counted(spark, folder, kind).select(F.lit(folder).alias("folder"), F.lit(kind).alias("kind"), "*")
    # One row per shard, in one file: it is there or it is not.
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/version={version}")
    return latest(spark, path)


def read_set(spark: SparkSession, path: str, split: str, verify: bool = False) -> DataFrame:
    """The records of one split of the latest set. ``verify`` reads them once more beforehand and
    compares rows and checksums of all shards with the manifest."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    manifest = latest(spark, path)
    about = manifest.select("folder", "kind").first()
    if verify:
        wanted = manifest.select("split", "shard", "n_rows", "checksum")
        there = _counted(spark, about.folder, about.kind)
        wrong = wanted.exceptAll(there).unionAll(there.exceptAll(wanted))
        if not wrong.isEmpty():
            raise ValueError(f"shards differ from their manifest: {[r.shard for r in wrong.limit(5).collect()]}")
    return _shards(spark, about.folder, about.kind, split).drop("shard")
