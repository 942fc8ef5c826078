"""Sinks: shards, vocabularies, word counts, expanded vocabularies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.operators.rank import assign_shards, hash_ranked, shard_of, shuffle_key
from sentloom.schemas import RECORDS
from sentloom.session import checkpoint_root, materialize


def to_records(df: DataFrame, kind: str, *keep: str) -> DataFrame:
    """The typed fields of a record kind, and the columns to keep beside them."""
    if kind not in RECORDS:
        raise ValueError(f"kind must be one of {sorted(RECORDS)}, not {kind!r}")
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS[kind]]
    return df.select(*fields, *keep)


def write_shards(
    df: DataFrame,
    path: str,
    name: str,
    n_shards: int,
    shard: str = "shard",
    rank: str = "rank",
    rows_per_file: int = 5_000_000,
) -> None:
    """Write rows with ``shard`` and ``rank`` as ``shard=name-00000-of-00100`` folders.

    A shard is written by as many tasks as it has runs of ``rows_per_file`` ranks, each task
    one run in rank order.
    """
    folder = F.format_string(f"{name}-%05d-of-{n_shards:05d}", F.col(shard))
    (
        df.repartition(shard, F.floor(F.col(rank) / rows_per_file))
        .sortWithinPartitions(shard, rank)
        .withColumn(shard, folder)
        .write.mode("overwrite")
        .partitionBy(shard)
        .parquet(path)
    )


def shards(df: DataFrame, n_shards: int, *id_cols: str, seed: int = 123) -> DataFrame:
    """Adds ``rank`` in the seeded order and the ``shard`` that holds it."""
    keyed = df.withColumn("_key", shuffle_key(seed, *id_cols))
    rows = hash_ranked(keyed, "_key", *id_cols, name="rank", total="_total")
    return rows.withColumn("shard", shard_of(F.col("rank"), F.col("_total"), n_shards)).drop(
        "_key", "_total"
    )


def write_splits(
    records: DataFrame,
    path: str,
    kind: str,
    *id_cols: str,
    n_validation: int = 50_000,
    train_shards: int = 100,
    validation_shards: int = 1,
    seed: int = 123,
) -> None:
    """Records in seeded order, split by count, as ``train`` and ``validation`` shards. They are
    stored before they are ranked, since ranking reads them twice."""
    placed = materialize(
        to_records(
            assign_shards(
                materialize(records),
                *id_cols,
                seed=seed,
                n_validation=n_validation,
                train_shards=train_shards,
                validation_shards=validation_shards,
            ),
            kind,
            "split",
            "rank",
            "shard",
        )
    )
    for split, n in (("train", train_shards), ("validation", validation_shards)):
        part = placed.filter(F.col("split") == split).drop("split")
        write_shards(part, f"{path}/{split}", split, n)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """(word, id) in id order."""
    vocab.select("word", "id").orderBy("id").write.mode("overwrite").parquet(path)


def write_word_counts(counts: DataFrame, path: str) -> None:
    """All words with their counts, most frequent first; sorted by range, over many files."""
    counts.orderBy(F.desc("n"), "word").write.mode("overwrite").parquet(path)


def write_expanded(expanded: DataFrame, path: str) -> None:
    """(pos, word, v), words and vectors in one order."""
    expanded.select("pos", "word", "v").orderBy("pos").write.mode("overwrite").parquet(path)


def store_bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` stored in the shared folder in ``buckets`` of ``key`` (as many as shuffle partitions by
    default), sorted by it, and read back. Joins and groups by ``key`` don't shuffle it again;
    worth it for a wide table, such as features, that several jobs join."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (
        df.repartition(n, key).write.format("parquet")
        .option("path", f"{checkpoint_root(spark).rstrip('/')}/{name}")
        .bucketBy(n, key).sortBy(key).saveAsTable(name)
    )
    return spark.table(name)
