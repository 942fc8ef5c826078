"""Global rank, seeded order, split, shards, batches.

None of these sends the data through one task: a window without partition runs only over the
per-bucket counts, whose number is bounded.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentloom.session import materialize, remove

# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1
# Buckets of a hashed order: the first 16 bits of the key.
_BUCKETS = 1 << 16
# Up to this many rows a sorted limit is cheaper than a global rank.
SMALL_LIMIT = 10_000


def shuffle_key(seed: int, *cols: Column | str) -> Column:
    """Reproducible pseudo-random order key: the same for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def _offsets(counts: DataFrame, by: str) -> DataFrame:
    """(bucket, count) → rows before the bucket, and rows in all."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(by).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return counts.select(
        by,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_n").over(every).alias("_rows_total"),
    )


def _div(value: Column, by: Column | int) -> Column:
    """Whole-number quotient, exact for large numbers."""
    return ((value - value % by) / by).cast("bigint")


def ranked(
    df: DataFrame, *keys: str, name: str = "rank", total: str | None = None, whole: bool = False
) -> DataFrame:
    """0-based rank of every row in the order of ``keys``: columns of any orderable types that
    together are unique; NULL is a value like others and comes first.

    Only the keys are sorted, by range, over all tasks. They are stored first, since the sample for the
    range borders reads them a second time and ``df`` can be costly to compute, and again when sorted,
    because the borders must be the same for the counts and for the ranks; the broadcast side has one row per partition. The other columns, which can be wide and costly
    to compute, are computed once and meet their rank in an equi-join on the unique keys.

    ``whole`` is for narrow rows: they are stored and sorted with all their columns, and no join follows.
    Rows of neighbouring keys stay side by side, so what they share takes no room in a shuffle. Rows whose
    keys repeat go by the join.
    """
    if whole:
        df = materialize(df)
        whole = df.groupBy(*keys).count().filter("count > 1").isEmpty()
    placed = materialize(
        (df if whole else materialize(df.select(*keys)))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    if whole:
        remove(df)
    part = F.shiftright("_row", _ROW_BITS).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    ranks = (
        placed.withColumn("_part", part)
        .join(F.broadcast(_offsets(counts, "_part")), "_part")
        .withColumn(name, F.col("_rows_before") + F.col("_row").bitwiseAND(F.lit(_ROW_MASK)))
    )
    extra = [F.col("_rows_total").alias(total)] if total else []
    if whole:
        return ranks.select(*df.columns, name, *extra)
    ranks = ranks.select(*keys, name, *extra)
    if not set(df.columns) - set(keys):
        return ranks
    renamed = ranks.withColumnsRenamed({k: f"_ranked_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_ranked_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"_ranked_{k}" for k in keys])


def hash_ranked(
    df: DataFrame, key: str, *ties: str, name: str = "rank", total: str | None = None
) -> DataFrame:
    """0-based rank by a hexadecimal hash column such as :func:`shuffle_key`.

    The key's first bits are a bucket that rows keep in every run, and hashing spreads rows
    evenly, so no sampling and no stored copy is needed: bucket counts (at most 65,536 rows,
    broadcast) give the start of each bucket, one shuffle by bucket gives the place inside.
    """
    bucket = F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("_bucket")
    counts = df.select(bucket).groupBy("_bucket").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_bucket").orderBy(key, *ties)
    out = (
        df.withColumn("_bucket", bucket)
        .withColumn("_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(_offsets(counts, "_bucket")), "_bucket")
        .withColumn(name, F.col("_rows_before") + F.col("_inside"))
    )
    if total:
        out = out.withColumn(total, F.col("_rows_total"))
    return out.drop("_bucket", "_inside", "_rows_before", "_rows_total")


def limit_ordered(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``; all rows for ``n`` = 0."""
    if not n:
        return df
    if n <= SMALL_LIMIT:
        return df.orderBy(*keys).limit(n)
    return ranked(df, *keys, name="_rank").filter(F.col("_rank") < n).drop("_rank")


def split_by_count(df: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """Column ``split``: ``validation`` for the first ``n`` rows by ``key``, else ``train``.

    ``key`` is a hexadecimal hash and (``key``, ``ties``) is unique. The rows are only
    filtered against one bound; they are not moved. Bucket counts say in which bucket the
    ``n``-th row lies, and only that bucket (1/65,536 of the rows) is sorted for it.
    """
    bucket = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    order = F.struct(key, *ties)
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    cut = (
        _offsets(counts, "_bucket")
        .filter(F.col("_rows_before") < n)
        .agg(F.max(F.struct("_bucket", "_rows_before")).alias("_cut"))
    )
    last = (
        df.select(bucket.alias("_bucket"), order.alias("_order"))
        .join(F.broadcast(cut), F.col("_bucket") == F.col("_cut._bucket"))
        .withColumn("_i", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")))
        .filter(F.col("_i") <= n - F.col("_cut._rows_before"))
        .agg(F.max("_order").alias("_last"))
    )
    return df.withColumn(
        "split",
        F.when(order <= last.scalar(), F.lit("validation")).otherwise(F.lit("train")),
    )


def shard_of(rank: Column, total: Column, n_shards: int) -> Column:
    """Shard whose range ``[i*N div S, (i+1)*N div S)`` holds the rank."""
    return _div((rank + 1) * n_shards - 1, total).cast("int")


def assign_shards(
    df: DataFrame,
    *id_cols: str,
    seed: int = 123,
    n_validation: int = 50_000,
    train_shards: int = 100,
    validation_shards: int = 1,
) -> DataFrame:
    """Seeded order, split by count and shard number in one shuffle.

    Adds ``split``, ``rank`` (inside the split) and ``shard``.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, *id_cols))
    rows = hash_ranked(keyed, "_key", *id_cols, name="_rank", total="_all").drop("_key")
    held = F.col("_rank") < n_validation
    validation = F.least(F.col("_all"), F.lit(n_validation))
    rank = F.when(held, F.col("_rank")).otherwise(F.col("_rank") - n_validation)
    return (
        rows.withColumn("split", F.when(held, F.lit("validation")).otherwise(F.lit("train")))
        .withColumn("rank", rank)
        .withColumn(
            "shard",
            F.when(held, shard_of(rank, validation, validation_shards)).otherwise(
                shard_of(rank, F.col("_all") - validation, train_shards)
            ),
        )
        .drop("_rank", "_all")
    )


def assign_batches(df: DataFrame, batch_size: int, *keys: str, whole: bool = False) -> DataFrame:
    """Consecutive groups of ``batch_size`` rows: columns ``batch`` and ``row`` (inside it). ``whole`` as in
    :func:`ranked`."""
    return (
        ranked(df, *keys, name="_rank", whole=whole)
        .withColumn("batch", _div(F.col("_rank"), batch_size))
        .withColumn("row", (F.col("_rank") % batch_size).cast("int"))
        .drop("_rank")
    )


def permute_features(df: DataFrame, id_col: str, value: str, seed: int = 123) -> DataFrame:
    """Random-feature baseline: the ids keep their order, the values are permuted."""
    ids = ranked(df.select(id_col), id_col, name="_rank")
    values = hash_ranked(
        df.select(shuffle_key(seed, id_col).alias("_key"), F.col(id_col).alias("_id"), value),
        "_key",
        "_id",
        name="_rank",
    )
    return ids.join(values.select("_rank", value), "_rank").drop("_rank")


def positional_join(
    left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]
) -> DataFrame:
    """i-th row of ``left`` with i-th row of ``right``."""
    a = ranked(left, *left_keys, name="position")
    b = ranked(right, *right_keys, name="position")
    return a.join(b, "position")
