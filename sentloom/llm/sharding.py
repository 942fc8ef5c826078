"""Proportional stratified interleaving, in DataFrame functions only.

Rows of each stratum (a source) are shuffled by a seeded hash and ranked; the rank's fraction of
the stratum's size, with a phase of the stratum's own, puts all strata on one scale, on which every interval has each stratum in
proportion. Sorted by it and cut into equal runs, every shard has the mixture of the whole.

Both ranks are exact without a sort of a stratum or of the table in one task: rows fall into
fixed buckets by the leading part of their sort key, bucket counts give offsets, and a window ranks
inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentloom.session import materialize

#: Buckets of either rank: 16^3 leading hash digits, as many intervals of the fraction.
BUCKETS = 4096
SEED = "shard-1"


def stratified_shards(
    rows: DataFrame, strata: str, key: str, n_shards: int, seed: str = SEED, ties: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (gapless from 0 in each shard); shards' row counts
    differ by one at most. Keep ``rows`` narrow: they are shuffled twice.

    Null strata are a stratum of their own, null keys are a key like others. Rows with equal keys
    are told apart by ``ties``; rows that are equal there too are interchangeable, and any order of
    them is the same result. Columns named ``shard`` or ``slot`` in any case are replaced, and those that
    start with an underscore are left out. An empty table gives no rows.
    """
    taken = {"shard", "slot"}
    columns = [c for c in rows.columns if c.lower() not in taken and not c.startswith("_")]
    keyed = rows.select(
        *columns,
        F.when(F.col(strata).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(strata).cast("string"))).alias("_stratum"),
        # Ties are part of the hash, so the rows of one key go to many buckets.
        F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key, *ties)])).alias("_hash"),
    ).withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    group = ["_stratum", "_bucket"]
    before = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_stratum")
    offsets = (
        keyed.groupBy(*group).agg(F.count("*").alias("_n"))
        .select(
            *group,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("_size"),
        )
    )
    inside = Window.partitionBy(*group).orderBy("_hash", *ties)
    rank = F.col("_before") + F.col("_in")
    # Each stratum has a phase of its own in (0, 1): small strata are spread over the whole scale.
    phase = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_stratum")), 1, 8), 16, 10).cast("double") + 0.5) / (1 << 32)
    ranked = (
        keyed.withColumn("_in", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn("_fraction", (rank - 1 + phase) / F.col("_size"))
        .select(*columns, "_stratum", "_fraction", F.least(F.floor(F.col("_fraction") * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("_bucket"))
    )
    ranked = materialize(ranked)
    # One row per bucket: BUCKETS at most, so windows over all of them are small.
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        ranked.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"),
                F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    )
    order = Window.partitionBy("_bucket").orderBy("_fraction", F.md5("_stratum"), "_stratum")
    place = F.col("_before") + F.col("_in") - 1
    start = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    return (
        ranked.withColumn("_in", F.row_number().over(order).cast("bigint"))
        .join(F.broadcast(places), "_bucket")
        .withColumn("_place", place)
        .withColumn("shard", F.expr(f"(_place * {n_shards}) div _total"))
        .withColumn("slot", F.col("_place") - start)
        .select(*columns, F.col("shard").cast("int").alias("shard"), "slot")
    )


def document_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (UTF-8 bytes of the text and one), ``text_crc32``, ``shard``
    and ``slot`` per row of ``docs``; a null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return stratified_shards(rows, "source", "doc_id", n_shards, ties=("text_crc32", "size"))
