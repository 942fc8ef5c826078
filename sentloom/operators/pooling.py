"""Vector sums and means per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks over which the partial sums of a frequent group are spread.
_SALTS = 32


def _add_up(batches):
    """Arrow batches of (key, n, total) → one row per key and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        codes = keys.indices.to_numpy(zero_copy_only=False)
        totals = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        totals = totals.reshape(batch.num_rows, -1)
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        sums = np.add.reduceat(totals[order], first, axis=0, dtype=np.float64)
        counts = np.add.reduceat(batch.column(1).to_numpy()[order], first)
        offsets = np.arange(len(first) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                keys.dictionary,
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel())),
            ],
            names=batch.schema.names,
        )


def vector_sums(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, n, total): number of rows and element-wise sum of ``v`` per group.

    Vectors stay dense arrays. A map task adds up what its Arrow batches hold of a group, so a
    hot group shrinks to one row per batch there. All rows are spread over salts; after the
    shuffle each task adds up again, batch by batch, without ever holding a group, and a
    second shuffle by key alone brings the salts' sums together the same way. What is left per
    group is a row per Arrow batch of these few.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("n", T.LongType()),
            T.StructField("total", T.ArrayType(T.DoubleType())),
        ]
    )
    rows = df.filter(F.col(v).isNotNull() & F.col(key).isNotNull()).select(
        key, F.lit(1).cast("bigint").alias("n"), F.col(v).alias("total")
    )
    # By row and not by value: equal partial sums of a hot group go apart too.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS))
    parts = (
        rows.mapInArrow(_add_up, schema)
        .withColumn("_salt", salt)
        .repartition(key, "_salt")
        .sortWithinPartitions(key)
        .select(key, "n", "total")
        .mapInArrow(_add_up, schema)
        .repartition(key)
        .sortWithinPartitions(key)
        .mapInArrow(_add_up, schema)
    )
    lists = parts.groupBy(key).agg(
        F.sum("n").alias("n"), F.collect_list("total").alias("_totals")
    )
    total = F.aggregate(
        F.slice("_totals", F.lit(2), F.size("_totals")),
        F.get("_totals", F.lit(0)),
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return lists.select(key, "n", total.alias("total"))


def mean_vectors(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, n, v): mean vector per group, for instance of the frames of a clip."""
    sums = vector_sums(df, key, v)
    n = F.col("n")
    return sums.select(key, "n", F.transform("total", lambda x: x / n).alias("v"))
