"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentloom.session import materialize

#: A key with more than one row in HOT_SHARE counts as hot, so there are fewer than HOT_SHARE.
HOT_SHARE = 1000
#: Texts handled at once inside an Arrow function, in bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that a lambda uses may be inlined by the optimizer and computed again for each
    element; a lambda's own variable never is.
    """
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, count: str, spread: str
) -> DataFrame:
    """Left join with a ``right`` of one row per ``key``; ``count`` says how many rows of ``left``
    have it, ``spread`` names a column of ``left`` with many values. No hot key meets in one task.

    By counting, fewer than ``HOT_SHARE`` keys can have over one in ``HOT_SHARE`` of the rows.
    Those keys' rows of ``right`` are broadcast; their rows of ``left``, and those of no key, go
    through the shuffle under a key of no match, dealt out by ``spread``.
    """
    found = [c for c in right.columns if c not in (key, count)]
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.filter(F.col(count) * HOT_SHARE > total).select(
        F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in found]
    )
    cold = right.select(
        F.struct(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("salt")).alias("_lookup"),
        *[F.col(c).alias(f"_cold_{c}") for c in found],
    )
    matched = F.col("_hot").isNull() & F.col(key).isNotNull()
    elsewhere = F.xxhash64(spread, F.spark_partition_id()).bitwiseOR(F.lit(1).cast("bigint"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_dealt",
        F.struct(
            F.col(key).alias("key"),
            F.when(matched, F.lit(0).cast("bigint")).otherwise(elsewhere).alias("salt"),
        ),
    )
    joined = marked.join(cold, F.col("_dealt") == F.col("_lookup"), "left")
    return joined.select(
        *left.columns,
        *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in found],
    )


def hash_sample(rows: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """One row (columns ``hash`` and any others) for each of the ``n`` least different hashes, or of the
    ``n`` least of each value of ``by``: a sample of bounded size, the same on every cluster. Rows of
    one hash must be equal. Only hashes are sorted; the rows are fetched by them."""
    keys = ["hash", *([by] if by else [])]
    hashes = rows.select(*keys).distinct()
    if by:
        place = F.row_number().over(Window.partitionBy(by).orderBy("hash"))
        first = hashes.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    else:
        first = hashes.orderBy("hash").limit(n)
    return rows.join(F.broadcast(materialize(first)), keys).dropDuplicates(keys)


def slices(batch: pa.RecordBatch, column: str | int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about ``SLICE_BYTES``, each with its texts as UTF-8 (null: empty)."""
    values = batch.column(column)
    texts = values.cast(
        pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    )
    at = size = 0
    part: list[bytes] = []
    for i in range(batch.num_rows):
        text = texts[i].as_py() or b""
        part.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield batch.slice(at, len(part)), part
            at, size, part = i + 1, 0, []
    if part:
        yield batch.slice(at, len(part)), part
