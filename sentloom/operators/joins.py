"""Joins against word tables and clip features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.session import materialize

# Keys sent to every executor, with about what a hashed one takes beside its own bytes.
MAX_KEY_BYTES = 64 << 20
KEY_BYTES = 32


def salted_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread: list[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join many ``facts`` rows to a ``table`` with one row per ``key``.

    Frequent keys (common words, popular clips) are spread over ``salts`` tasks: each fact
    takes a salt from its own ``spread`` columns, each table row is copied once per salt.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def split_hot(
    asks: DataFrame, table: DataFrame, key: str, spread: list[str], rows_per_task: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_chunk``, for a grouped or plain join by (key, _chunk): asks of one
    key go to as many chunks as they have runs of ``rows_per_task`` rows, and the key's rows of
    ``table`` are copied once per chunk; keys nobody asks for are left out. ``asks`` is read
    twice, so it should be stored."""
    counts = asks.groupBy(key).agg(F.ceil(F.count("*") / rows_per_task).alias("_chunks"))
    hot = counts.filter("_chunks > 1").withColumnRenamed(key, "_hot")
    # Fewer keys than rows / rows_per_task are hot.
    left = asks.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_chunk", F.pmod(F.xxhash64(*spread), F.coalesce("_chunks", F.lit(1).cast("bigint")))
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))
    right = table.join(counts, key).withColumn("_chunk", every).drop("_chunks")
    return left.drop("_hot", "_chunks"), right


def with_key(df: DataFrame, table: DataFrame, key: str, max_bytes: int = MAX_KEY_BYTES) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``table``. Different keys of up to ``max_bytes`` are sent to the
    rows, which are filtered where they are; a wide table doesn't show Spark that its keys are few.
    More keys are joined, with a shuffle of both sides. ``table`` is read once."""
    keys = materialize(table.select(key).filter(F.col(key).isNotNull()).distinct())
    size = F.octet_length(F.col(key).cast("string")) + KEY_BYTES
    if (keys.agg(F.sum(size)).first()[0] or 0) <= max_bytes:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_semi")


def caption_features(captions: DataFrame, features: DataFrame, key: str = "clip_id") -> DataFrame:
    """Captions with the feature of their clip; a caption without feature is left out.

    Features are wide, captions narrow: the plain equi-join lets Spark pick the side to
    broadcast by size and split skewed clips at run time.
    """
    return captions.join(features, key, "inner")
