"""Evaluation jobs over train or validation batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.operators.losses import METRICS, batch_metrics, mean_over_batches, weighted_total


def pair_metrics(
    batched: DataFrame, weights: tuple | None = None, names: list[str] | None = None
) -> DataFrame:
    """(metric, value) over batches of paired vectors, from one pass over the batches.

    By default all metrics; those on projected vectors only with ``weights``.
    """
    if names is None:
        names = [name for name, (_, sides) in METRICS.items() if weights is not None or not sides]
    return mean_over_batches(batch_metrics(batched, names, weights), names)


def total_loss(
    batched: DataFrame, weights: dict[str, float], projection: tuple | None = None
) -> DataFrame:
    """Weighted sum of the metrics with a weight above zero; no other is computed."""
    names = [name for name, weight in weights.items() if weight > 0]
    return weighted_total(pair_metrics(batched, projection, names), weights)


def split_metrics(train: DataFrame, validation: DataFrame) -> DataFrame:
    """The same metrics on both splits: (split, metric, value)."""
    parts = [
        pair_metrics(df).select(F.lit(name).alias("split"), "metric", "value")
        for name, df in (("train", train), ("validation", validation))
    ]
    return parts[0].unionByName(parts[1])
