"""Loss values as evaluation metrics over batches of paired vectors.

Input is a table (``batch``, ``row``, x, y) from :func:`sentloom.operators.rank.assign_batches`,
which bounds a batch to ``batch_size`` rows; that bound is what allows one dense product per
batch. Each metric gives one row per batch; :func:`mean_over_batches` reduces it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentloom.functions.vectors import NORM_EPSILON, softplus
from sentloom.operators.dense import layers, project

ALIGNMENTS = ("rho", "L2", "L1")


def _stack(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), NORM_EPSILON))


def _ranking(x: np.ndarray, y: np.ndarray, nb_neg: int = 10, margin: float = 0.5) -> float | None:
    kept = len(x) - nb_neg
    if kept <= 0:
        return None
    a, b = _unit(x), _unit(y)
    match = (a[:kept] * b[:kept]).sum(axis=1, keepdims=True)
    gaps = [b[:kept] @ a[kept:].T, a[:kept] @ b[kept:].T]
    per_row = sum(np.maximum(margin - match + g, 0.0).sum(axis=1) for g in gaps)
    return float(per_row.mean() / 2)


def _element_l2(x: np.ndarray, y: np.ndarray) -> float:
    return float(((x - y) ** 2).mean())


def _alignment(x: np.ndarray, y: np.ndarray, kind: str = "rho") -> float | None:
    a, b = _unit(x), _unit(y)
    sims = [m - m.mean() for m in (a @ a.T, b @ b.T)]
    if kind == "L2":
        return float(((sims[0] - sims[1]) ** 2).mean())
    if kind == "L1":
        return float(np.abs(sims[0] - sims[1]).mean())
    spread = np.sqrt((sims[0] ** 2).mean() * (sims[1] ** 2).mean())
    return float(-(sims[0] * sims[1]).mean() / spread) if spread else None


def _contrast(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) % 2:
        raise ValueError("batch of odd size")
    match = (x * y).sum(axis=1)
    other = (x * np.roll(y, len(y) // 2, axis=0)).sum(axis=1)
    return float(np.logaddexp(0.0, other - match).mean())


#: Metric: its kernel and the sides that are projected first.
METRICS = {
    "ranking": (_ranking, ""),
    "rho": (_alignment, ""),
    "l2": (_element_l2, ""),
    "quick": (_contrast, ""),
    "ranking_f": (_ranking, "x"),
    "rho_f": (_alignment, "x"),
    "l2_f": (_element_l2, "x"),
    "quick_f": (_contrast, "x"),
    "ranking_both": (_ranking, "xy"),
}


def _kernels(df: DataFrame, kernels: dict, weights: tuple | None = None) -> DataFrame:
    """(batch, n, metric, value): every (kernel, projected sides) on each batch, its rows in
    order. One shuffle for all of them."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    schema = "batch bigint, n bigint, metric string, value double"

    def apply(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        plain = {"x": _stack(rows["x"]), "y": _stack(rows["y"])}
        used = set("".join(sides for _, sides in kernels.values()))
        mapped = {side: layers(plain[side], *shared.value) for side in used}
        values = [
            kernel(*[(mapped if side in sides else plain)[side] for side in "xy"])
            for kernel, sides in kernels.values()
        ]
        return pa.table(
            {
                "batch": pa.array([key[0].as_py()] * len(kernels), pa.int64()),
                "n": pa.array([len(rows)] * len(kernels), pa.int64()),
                "metric": pa.array(list(kernels), pa.string()),
                "value": pa.array(values, pa.float64()),
            }
        )

    return df.select("batch", "row", "x", "y").groupBy("batch").applyInArrow(apply, schema)


def _per_batch(df: DataFrame, kernel) -> DataFrame:
    return _kernels(df, {"": (kernel, "")}).drop("metric")


def batch_metrics(df: DataFrame, names: list[str], weights: tuple | None = None) -> DataFrame:
    """(batch, n, metric, value) for the named :data:`METRICS`, all in one pass.

    Projected ones need ``weights`` (W1, b1[, W2, b2]).
    """
    if unknown := set(names) - set(METRICS):
        raise ValueError(f"metrics must be among {list(METRICS)}, not {sorted(unknown)}")
    chosen = {name: METRICS[name] for name in names}
    if weights is None and any(sides for _, sides in chosen.values()):
        raise ValueError("a projected metric needs weights")
    return _kernels(df, chosen, weights)


def mean_over_batches(losses: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value): each metric's mean over its batches; NULL without a batch."""
    means = [
        F.struct(
            F.lit(name).alias("metric"),
            F.avg(F.when(F.col("metric") == name, F.col("value"))).alias("value"),
        )
        for name in names
    ]
    return losses.agg(F.array(*means).alias("_means")).select(F.inline("_means"))


def batch_negatives(df: DataFrame, nb_neg: int = 10) -> DataFrame:
    """Last ``nb_neg`` rows of each batch, which serve all its other rows as negatives.

    Adds ``negative`` (whether the row is one of them).
    """
    size = F.max("row").over(Window.partitionBy("batch")) + 1
    return df.withColumn("negative", F.col("row") >= size - nb_neg)


def ranking_loss(df: DataFrame, nb_neg: int = 10, margin: float = 0.5) -> DataFrame:
    """Max-margin ranking of matching pairs against in-batch negatives, on unit vectors.

    NULL for a batch with no row left beside its negatives.
    """

    return _per_batch(df, partial(_ranking, nb_neg=nb_neg, margin=margin))


def projected(df: DataFrame, weights: tuple, side: str = "x") -> DataFrame:
    """The pairs with one side mapped by (W1, b1[, W2, b2])."""
    return project(df, *weights, v=side, out=side)


def element_l2(df: DataFrame) -> DataFrame:
    """Mean squared difference over all elements of a batch's vectors."""
    return _per_batch(df, _element_l2)


def structure_alignment(df: DataFrame, kind: str = "rho") -> DataFrame:
    """How alike the two spaces' similarity structures are, over all ordered pairs of a batch.

    ``rho``: minus the Pearson correlation of the cosines; ``L2`` and ``L1``: mean squared and
    mean absolute difference of the centred cosines.
    """
    if kind not in ALIGNMENTS:
        raise ValueError(f"kind must be one of {ALIGNMENTS}, not {kind!r}")
    return _per_batch(df, partial(_alignment, kind=kind))


def match_pairs(df: DataFrame) -> DataFrame:
    """(batch, row, x, y, label): each pair (1) and x with the y half a batch away (0).

    The halves of a batch swap partners; a batch of odd size has no halves and is an error.
    """
    size = F.max("row").over(Window.partitionBy("batch")) + 1
    half = F.floor(F.col("_size") / 2).cast("int")
    slot = Window.partitionBy("batch", "_slot").orderBy("row")
    other = F.coalesce(F.lag("y").over(slot), F.lead("y").over(slot))
    even = F.when(F.col("_size") % 2 == 0, F.col("row") % half)
    return (
        df.select("batch", "row", "x", "y", size.alias("_size"))
        .withColumn(
            "_slot", F.coalesce(even, F.raise_error(F.lit("batch of odd size")).cast("int"))
        )
        .withColumn("_other", other)
        .select(
            "batch",
            "row",
            "x",
            F.inline(
                F.array(
                    F.struct(F.col("y"), F.lit(1).alias("label")),
                    F.struct(F.col("_other").alias("y"), F.lit(0).alias("label")),
                )
            ),
        )
    )


def contrast_scores(df: DataFrame) -> DataFrame:
    """(batch, n, value): cross entropy of the matched against the mismatched dot product.

    Each of the four orderings of a pair of scores has the same loss as its mirror image, so
    every row counts once for both.
    """
    return _per_batch(df, _contrast)


def match_classifier(df: DataFrame, w1, b1, w2, b2) -> DataFrame:
    """(batch, n, value): cross entropy of a two-layer classifier, matched against mismatched."""
    both = match_pairs(df).select(
        "batch", "row", "label", F.concat("x", "y").alias("_pair")
    )
    logits = project(both, w1, b1, w2, b2, v="_pair", out="_logits")
    zero, one = F.get("_logits", F.lit(0)), F.get("_logits", F.lit(1))
    wrong_minus_right = F.when(F.col("label") == 1, zero - one).otherwise(one - zero)
    return logits.groupBy("batch").agg(
        F.count("*").alias("n"), F.avg(softplus(wrong_minus_right)).alias("value")
    )


def weighted_total(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: sum of weight * value over the metrics with a weight above zero."""
    weight: Column = F.lit(None).cast("double")
    for name, w in weights.items():
        if w > 0:
            weight = F.when(F.col("metric") == name, F.lit(float(w))).otherwise(weight)
    return metrics.agg(F.sum(weight * F.col("value")).alias("total"))
