"""Vocabulary expansion: a least-squares map from a large word space into the own space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.functions.vectors import NORM_EPSILON
from sentloom.operators.dense import project
from sentloom.operators.rank import ranked
from sentloom.session import materialize


def paired_spaces(large: DataFrame, own: DataFrame) -> DataFrame:
    """(word, x, y) for the words both tables have: x from the large space, y the own vector."""
    return large.select("word", F.col("v").alias("x")).join(
        own.select("word", F.col("v").alias("y")), "word"
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), NORM_EPSILON))


_SUMS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
#: Tasks whose sums are first added up together.
FAN_IN = 32


# What each kind of sum adds up, per dense block of rows.
_KINDS = {
    "n": lambda x, y: np.array([[float(len(x))]]),
    "x": lambda x, y: x.sum(axis=0)[:, None],
    "y": lambda x, y: y.sum(axis=0)[:, None],
    "xx": lambda x, y: x.T @ x,
    "xy": lambda x, y: x.T @ y,
    "yy": lambda x, y: y.T @ y,
}


def gram_sums(
    pairs: DataFrame,
    kinds: tuple[str, ...] = ("n", "x", "y", "xx", "xy"),
    centre: tuple | None = None,
    unit: bool = False,
) -> DataFrame:
    """(kind, i, j, value): sums over all rows of a table of (x, y) vector pairs.

    Kinds: ``n`` (row count), ``x`` and ``y`` (vector sums), ``xx``, ``xy`` and ``yy``
    (products such as x_i*y_j). ``centre`` is subtracted first if given; ``unit`` divides by the
    length. One dense product per Arrow batch, added up inside the task; a task sends one row per
    matrix row. Rows of up to ``FAN_IN`` tasks are added up first, then those sums.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0)), _matrix(batch.column(1))
            if centre is not None:
                x, y = x - centre[0], y - centre[1]
            if unit:
                x, y = _unit(x), _unit(y)
            parts = [_KINDS[kind](x, y) for kind in kinds]
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        if total is None:
            return
        for kind, m in zip(kinds, total):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(m)),
                    pa.array(np.arange(len(m), dtype=np.int32)),
                    pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(
                        pa.list_(pa.float64())
                    ),
                ],
                names=["kind", "i", "values"],
            )

    def added(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "i")), strict=True)
            for n, key in enumerate(rows):
                values = batch.column("values")[n].values.to_numpy()
                sums[key] = sums[key] + values if key in sums else values
        for (kind, i), values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([i], pa.int32()), pa.array([values], pa.list_(pa.float64()))],
                names=["kind", "i", "values"],
            )

    sums = pairs.select("x", "y").mapInArrow(partial, _SUMS)
    near = F.floor(F.spark_partition_id() / FAN_IN)
    sums = sums.repartition("kind", "i", near).mapInArrow(added, _SUMS)
    sums = sums.repartition("kind", "i").mapInArrow(added, _SUMS)
    return sums.select("kind", "i", F.posexplode("values").alias("j", "value"))


@dataclass(frozen=True)
class SpaceMap:
    """y = x @ coef + intercept; ``rank`` of the centred x, if fitted."""

    coef: np.ndarray
    intercept: np.ndarray
    rank: int | None = None


_FACTOR = T.StructType(
    [
        T.StructField("task", T.LongType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def _reduced(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factor_rows(factor: np.ndarray | None, task: int) -> Iterator[pa.RecordBatch]:
    if factor is not None:
        offsets = np.arange(len(factor) + 1, dtype=np.int32) * factor.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(factor), task, np.int64)),
                pa.array(np.arange(len(factor), dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(factor.ravel())),
            ],
            names=_FACTOR.names,
        )


def triangular_factor(pairs: DataFrame) -> np.ndarray:
    """The R of the QR decomposition of the rows (1, x, y) of a tall table of (x, y) vector pairs.

    Each task reduces its batches to one R; the R of up to ``FAN_IN`` tasks are reduced to one, round
    by round, until one is left. No sum of squares is formed, so the condition of x is not
    squared. A task holds two factors at a time; the driver gets the rows of the last one.
    """

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), _matrix(batch.column(1))
                rows = np.hstack([np.ones((len(x), 1)), x, y])
                factor = _reduced(rows if factor is None else np.vstack([factor, rows]))
        yield from _factor_rows(factor, TaskContext.get().partitionId())

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, task, rows = None, None, []

        def added() -> np.ndarray | None:
            return factor if not rows else _reduced(np.vstack([*([] if factor is None else [factor]), *rows]))

        for batch in batches:
            values = batch.column(2)
            for n, now in enumerate(batch.column(0).to_pylist()):
                if now != task:
                    factor, task, rows = added(), now, []
                rows.append(values[n].values.to_numpy()[None, :])
        yield from _factor_rows(added(), TaskContext.get().partitionId())

    factors = materialize(pairs.select("x", "y").mapInArrow(reduce_batches, _FACTOR))
    while (tasks := factors.select("task").distinct().count()) > 1:
        groups = -(-tasks // FAN_IN)
        together = factors.repartition(groups, F.pmod("task", F.lit(groups))).sortWithinPartitions("task", "i")
        factors = materialize(together.mapInArrow(reduce_factors, _FACTOR))
    rows = factors.orderBy("i").select("values").toArrow()["values"].combine_chunks()
    return _matrix(rows) if len(rows) else np.zeros((0, 0))


def fit_space_map(pairs: DataFrame) -> SpaceMap:
    """Least squares with intercept over (x, y) pairs.

    Spark reduces the rows to one triangular factor; below its first row stands the factor of the
    centred vectors, which the driver solves. A singular system gets the minimum-norm solution, and
    the rank says so.
    """
    dim = pairs.select(F.size("x").alias("n")).first()
    if dim is None:
        raise ValueError("no pairs to fit")
    d, factor = dim["n"], triangular_factor(pairs)
    coef, _, rank, _ = np.linalg.lstsq(factor[1:, 1 : d + 1], factor[1:, d + 1 :], rcond=None)
    if len(factor) < 2:
        coef, rank = np.zeros((d, factor.shape[1] - d - 1)), 0
    intercept = (factor[0, d + 1 :] - factor[0, 1 : d + 1] @ coef) / factor[0, 0]
    return SpaceMap(coef, intercept, int(rank))


def apply_space_map(large: DataFrame, fitted: SpaceMap, out: str = "mapped") -> DataFrame:
    """Map the vector of every word without an underscore."""
    plain = large.filter(~F.contains("word", F.lit("_")))
    return project(plain, fitted.coef, fitted.intercept, v="v", out=out)


def expand_vocab(
    large: DataFrame, own: DataFrame, fitted: SpaceMap | None, oov: str = "unk"
) -> DataFrame:
    """Expanded vocabulary (pos, word, v).

    ``unk``: all mapped words of the large space in their order, own vectors overriding the
    mapped ones, then the own words that are new. ``drop``: own words only. Both inputs are
    (word, id, v); ``id`` is their order.
    """
    if oov not in ("unk", "drop"):
        raise ValueError(f"oov must be 'unk' or 'drop', not {oov!r}")
    mine = own.select(
        "word",
        F.col("id").cast("bigint").alias("_own"),
        F.transform("v", lambda x: x.cast("double")).alias("v"),
    )
    if oov == "drop":
        return ranked(mine, "_own", name="pos").select("pos", "word", "v")
    mapped = apply_space_map(large, fitted).select(
        "word", F.col("id").cast("bigint").alias("_large"), "mapped"
    )
    both = mapped.join(mine, "word", "full_outer").select(
        "word",
        F.coalesce("v", "mapped").alias("v"),
        F.col("_large").isNull().alias("_new"),
        F.coalesce("_large", "_own").alias("_order"),
    )
    return ranked(both, "_new", "_order", name="pos").select("pos", "word", "v")
