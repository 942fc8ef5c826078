"""Hard-negative mining by Fagin's threshold algorithm.

Vectors of whole numbers; a row's score is its inner product with an anchor. Rows fall into blocks, and
anchors into groups; a task holds one block and one group. A block has a sorted list of
candidates for each dimension. For an anchor the lists are read from their high end where its
component is positive and from their low end where it is negative (sorted access); rows seen for
the first time get their exact score (random access). What no list has shown yet scores at
most the threshold, the anchor's product with the values last read. Reading stops once the
threshold is strictly below the k-th score of every window, so ties are all seen.

Two passes: the positives (best rows of the anchor's label), then the negatives in the windows that the
positives' scores set. Block results are cut to the best k again, per task and per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentloom.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Window of a positive's score, in percent.
LOW, HIGH = 30, 90
#: Values of one block of rows and of one group of anchors (32 and 2 MB as doubles).
BLOCK_VALUES, GROUP_VALUES = 4 << 20, 256 << 10
#: Rows of a block at least, unless there are too few for all cores.
LEAST_ROWS = 2048
#: Entries first read from each list; doubled turn by turn.
FIRST_READ = 16
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53
POSITIVE = "anchor string, anchor_id bigint, positive_id bigint, positive string, score bigint"
NEGATIVE = "anchor string, positive string, negative_id bigint, negative string, score bigint"


def quantised(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(row, id, label, dim, v): the rows that take part, ``v`` scaled; tasks take the whole part below.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Equal
    rows (id, label, vector) are one; rows that share an id otherwise stand each for itself,
    named by ``row``.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * SCALE)
    whole = ~F.exists(
        F.col(vector_col),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    found = rows.filter(whole).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.size(vector_col).alias("dim"), v.alias("v"),
    )
    name = F.concat_ws(":", F.col("id").cast("string"), F.hex(F.xxhash64("label", "v")))
    return found.select(name.alias("row"), "*").dropDuplicates(["row"])


class Lists:
    """The rows of a block and their order in each dimension."""

    def __init__(self, group: pa.Table) -> None:
        group = group.sort_by([("id", "ascending"), ("row", "ascending")])
        self.ids = group["id"].to_numpy()
        self.rows = np.array(group["row"].to_pylist(), object)
        self.labels = group["label"].to_numpy()
        self.matrix = _matrix(group["v"])
        self.order = np.argsort(self.matrix, axis=0, kind="stable")

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(places, scores, threshold): rows in the order in which the lists show them, each once,
        with the most that a row not yet shown can score."""
        used = np.flatnonzero(anchor != 0)
        n = len(self.ids)
        if not len(used):
            yield np.arange(n), np.zeros(n, np.int64), -math.inf
            return
        down = anchor[used] > 0
        shown = np.zeros(n, bool)
        at, step = 0, FIRST_READ
        while at < n:
            end = min(n, at + step)
            depth = np.arange(at, end)
            entries = np.where(down[None, :], n - 1 - depth[:, None], depth[:, None])
            places = self.order[entries, used[None, :]]
            fresh = np.unique(places[~shown[places]])
            shown[fresh] = True
            last = self.matrix[places[-1], used]
            threshold = (anchor[used] * last).sum() if end < n else -math.inf
            yield fresh, self.matrix[fresh] @ anchor, threshold
            if shown.all():
                return
            at, step = end, step * 2


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = np.floor(lists.combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def _exact(matrix: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles while all sums stay exact, else as Python's whole numbers."""
    most = float(np.abs(matrix).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, matrix.shape[1])
    if most * 100 < EXACT:
        return matrix, anchors
    return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (matrix, anchors))


class Best:
    """The k best (score, place) of a window; among equal scores the smaller places."""

    def __init__(self, k: int, floor: float = -math.inf) -> None:
        self.k, self.floor = k, floor
        self.places = np.zeros(0, np.int64)
        self.scores = np.zeros(0)

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        if not len(places):
            return
        places, scores = np.concatenate([self.places, places]), np.concatenate([self.scores, scores])
        order = np.lexsort((places, -scores))[: self.k]
        self.places, self.scores = places[order], scores[order]

    def bound(self) -> float:
        """A row that scores strictly less can't enter any more."""
        return self.scores[-1] if len(self.places) == self.k else self.floor


def _placed(rows: DataFrame, anchors: DataFrame, same_label: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the key of their (anchor group, block) pairs. Rows are copied once per
    group of anchors, anchors once per block of rows."""
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    dim = max(size["dim"] or 1, 1)
    parallel = min(rows.sparkSession.sparkContext.defaultParallelism, size["n"] // LEAST_ROWS)
    blocks = max(1, math.ceil(size["n"] * dim / BLOCK_VALUES), parallel)
    groups = max(1, math.ceil(anchors.count() * dim / GROUP_VALUES))
    block, group = (F.pmod(F.xxhash64("row"), F.lit(k)).cast("int") for k in (blocks, groups))
    key = ["dim", "i", "j", *(["label"] if same_label else [])]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return rows.withColumn("j", block).withColumn("i", every(groups)), anchors.withColumn("i", group).withColumn("j", every(blocks)), key


def best_positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, anchor_id, positive_id, positive, score): the ``k`` best rows of the anchor's label with
    another id."""
    there, here, key = _placed(rows, anchors, True)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            lists = Lists(right)
            lists.matrix, vectors = _exact(lists.matrix, _matrix(left["v"]))
            for anchor, anchor_id, vector in zip(left["row"].to_pylist(), left["id"].to_pylist(), vectors, strict=True):
                best = Best(k)
                for places, scores, threshold in lists.read(vector):
                    other = lists.ids[places] != anchor_id
                    best.add(places[other], scores[other])
                    if threshold < best.bound():
                        break
                out += [
                    (anchor, anchor_id, int(lists.ids[p]), lists.rows[p], int(s))
                    for p, s in zip(best.places, best.scores, strict=True)
                ]
        return _table(out, POSITIVE)

    found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(search, POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def mine_negatives(rows: DataFrame, anchors: DataFrame, positives: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(anchor, positive, negative_id, negative, score, rank): for each anchor and positive the ``k`` best
    rows of another label in the positive's window."""
    pairs = positives.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("windows"))
    asked = anchors.join(pairs, F.col("row") == F.col("anchor")).select(
        "row", "id", "label", "dim", "v", F.transform("windows", lambda w: w["positive"]).alias("names"),
        F.transform("windows", lambda w: w["score"]).alias("scores"),
    )
    there, here, key = _placed(rows, asked, False)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            lists = Lists(right)
            lists.matrix, vectors = _exact(lists.matrix, _matrix(left["v"]))
            columns = (left[c].to_pylist() for c in ("row", "label", "names", "scores"))
            for vector, anchor, label, names, positive in zip(vectors, *columns, strict=True):
                # Without k rows, what is below the window's lower end can't enter. A window of a
                # negative score is empty.
                windows = [Best(k, LOW * p / 100 if p >= 0 else math.inf) for p in positive]
                for places, scores, threshold in lists.read(vector):
                    other = lists.labels[places] != label
                    places, scores = places[other], scores[other]
                    for window, p in zip(windows, positive, strict=True):
                        inside = (LOW * p <= 100 * scores) & (100 * scores <= HIGH * p)
                        window.add(places[inside], scores[inside])
                    if all(threshold < window.bound() for window in windows):
                        break
                for window, name in zip(windows, names, strict=True):
                    out += [
                        (anchor, name, int(lists.ids[p]), lists.rows[p], int(s))
                        for p, s in zip(window.places, window.scores, strict=True)
                    ]
        return _table(out, NEGATIVE)

    found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(search, NEGATIVE)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative_id", "negative")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [part.split(" ") for part in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors``, some of
    the rows of :func:`quantised`.

    Scores are exact; one beyond a long is an error. Only rows of one dimension meet. An anchor without
    positives, and a window without rows, give nothing, and so does an empty table.
    """
    rows, anchors = materialize(rows), materialize(anchors)
    positives = materialize(best_positives(rows, anchors, n_positives))
    mined = mine_negatives(rows, anchors, positives, n_negatives)
    known = positives.select("anchor", "positive", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return mined.join(known, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
