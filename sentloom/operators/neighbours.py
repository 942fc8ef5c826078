"""Cosine nearest neighbours, neighbour overlap, all-pairs moments.

The all-pairs matrix is never emitted, nor a grid of all blocks. A small set of queries is sent to
the rows; a large one visits blocks around pivots, by bound, and leaves out those that can't
improve its k best. Each task turns its products into a few rows at once (the best k per row).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentloom.functions.vectors import NORM_EPSILON
from sentloom.operators.expand import gram_sums
from sentloom.operators.joins import salted_join, split_hot
from sentloom.session import materialize

# Similarities are compared at this precision, so that the shape of a block product can not
# change the order of equal neighbours.
DIGITS = 10
# Elements of the bounds computed at once; rows and columns of one partial product; pairs computed again
# in double at once.
_TILE, _TILE_ROWS, _TILE_COLUMNS, _EXACT = 1 << 20, 2048, 4096, 1 << 16
# Vectors of one block, in double.
_BLOCK_BYTES = 64 << 20
# Queries sent to every task, and pivots, in double.
SENT_BYTES, _PIVOT_BYTES = 8 << 20, 32 << 20
# Queries that meet a block in one task; rows that leave a task at once.
_CHUNK, _OUT = 16_384, 4096
# Of all (query, block) visits the share above which all rows are scanned, and the bytes of rows that
# a task then holds.
_DENSE, _SCAN_BYTES = 0.5, 32 << 20
# Room for rounding in angles and similarities.
_ANGLE_SLACK, _BOUND_SLACK = 1e-6, 1e-9


def _unit_rows(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(len(lists), -1)
    return rows / np.sqrt(np.maximum((rows * rows).sum(axis=1, keepdims=True), NORM_EPSILON))


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows and dimensions."""
    size = df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    return size["n"], max(size["dim"] or 1, 1)


def _ordered(found: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best per key, ranked from 1; ties go to the smaller neighbour."""
    best = Window.partitionBy(key).orderBy(F.desc("similarity"), F.asc("neighbour"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scored(
    names: np.ndarray, a: np.ndarray, there: np.ndarray, b: np.ndarray, k: int,
    least: np.ndarray | None = None, own: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, neighbour, similarity) of the k best rows of ``b`` for each row of ``a``, one tile of both at
    a time. ``there`` is ascending. Rows below ``least`` and rows named as ``own`` are left out.

    Tiles are multiplied in single precision; what can reach a row's k-th similarity so far, within the
    rounding of that, is computed again in double.
    """
    slack = 1e-6 + 4e-7 * a.shape[1]
    low_b = b.astype(np.float32)
    wanted = k + (own is not None)
    for at in range(0, len(a), _TILE_ROWS):
        some = a[at : at + _TILE_ROWS]
        low = some.astype(np.float32)
        floor = np.full(len(some), -np.inf) if least is None else least[at : at + _TILE_ROWS] - slack
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for first in range(0, len(b), _TILE_COLUMNS):
            s = low @ low_b[first : first + _TILE_COLUMNS].T
            open_ = np.flatnonzero(np.isneginf(floor))
            if len(open_) and s.shape[1] > wanted:
                floor[open_] = np.partition(s[open_], -wanted, axis=1)[:, -wanted] - 2 * slack
            r, c = np.nonzero(s >= floor[:, None].astype(np.float32))
            for cut in range(0, len(r), _EXACT):
                row, column = r[cut : cut + _EXACT], c[cut : cut + _EXACT] + first
                exact = np.round(np.einsum("nd,nd->n", some[row], b[column]), DIGITS)
                keep = np.isfinite(exact)
                if own is not None:
                    keep &= own[at + row] != there[column]
                if least is not None:
                    keep &= exact >= least[at + row]
                new = [x[keep] for x in (row, column, exact)]
                best = _first([np.concatenate(x) for x in zip(best, new, strict=True)], k)
            if len(r):
                last = np.flatnonzero(np.bincount(best[0], minlength=len(some)) == k)
                ends = np.cumsum(np.bincount(best[0], minlength=len(some)))[last] - 1
                floor[last] = np.maximum(floor[last], best[2][ends] - slack)
        yield names[at + best[0]], there[best[1]], best[2]


def _first(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each row of (row, place, similarity), in that order; ties go to the smaller place."""
    order = np.lexsort((columns[1], -columns[2], columns[0]))
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.diff(columns[0], prepend=-1))
    inside = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return [c[inside < k] for c in columns]


def _sent(queries: DataFrame, corpus: DataFrame, k: int, include_self: bool) -> DataFrame:
    """Queries of a checked size go to every task of the corpus, which stays where it is. A task keeps
    the k best per query over all its batches."""
    asked = queries.toArrow()
    ids = asked["id"].to_numpy()
    matrix = _unit_rows(asked["v"]) if len(ids) else np.zeros((0, 1))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        place = np.arange(len(ids))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            table = pa.Table.from_batches([batch]).sort_by("id")
            # What a query has found before is the least that counts.
            found = np.bincount(best[0], minlength=len(ids))
            least = np.full(len(ids), -np.inf)
            least[found == k] = best[2][np.cumsum(found)[found == k] - 1]
            parts = _scored(place, matrix, table["id"].to_numpy(), _unit_rows(table["v"]), k, least, None if include_self else ids)
            best = _first([np.concatenate(c) for c in zip(best, *parts, strict=True)], k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["id", "neighbour", "similarity"])

    return _ordered(corpus.mapInArrow(search, "id bigint, neighbour bigint, similarity double"), k)


@dataclass
class PivotIndex:
    """An exact index: rows in blocks around pivots, searched in the order of their bounds.

    Pivots are some of the rows, chosen by hash. Each row belongs to its nearest pivot; large cells are
    dealt out over several blocks. A block knows the least and the greatest angle between its rows
    and the pivot, so by the triangle inequality no row of it can be nearer to a query than the
    query's angle to the pivot allows. A query visits blocks by falling bound, some more each
    round, and stops when the next bound is below its k-th similarity. Where the bounds leave out
    too little, chunks of queries scan runs of all rows instead. Of equal vectors only the
    k of the smallest ids are kept, since no other can be among a query's first k.
    """

    k: int
    rows: DataFrame
    pivots: np.ndarray
    cells: np.ndarray
    least: np.ndarray
    most: np.ndarray
    #: (query, block) visits of each round of the last search.
    visits: list[int] = field(default_factory=list)

    @staticmethod
    def build(rows: DataFrame, k: int, rows_per_block: int | None = None) -> PivotIndex:
        """``rows``: stored (key, id, v), ``key`` as :func:`vector_key`."""
        n, dim = _size(rows)
        parallel = rows.sparkSession.sparkContext.defaultParallelism
        size = rows_per_block or min(max(1024, _BLOCK_BYTES // (8 * dim)), max(1024, n // parallel))
        same = Window.partitionBy("key").orderBy("id")
        kept = rows.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") <= k)
        n_pivots = max(1, min(_PIVOT_BYTES // (8 * dim), math.ceil(n / size)))
        chosen = kept.filter("_place = 1").orderBy("key").limit(n_pivots).select("v").toArrow()
        pivots = _unit_rows(chosen["v"]) if len(chosen) else np.zeros((1, dim))
        pivots = pivots[np.linalg.norm(pivots, axis=1) > 0.5]
        if not len(pivots):
            pivots = np.eye(1, dim)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                step = max(1, _TILE // len(pivots))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    unit = _unit_rows(pa.chunked_array([part.column(1)]))
                    near = unit @ pivots.T
                    best = near.argmax(axis=1)
                    length = np.linalg.norm(unit, axis=1)
                    short = length < 0.999  # no direction: bounded by its length
                    cell[at : at + step] = np.where(short, -1, best)
                    angle[at : at + step] = np.where(short, length, np.arccos(np.clip(near[np.arange(len(near)), best], -1, 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "v", "cell", "angle"])

        kind = rows.schema["v"].dataType.simpleString()
        assigned = materialize(kept.select("id", "v").mapInArrow(assign, f"id bigint, v {kind}, cell int, angle double"))
        parts = assigned.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
        placed = assigned.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        blocks = materialize(
            placed.groupBy("cell", "part").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
            .withColumn("block", F.row_number().over(Window.orderBy("cell", "part")) - 1)
        )
        known = blocks.orderBy("block").toArrow()
        numbered = placed.join(F.broadcast(blocks.select("cell", "part", "block")), ["cell", "part"])
        return PivotIndex(
            k, materialize(numbered.select("block", "id", "v")), pivots,
            *[known[c].to_numpy() for c in ("cell", "least", "most")],
        )

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The most that a row of each block can have in common with each query."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        directed = self.cells >= 0
        bound = np.broadcast_to(self.most, (len(unit), len(self.cells))).copy()
        to_pivot = angle[:, self.cells[directed]]
        gap = np.maximum(np.maximum(to_pivot - self.most[directed], self.least[directed] - to_pivot) - _ANGLE_SLACK, 0)
        bound[:, directed] = np.cos(np.minimum(gap, math.pi))
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        return np.where(length < 0.999, length, bound)

    def search(self, queries: DataFrame) -> DataFrame:
        """(key, near): per row of ``queries`` (key, v) its k nearest, an array of (neighbour,
        similarity)."""
        self.visits = []
        queries = materialize(queries.select("key", "v"))
        state = queries.withColumn("kth", F.lit(-math.inf))
        found, at, step = None, 0, 1
        while at < len(self.cells):
            if at and self._reached(state) > _DENSE * len(self.cells) * queries.count():
                self.visits.append(queries.count() * len(self.cells))
                return self._near(self._scanned(state))
            asked = materialize(self._asked(state, at, at + step))
            self.visits.append(asked.count())
            if not self.visits[-1]:
                break
            new = self._visited(asked)
            if found is not None:
                new = new.unionByName(found.select("key", F.inline("near")))
            found = materialize(self._near(new))
            kth = F.when(F.size("near") == self.k, F.get("near", F.lit(self.k - 1))["similarity"])
            state = queries.join(found, "key", "left").select("key", "v", F.coalesce(kth, F.lit(-math.inf)).alias("kth"))
            at, step = at + step, step * 2
        if found is None:
            return queries.select("key", F.lit(None).cast("array<struct<neighbour: bigint, similarity: double>>").alias("near"))
        return found

    def _near(self, found: DataFrame) -> DataFrame:
        """(key, near) of (key, neighbour, similarity)."""
        near = F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))), lambda x: F.struct(x["neighbour"].alias("neighbour"), x["similarity"].alias("similarity")))
        return _ordered(found, self.k, "key").groupBy("key").agg(near.alias("near"))

    def _reached(self, state: DataFrame) -> int:
        """Number of (query, block) pairs whose bound reaches the query's k-th similarity."""
        shared = state.sparkSession.sparkContext.broadcast(self._bounds_only())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            step = max(1, _TILE // max(len(index.cells), len(index.pivots)))
            for whole in batches:
                n = 0
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    bound = index.bounds(_unit_rows(pa.chunked_array([batch.column(0)])))
                    n += int((bound >= batch.column(1).to_numpy()[:, None] - _BOUND_SLACK).sum())
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return state.select("v", "kth").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0

    def _bounds_only(self) -> PivotIndex:
        return PivotIndex(self.k, None, self.pivots, self.cells, self.least, self.most)

    def _scanned(self, state: DataFrame) -> DataFrame:
        """(key, neighbour, similarity): the best of every run of rows for every query. Either side is
        copied once per chunk or run of the other."""
        (n, dim), asked = _size(self.rows), state.count()
        parallel = state.sparkSession.sparkContext.defaultParallelism
        chunks = math.ceil(asked / min(_CHUNK, max(1024, asked // (2 * parallel))))
        runs = math.ceil(n * dim * 8 / _SCAN_BYTES) or 1
        every = [F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (chunks, runs)]
        left = state.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")).withColumn("run", every[1])
        right = self.rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")).withColumn("chunk", every[0])
        by = ["chunk", "run"]
        return left.groupBy(*by).cogroup(right.select("chunk", "run", "id", "v").groupBy(*by)).applyInArrow(_candidates(self.k), _CANDIDATES)

    def _asked(self, state: DataFrame, first: int, last: int) -> DataFrame:
        """(block, key, v, kth): the blocks that stand at these places of the queries' orders, as long
        as their bounds reach the k-th similarity."""
        kind = state.schema["v"].dataType.simpleString()
        shared = state.sparkSession.sparkContext.broadcast(self._bounds_only())

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            step = max(1, _TILE // max(len(index.cells), len(index.pivots)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    bound = index.bounds(_unit_rows(pa.chunked_array([batch.column(1)])))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    reach = np.take_along_axis(bound, order, axis=1) >= batch.column(2).to_numpy()[:, None] - _BOUND_SLACK
                    row, place = np.nonzero(reach)
                    block = order[row, place].astype(np.int32)
                    for cut in range(0, len(row), _OUT):
                        picked = batch.take(pa.array(row[cut : cut + _OUT]))
                        yield pa.RecordBatch.from_arrays([pa.array(block[cut : cut + _OUT]), *picked.columns], names=["block", "key", "v", "kth"])

        return state.select("key", "v", "kth").mapInArrow(choose, f"block int, key string, v {kind}, kth double")

    def _visited(self, asked: DataFrame) -> DataFrame:
        """(key, neighbour, similarity): candidates from the asked blocks. A block that very many
        queries ask for is copied once per ``_CHUNK`` of them."""
        left, right = split_hot(asked, self.rows, "block", ["key"], _CHUNK)
        by = ["block", "_chunk"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_candidates(self.k), _CANDIDATES)


_CANDIDATES = "key string, neighbour bigint, similarity double"


def _candidates(k: int):
    """Of queries (key, v, kth) and rows (id, v) the k best rows of each query."""

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            right = right.sort_by("id")
            a, b = _unit_rows(left["v"]), _unit_rows(right["v"])
            parts += _scored(np.arange(len(left)), a, right["id"].to_numpy(), b, k, left["kth"].to_numpy())
        row, neighbour, similarity = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table({"key": left["key"].take(pa.array(row)), "neighbour": neighbour, "similarity": similarity})

    return candidates


def vector_key(v: str = "v") -> Column:
    """128 hashed bits of a vector, as text: equal vectors have one key."""
    return F.concat_ws("-", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit(1), v)))


def _named(df: DataFrame, id_col: str, v: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(v).alias("v"))
    return rows.filter(F.col("v").isNotNull())


def knn_queries(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    id_col: str = "id",
    v: str = "v",
    include_self: bool = True,
    rows_per_block: int | None = None,
    max_bytes: int = SENT_BYTES,
) -> DataFrame:
    """(id, neighbour, similarity, rank): for each row of ``queries`` the k rows of ``corpus`` with the
    largest cosine, from rank 1.

    Exact. Ties go to the smaller id. A row of the query's id counts (``include_self``) or is left out.
    A zero vector has cosine 0 with every row; a NULL vector takes no part. Queries of up to
    ``max_bytes`` are sent to the corpus, which is not moved; others go through a
    :class:`PivotIndex`, each different vector once.
    """
    asked, rows = _named(queries, id_col, v), _named(corpus, id_col, v)
    n, dim = _size(asked)
    if n * dim * 8 <= max_bytes:
        return _sent(asked, rows, k, include_self)
    kept = k if include_self else k + 1
    rows = materialize(rows.select(vector_key().alias("key"), "id", "v"))
    index = PivotIndex.build(rows, kept, rows_per_block)
    keyed = rows if queries is corpus else materialize(asked.select(vector_key().alias("key"), "id", "v"))
    found = index.search(keyed.groupBy("key").agg(F.any_value("v").alias("v")))
    pairs = salted_join(keyed.select("key", "id"), found, "key", ["id"]).select("id", F.posexplode("near").alias("place", "x"))
    pairs = pairs.select("id", "place", "x.neighbour", "x.similarity")
    if include_self:
        return pairs.select("id", "neighbour", "similarity", (F.col("place") + 1).alias("rank"))
    return _ordered(pairs.filter("id <> neighbour").drop("place"), k)


def knn(
    df: DataFrame,
    k: int,
    id_col: str = "id",
    v: str = "v",
    include_self: bool = True,
    rows_per_block: int | None = None,
    max_bytes: int = SENT_BYTES,
) -> DataFrame:
    """:func:`knn_queries` of a table in itself."""
    return knn_queries(df, df, k, id_col, v, include_self, rows_per_block, max_bytes)


def neighbour_overlap(
    x: DataFrame,
    y: DataFrame,
    k: int = 10,
    id_col: str = "id",
    v: str = "v",
    strict_reference: bool = False,
) -> DataFrame:
    """One row: (n, shared, overlap), overlap = mean share of common k nearest neighbours.

    The row itself is left out by id; with ``strict_reference`` the best of k+1 is dropped,
    whichever row it is.
    """

    near = [_neighbours(df, k, id_col, v, strict_reference) for df in (x, y)]
    return _shared(*near, x, k)


def _neighbours(
    df: DataFrame, k: int, id_col: str = "id", v: str = "v", strict_reference: bool = False
) -> DataFrame:
    if strict_reference:
        found = knn(df, k + 1, id_col, v).filter(F.col("rank") > 1)
    else:
        found = knn(df, k, id_col, v, include_self=False)
    return found.select("id", "neighbour")


def _shared(near_x: DataFrame, near_y: DataFrame, x: DataFrame, k: int) -> DataFrame:
    shared = near_x.join(near_y, ["id", "neighbour"])
    rows = x.agg(F.count("*").alias("n")).scalar()
    return shared.agg(F.count("*").alias("shared")).select(
        rows.alias("n"), "shared", (F.col("shared") / (rows * k)).alias("overlap")
    )


def overlap_report(
    text: DataFrame, projected: DataFrame, image: DataFrame, k: int = 10
) -> DataFrame:
    """Overlap of text, projected text and image vectors, as (comparison, n, shared, overlap)."""
    spaces = {"text": text, "projected": projected, "image": image}
    # Each space's neighbours are searched for once.
    near = {name: materialize(_neighbours(df, k)) for name, df in spaces.items()}
    report = None
    for x, y in [("text", "image"), ("projected", "image"), ("text", "projected"), ("text", "text")]:
        row = _shared(near[x], near[y], spaces[x], k).select(
            F.lit(f"{x}_{y}").alias("comparison"), "*"
        )
        report = row if report is None else report.unionByName(row)
    return report


def neighbour_pairs(
    texts: DataFrame,
    vectors: DataFrame,
    k: int = 1,
    id_col: str = "id",
    text: str = "text",
    v: str = "v",
) -> DataFrame:
    """(id, neighbour, rank, s1, s2): each text with the texts of its k nearest vectors."""
    near = knn(vectors, k, id_col, v, include_self=False)
    first = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("s1"))
    second = texts.select(
        F.col(id_col).cast("bigint").alias("neighbour"), F.col(text).alias("s2")
    )
    return (
        near.join(first, "id").join(second, "neighbour").select("id", "neighbour", "rank", "s1", "s2")
    )


def similarity_moments(df: DataFrame, v: str = "v") -> DataFrame:
    """(n, mean, mean_square) over the cosines of all ordered row pairs, the diagonal included.

    Computed without any pair: the sum of all cosines is the squared length of the summed unit
    vectors, the sum of their squares is the squared Frobenius norm of the Gram matrix.
    """
    rows = df.select(F.col(v).alias("x"), F.col(v).alias("y"))
    sums = gram_sums(rows, ("n", "x", "xx"), unit=True)

    def squares(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("value")))

    n2 = squares("n")
    return sums.agg(
        F.sqrt(n2).cast("bigint").alias("n"),
        (squares("x") / n2).alias("mean"),
        (squares("xx") / n2).alias("mean_square"),
    )
