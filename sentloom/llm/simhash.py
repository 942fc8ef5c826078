"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from 3-word shingles. To find pairs within ``distance`` bits, the 64 bits are
grouped so that correlated bits stand together, and each group gets a threshold of its own: if the
thresholds t_i (-1: group unused) satisfy sum(t_i + 1) = distance + 1, every pair sought is within
t_i in some group i. Dynamic programming picks the thresholds with the fewest estimated
candidates. Candidates are verified on all bits.

A bucket of many fingerprints is not paired out. Its members meet through mid-points instead: two
fingerprints are within two bits exactly if some value is within one bit of both. Each
member stands at its 65 such values, and the values' smallest member links the others: linear work,
and the links' components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sentloom.llm.common import free_name, lookup_join, slices
from sentloom.llm.components import connected_components
from sentloom.session import materialize

SHINGLE, SEED = 3, 42
DISTANCE = 2
GROUPS = 3
#: A bucket of more fingerprints goes by mid-points (only the way changes, not the links).
LARGE_BUCKET = 32
UNUSED = -1


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long), one row per row of ``df``."""
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())]
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                prints = np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(prints)], names=["doc_id", "fp"]
                )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        hashed, schema
    )


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both. Tasks add up; the
    driver sees 64 x 64 sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            data = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(data), 1 << 15):
                part = np.ascontiguousarray(data[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(64 * 64)), pa.array(total.ravel())], names=["cell", "n"]
        )

    sums = prints.select("fp").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(64 * 64, np.int64)
    for row in sums.collect():
        both[row.cell] = row.n
    return prints.count(), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, groups: int = GROUPS) -> list[list[int]]:
    """Greedy: a group starts with the free bit of the strongest correlations and takes the free
    bits most correlated with its own."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(share * (1 - share), 1e-12, None))
    strength = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, found = set(range(64)), []
    for g in range(groups):
        size = 64 // groups + (g < 64 % groups)
        members = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(members[0])
        while len(members) < size:
            best = max(free, key=lambda b: (strength[b, members].sum(), -b))
            members.append(best)
            free.discard(best)
        found.append(sorted(members))
    return found


def choose_thresholds(costs: list[dict[int, float]], distance: int = DISTANCE) -> list[int]:
    """Thresholds with sum(t + 1) = distance + 1 and the least sum of costs; ``costs[i][t]`` is
    what group i at threshold t yields. Dynamic programming over the groups."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                now = used + t + 1
                if now <= distance + 1 and (now not in step or total + c < step[now][0]):
                    step[now] = (total + c, [*chosen, t])
        best = step
    return best[distance + 1][1]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], distance: int) -> list[int]:
    return [_mask(c) for k in range(distance + 1) for c in combinations(bits, k)]


def _parts(groups: list[list[int]], thresholds: list[int], probe: bool) -> Column:
    """(group, key) structs of a fingerprint: its own key per used group, or all keys within the
    group's threshold."""
    keys = [
        F.struct(F.lit(g).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("bigint")).bitwiseXOR(F.lit(flip).cast("bigint")).alias("key"))
        for g, (bits, t) in enumerate(zip(groups, thresholds, strict=True))
        if t > UNUSED
        for flip in (_flips(bits, t) if probe else [0])
    ]
    return F.explode(F.array(*keys))


def plan_partitions(prints: DataFrame) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds for the distinct fingerprints ``prints``."""
    n, both = bit_statistics(prints)
    groups = group_bits(n, both)
    exact = [0] * len(groups)
    buckets = (
        prints.select(_parts(groups, exact, False).alias("k"))
        .groupBy("k.part", "k.key").agg(F.count("*").alias("n"))
        .groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    )
    pairs = {row.part: row.pairs for row in buckets.collect()}
    share = np.diag(both) / max(n, 1)
    costs = []
    for g, bits in enumerate(groups):
        same = share[bits] ** 2 + (1 - share[bits]) ** 2
        odds = (1 - same) / same  # one bit differs, by bits taken as independent
        first, second = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
        base = pairs.get(g, 0.0)
        costs.append(
            {
                UNUSED: 0.0,
                0: base + n,
                1: base * (1 + first) + n * (1 + len(bits)),
                2: base * (1 + first + second) + n * len(_flips(bits, 2)),
            }
        )
    return groups, choose_thresholds(costs)


def links(prints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """Pairs (a, b) of fingerprints within two bits whose components are those of all such
    pairs."""
    on = ["part", "key"]
    index = prints.select("fp", _parts(groups, thresholds, False).alias("k")).select("fp", "k.*")
    probe = prints.select(F.col("fp").alias("a"), _parts(groups, thresholds, True).alias("k")).select("a", "k.*")
    large = materialize(index.groupBy(*on).count().filter(F.col("count") > LARGE_BUCKET).select(*on))
    pairs = (
        probe.join(large, on, "left_anti")
        .join(index.join(large, on, "left_anti").withColumnRenamed("fp", "b"), on)
        .filter(F.col("a") < F.col("b") if max(thresholds) == 0 else F.col("a") != F.col("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        .select("a", "b")
    )
    middles = (
        probe.join(large, on, "left_semi").select("a").distinct()
        .select("a", F.explode(F.array(*[F.col("a").bitwiseXOR(F.lit(f).cast("bigint")) for f in _flips(list(range(64)), 1)])).alias("mid"))
    )
    first = middles.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = middles.join(first, "mid").filter(F.col("a") != F.col("b")).select("a", "b")
    return pairs.unionByName(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` per row of ``df``: the smallest id reachable over
    fingerprints that differ in at most two bits.

    Null and empty texts have fingerprint zero and are linked like others. Null ids are never a
    component's id unless all its ids are null. Equal fingerprints are one node, however many
    rows have it. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(df, id_col, text_col))
    rooted = _rooted(rows)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = rooted.join(smallest, "root").select("fp", "component_id", "n_rows")
    return lookup_join(rows, labelled, "fp", "n_rows", "doc_id")


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, first_id, n_rows, root): a row per fingerprint, with its component's root."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")))
    groups, thresholds = plan_partitions(nodes)
    roots = connected_components(links(nodes, groups, thresholds))
    return nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", "n_rows", F.coalesce("root", "fp").alias("root")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates one row of ``df``, with its columns as they are: that of
    the smallest id (null ids last), then of the smallest hash of its text.

    Rows are judged one by one, whatever ids they share: they are numbered and stored first, and
    the number is part of what the components compare. Null and empty texts have fingerprint zero
    and are linked like others.
    """
    number = free_name(df, "row_number")
    rows = materialize(df.withColumn(number, F.monotonically_increasing_id()))
    order = F.struct(
        F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("hash"), F.col(number).alias("number"),
    )
    prints = materialize(fingerprints(rows.select(order.alias("order"), text_col), "order", text_col))
    kept = _rooted(prints).groupBy("root").agg(F.min("first_id").alias("first")).select(F.col("first.number").alias(number))
    return rows.join(kept, number, "left_semi").select(*df.columns)
