"""Negative word sampling and the negative-sampling score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.functions.vectors import dot, softplus
from sentloom.operators.joins import split_hot
from sentloom.operators.lookup import MAX_BROADCAST_BYTES, table_bytes
from sentloom.session import materialize

# Fixed values of the reproducible draw: a prime modulus below 2^31 and multipliers.
PRIME = 2147483647
BATCH_FACTOR, ITEM_FACTOR, SEED_FACTOR = 7919, 104729, 15485863
MIX_FACTOR = 48271
# Weight exponent of the sampling distribution.
DISTORTION = 0.75
# Numbers thrown for each word wanted.
TRIES = 4
# Rows scored as one group, and words scored at once inside it: bounds of a task's memory.
GROUP_ROWS, LINES = 2048, 4096
# Bytes of a word's id, weight and cumulative weight; ids of one range of a large vocabulary, as a
# power of two.
WORD_BYTES, RANGE_BITS = 24, 16
# Batches that ask one range for more words in one task.
FILLED = 64
# Numbers thrown at once. Words and targets that are joined in one piece, and the rows they meet in one
# task.
THROWN, BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 64 << 20, 1 << 16


def _mixed(*numbers) -> np.ndarray:
    """Whole-number mixing modulo a prime to (0, 1), so that any engine can repeat the draw."""
    batch, item, seed = numbers
    h = (batch * BATCH_FACTOR + item * ITEM_FACTOR + seed * SEED_FACTOR) % PRIME
    h = (h * h + item + 1) % PRIME
    h = (h * MIX_FACTOR + batch) % PRIME
    h = (h * h + item + 1) % PRIME
    return (h + 0.5) / PRIME


def word_weights(ids: np.ndarray, vocab_size: int) -> np.ndarray:
    """Zipf probability of each id, to the power of the distortion."""
    return ((np.log(ids + 2) - np.log(ids + 1)) / np.log(vocab_size + 1)) ** DISTORTION


@dataclass(frozen=True)
class WordDraw:
    """A weighted draw of different words whose cost does not depend on the vocabulary.

    Numbers are thrown at the cumulative weights, ``TRIES`` for each word wanted, and a word
    counts once, at its first hit: a weighted sample without replacement, in order. If too few
    words were hit, the others follow in the order of exponential keys -ln(u)/w, which is the
    same distribution.
    """

    ids: np.ndarray
    weights: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(ids: np.ndarray) -> WordDraw:
        ids = np.sort(ids.astype(np.int64))
        weights = word_weights(ids, len(ids))
        return WordDraw(ids, weights, np.cumsum(weights))

    def places(self, batch: int, n: int, seed: int) -> np.ndarray:
        """Positions in ``ids`` of ``n`` different words."""
        if len(self.ids) < n:
            raise ValueError(f"cannot draw {n} different words from {len(self.ids)}")
        if not n:
            return np.zeros(0, np.int64)
        hit = np.zeros(0, np.int64)
        for turn in range(TRIES):  # most often one or two turns are enough
            thrown = _mixed(batch, np.arange(turn * n, (turn + 1) * n, dtype=np.int64), seed)
            at = np.searchsorted(self.ends, thrown * self.ends[-1], "right")
            hit = np.concatenate([hit, np.minimum(at, len(self.ids) - 1)])
            found, first = np.unique(hit, return_index=True)
            if len(found) >= n:
                break
        found = found[np.argsort(first)][:n]
        if len(found) < n:
            keys = -np.log(_mixed(batch, self.ids, seed)) / self.weights
            keys[found] = np.inf
            rest = np.lexsort((self.ids, keys))[: n - len(found)]
            found = np.concatenate([found, rest])
        return found

    def places_many(self, batches: np.ndarray, n: int, seed: int) -> np.ndarray:
        """:meth:`places` of many batches, a row for each, some batches at a time."""
        found = np.zeros((len(batches), n), np.int64)
        if len(self.ids) < n or not n:
            return np.stack([self.places(int(b), n, seed) for b in batches]) if len(batches) else found
        bits = (TRIES * n).bit_length()
        for start in range(0, len(batches), max(1, THROWN // (TRIES * n))):
            left = np.arange(start, min(start + max(1, THROWN // (TRIES * n)), len(batches)))
            for turns in (TRIES // 2, TRIES):  # most often the half is enough
                turn = np.arange(turns * n, dtype=np.int64)
                thrown = _mixed(batches[left, None], turn, seed)
                hit = np.minimum(np.searchsorted(self.ends, thrown * self.ends[-1], "right"), len(self.ids) - 1)
                # Each word's first hit, by a sort of (word, turn).
                order = np.sort((hit << bits) | turn, axis=1)
                new = np.diff(order >> bits, axis=1, prepend=-1) != 0
                first = np.zeros(hit.shape, bool)
                first[np.nonzero(new)[0], order[new] & ((1 << bits) - 1)] = True
                place = first.cumsum(axis=1)
                done = place[:, -1] >= n
                found[left[done]] = hit[done][(first & (place <= n))[done]].reshape(-1, n)
                left = left[~done]
                if not len(left):
                    break
            for i in left:
                found[i] = self.places(int(batches[i]), n, seed)
        return found


def _unique(table: DataFrame) -> bool:
    """Whether no id of a (word, id[, v]) table repeats."""
    return table.groupBy("id").count().filter("count > 1").isEmpty()


def _vocabulary_ids(vocab: DataFrame) -> np.ndarray:
    """The ids, 8 bytes a word; their number is the documented size of the vocabulary."""
    return vocab.select(F.col("id").cast("bigint").alias("id")).toArrow()["id"].to_numpy()


def sample_negatives(
    batches: DataFrame,
    vocab: DataFrame,
    batch_size: int,
    length: int,
    k: int = 5,
    seed: int = 123,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(batch, position, slot, id): ``k * batch_size * length`` different words per batch.

    Words are drawn by weight and dealt in the order drawn, ``k`` to each position. ``batches`` has
    one row per batch; the draw happens where that row is. With a vocabulary whose ids and weights
    are over ``max_bytes`` the numbers thrown go to the words instead (:func:`draw_by_ranges`).
    """
    n = k * batch_size * length
    if vocab.count() * WORD_BYTES > max_bytes:
        drawn = draw_by_ranges(batches.select("batch"), vocab, n, seed)
        place = F.col("place")
        return drawn.select(
            "batch", F.floor(place / k).alias("position"), (place % k).cast("int").alias("slot"), F.col("id").cast("int").alias("id")
        )
    table = batches.sparkSession.sparkContext.broadcast(WordDraw.of(_vocabulary_ids(vocab)))
    schema = T.StructType(
        [
            T.StructField("batch", T.LongType()),
            T.StructField("position", T.LongType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("id", T.IntegerType()),
        ]
    )

    def draw(parts):
        words = table.value
        place = np.arange(n)
        step = max(1, THROWN // max(n, 1))
        for part in parts:
            every = part.column(0).to_numpy()
            for at in range(0, len(every), step):
                some = every[at : at + step]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some, n)),
                        pa.array(np.tile(place // k, len(some))),
                        pa.array(np.tile(place % k, len(some)).astype(np.int32)),
                        pa.array(words.ids[words.places_many(some, n, seed).ravel()].astype(np.int32)),
                    ],
                    names=["batch", "position", "slot", "id"],
                )

    # A batch is a number here and ``n`` rows after the draw: by their bytes they would go to few tasks.
    tasks = 4 * batches.sparkSession.sparkContext.defaultParallelism
    return batches.select(F.col("batch").cast("bigint").alias("batch")).repartition(tasks, "batch").mapInArrow(draw, schema)


def draw_by_ranges(batches: DataFrame, vocab: DataFrame, n: int, seed: int, range_bits: int = RANGE_BITS) -> DataFrame:
    """(batch, place, id): the draw of :class:`WordDraw` over a vocabulary that no task holds.

    A two-level cumulative index: ids fall into ranges of 2^``range_bits``; the driver knows the
    ranges' total weights, a range's own cumulative weights exist only in the task that holds it. A
    number thrown is sent to its range and hits a word there; a range that very many numbers hit is
    copied. A batch's first ``n`` different words are its draw. Batches that hit too few ask
    every range for the words of the least exponential keys.
    """
    words = materialize(vocab.select(F.col("id").cast("bigint").alias("id")).withColumn("range", F.shiftright("id", range_bits)))
    size = words.count()
    if size < n and not batches.isEmpty():
        raise ValueError(f"cannot draw {n} different words from {size}")
    if not n:
        return batches.select(F.col("batch").cast("bigint"), F.lit(0).alias("place"), F.lit(0).alias("id")).filter("false")
    weight = F.pow((F.ln(F.col("id") + 2) - F.ln(F.col("id") + 1)) / F.ln(F.lit(size + 1)), F.lit(DISTORTION))
    # A row per range: 2^range_bits words each.
    ranges = words.groupBy("range").agg(F.sum(weight).alias("w")).orderBy("range").toArrow()
    names, totals = ranges["range"].to_numpy(), ranges["w"].to_numpy()
    ends = np.cumsum(totals)

    def throw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(TRIES * n, dtype=np.int64)
        for part in parts:
            for batch in part.column(0).to_numpy():
                x = _mixed(int(batch), turn, seed) * ends[-1]
                at = np.minimum(np.searchsorted(ends, x, "right"), len(ends) - 1)
                inside = (x - (ends[at] - totals[at])) / totals[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(turn), batch, np.int64)), pa.array(turn), pa.array(names[at]), pa.array(inside)],
                    names=["batch", "turn", "range", "inside"],
                )

    asked = batches.select(F.col("batch").cast("bigint").alias("batch"))
    thrown = materialize(asked.mapInArrow(throw, "batch bigint, turn bigint, range bigint, inside double"))
    left, right = split_hot(thrown, words, "range", ["batch", "turn"], LINES * 64)

    def hit(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.sort(right["id"].to_numpy())
        batch, turn, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left):
            own = np.cumsum(word_weights(ids, size))
            at = np.searchsorted(own, left["inside"].to_numpy() * own[-1], "right")
            batch, turn, found = left["batch"].to_numpy(), left["turn"].to_numpy(), ids[np.minimum(at, len(ids) - 1)]
        return pa.table({"batch": batch, "turn": turn, "id": found})

    by = ["range", "_chunk"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(hit, "batch bigint, turn bigint, id bigint")
    first = hits.groupBy("batch", "id").agg(F.min("turn").alias("turn"))
    order = Window.partitionBy("batch").orderBy("turn")
    drawn = materialize(
        first.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n).select("batch", "place", "id")
    )
    short = drawn.groupBy("batch").agg(F.count("*").alias("found"), F.collect_list("id").alias("ids")).filter(F.col("found") < n)
    if short.isEmpty():
        return drawn
    return drawn.unionByName(_fill(short, words, (int(names[0]), int(names[-1])), n, seed, size))


def _fill(short: DataFrame, words: DataFrame, ranges: tuple[int, int], n: int, seed: int, size: int) -> DataFrame:
    """(batch, place, id): the words still missing in ``short`` (batch, found, ids), in the order of
    exponential keys. Every range gives at most as many words as a batch lacks."""
    short = materialize(short)
    every = F.explode(F.sequence(*[F.lit(r).cast("bigint") for r in ranges]))
    left, right = split_hot(short.withColumn("range", every), words, "range", ["batch"], FILLED)

    def least(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.sort(right["id"].to_numpy())
        weights = word_weights(ids, size)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch, found, used in zip(left["batch"].to_pylist(), left["found"].to_pylist(), left["ids"], strict=True):
            keys = -np.log(_mixed(batch, ids, seed)) / weights
            keys[np.isin(ids, used.values.to_numpy())] = np.inf
            best = np.lexsort((ids, keys))[: n - found]
            best = best[np.isfinite(keys[best])]
            out.append((np.full(len(best), batch), ids[best], keys[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"batch": columns[0], "id": columns[1], "key": columns[2]})

    by = ["range", "_chunk"]
    keyed = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(least, "batch bigint, id bigint, key double")
    order = Window.partitionBy("batch").orderBy("key", "id")
    ranked = keyed.withColumn("_i", F.row_number().over(order)).join(short.select("batch", "found"), "batch")
    return ranked.withColumn("place", F.col("_i") - 1 + F.col("found")).filter(F.col("place") < n).select(
        "batch", F.col("place").cast("int").alias("place"), "id"
    )


def positive_pairs(triples: DataFrame, v: str = "v", keep: list[str] | None = None) -> DataFrame:
    """(keep, part, t, v, id): each sentence vector with every target word of its triple.

    ``part`` is ``pre``, ``post`` or ``own``.
    """
    parts = F.array(
        F.struct(F.lit("pre").alias("part"), F.col("decode_pre").alias("ids")),
        F.struct(F.lit("post").alias("part"), F.col("decode_post").alias("ids")),
        F.struct(F.lit("own").alias("part"), F.col("encode").alias("ids")),
    )
    return triples.select(*(keep or []), F.col(v).alias("v"), F.inline(parts)).select(
        *(keep or []), "part", "v", F.posexplode("ids").alias("t", "id")
    )


def negative_sampling_loss(
    df: DataFrame,
    targets: DataFrame,
    vocab: DataFrame,
    batch_size: int,
    length: int = 30,
    k: int = 5,
    seed: int = 123,
    parts: tuple[str, ...] = ("decode_pre", "decode_post", "encode"),
    max_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(batch, part, value): -Σ (ln σ(pos) + Σ ln σ(-neg)) / (batch_size * length).

    ``df`` is (batch, row, v, id-array columns named in ``parts``) from ``assign_batches``;
    ``targets`` is (id, v), the target vector of every id of ``vocab``. Each part takes its own
    draw. The divisor counts all padded positions; a position without word adds nothing. A task
    takes some batches at a time, so small batches cost no group each. Targets over ``max_bytes`` are not
    sent to every task, nor to the driver: with up to ``block_bytes`` of words and targets, long runs of
    batches meet them in a join, else each word meets its target in one. The losses are the same.

    ``vectors`` adds ``v`` to a ``df`` without it, row by row. Runs of batches then get their vectors in the
    task that scores them: only ids are moved, and nothing is stored. ``df`` is read twice.
    """
    size = table_bytes(targets.select(F.col("id").cast("string").alias("word"), "v"))
    run = max(1, GROUP_ROWS // batch_size)
    n = k * batch_size * length
    sent = size <= max_bytes
    by_runs = not sent and size + vocab.count() * WORD_BYTES <= block_bytes and _unique(vocab) and _unique(targets)
    if vectors and not by_runs:
        df = vectors(df)
    if not sent and not by_runs:
        return _loss_by_join(df, targets, vocab, batch_size, length, k, seed, parts)

    def matrix_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows["id"].to_numpy(), flat.astype(np.float64).reshape(len(rows), -1)

    def places_of(target_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
        places = np.minimum(np.searchsorted(target_ids, ids), max(len(target_ids) - 1, 0))
        if len(ids) and not (len(target_ids) and (target_ids[places] == ids).all()):
            raise ValueError("a word without a target vector")
        return places

    def score(words: WordDraw, target_ids: np.ndarray, target: np.ndarray, group: pa.Table) -> pa.Table:
        # Where each drawn word stands in the matrix; every word of the vocabulary has a target.
        own = places_of(target_ids, words.ids)
        batches, batch_of = np.unique(group["batch"].to_numpy(), return_inverse=True)
        rows = group["row"].to_numpy()
        vectors = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.astype(np.float64).reshape(len(rows), -1)
        lost = np.zeros((len(batches), len(parts)))
        for number, part in enumerate(parts):
            lists = group[part].combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if len(sizes) and sizes.max() > length:
                raise ValueError("sentence longer than the padded width")
            drawn = own[words.places_many(batches, n, seed + number)]
            drawn = drawn.reshape(len(batches), batch_size, length, k)
            positives = places_of(target_ids, lists.flatten().to_numpy(zero_copy_only=False))
            # One line per word: its sentence, and its place in that sentence.
            line = np.repeat(np.arange(len(rows)), sizes)
            place = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for at in range(0, len(line), LINES):
                some, where = line[at : at + LINES], place[at : at + LINES]
                v = vectors[some]
                positive = np.einsum("wd,wd->w", target[positives[at : at + LINES]], v)
                negatives = target[drawn[batch_of[some], rows[some], where]]
                negative = np.einsum("wkd,wd->wk", negatives, v)
                loss = np.logaddexp(0.0, -positive) + np.logaddexp(0.0, negative).sum(axis=1)
                lost[:, number] += np.bincount(batch_of[some], loss, len(batches))
        return pa.table(
            {
                "batch": np.repeat(batches, len(parts)),
                "part": list(parts) * len(batches),
                "value": lost.ravel() / (batch_size * length),
            }
        )

    schema = "batch bigint, part string, value double"
    columns = [F.col("batch").cast("bigint").alias("batch"), "row", *parts]
    table = targets.select(F.col("id").cast("bigint").alias("id"), "v")
    if sent:
        words = WordDraw.of(_vocabulary_ids(vocab))
        shared = df.sparkSession.sparkContext.broadcast((words, *matrix_of(table.orderBy("id").toArrow())))
        return (
            df.select(*columns, "v", F.floor(F.col("batch") / run).alias("_run")).groupBy("_run")
            .applyInArrow(lambda key, group: score(*shared.value, group), schema)
        )

    def score_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        met = right.filter(right["word"].is_valid()), right.filter(right["word"].is_null()).sort_by("id")
        words, (target_ids, target) = WordDraw.of(met[0]["word"].to_numpy()), matrix_of(met[1])
        left = left.sort_by([("batch", "ascending"), ("row", "ascending")])
        runs = left["batch"].to_numpy() // run
        borders = np.append(np.flatnonzero(np.diff(runs, prepend=-1)), len(left))
        every = [score(words, target_ids, target, left.slice(a, b - a)) for a, b in zip(borders, borders[1:], strict=False)]
        return pa.concat_tables(every) if every else pa.table({"batch": pa.array([], pa.int64()), "part": pa.array([], pa.string()), "value": pa.array([], pa.float64())})

    def score_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows in the order of their runs, a run's words and targets first.
        for group in _groups(batches, "_run"):
            met = pc.is_null(group["batch"])
            right = group.filter(met).select(["_word", "_id", "_target"]).rename_columns(["word", "id", "v"])
            yield from score_runs(group.filter(pc.invert(met)), right).to_batches()

    # Read twice: for the runs there are, and for their rows.
    run_of = F.floor(F.col("batch") / max(1, BLOCK_ROWS // batch_size)).alias("_run")
    rows = df.select(*columns, run_of) if vectors else materialize(df.select(*columns, "v", run_of))
    word = F.col("id").cast("bigint").alias("word")
    both = table.withColumn("word", F.lit(None).cast("bigint")).unionByName(vocab.select(word), allowMissingColumns=True)
    right = both.crossJoin(F.broadcast(rows.select(F.col("_run").alias("_met")).distinct()))
    if vectors:
        # Spark takes rows with a Python function's result for unordered, and a join would move the vectors. So
        # what is to meet is dealt out and sorted as one table, before the vectors are there.
        right = right.select(*[F.col(c).alias(n) for c, n in (("_met", "_run"), ("word", "_word"), ("id", "_id"), ("v", "_target"))])
        dealt = rows.unionByName(right, allowMissingColumns=True).repartition("_run").sortWithinPartitions("_run", "batch", "row")
        return vectors(dealt).select(*dealt.columns, "v").mapInArrow(score_dealt, schema)
    return rows.groupBy("_run").cogroup(right.groupBy("_met")).applyInArrow(score_runs, schema)


def _loss_by_join(
    df: DataFrame, targets: DataFrame, vocab: DataFrame, batch_size: int, length: int, k: int, seed: int, parts: tuple[str, ...]
) -> DataFrame:
    """The same losses without any table in a task's memory.

    Each word of a sentence and each word drawn for its position asks for a target vector. Asks meet
    targets by id, common words over several tasks, and what they get meets the sentence's vector by
    (batch, row); only sums per batch and part are left after that.
    """
    df = materialize(df.select(F.col("batch").cast("bigint").alias("batch"), F.col("row").cast("bigint").alias("row"), "v", *parts))
    lists = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(p).alias("ids")) for i, p in enumerate(parts)]))
    rows = df.select("batch", "row", lists.alias("x")).select("batch", "row", "x.part", "x.ids")
    long = F.size("ids") > length
    rows = rows.withColumn("ids", F.when(long, F.raise_error(F.lit("sentence longer than the padded width"))).otherwise(F.col("ids")))
    lines = materialize(rows.select("batch", "row", "part", F.posexplode("ids").alias("at", "id")))
    positive = lines.select("batch", "row", "part", F.col("id").cast("bigint").alias("id"), F.lit(-1.0).alias("sign"))
    asks, batches, n = positive, lines.select("batch").distinct(), k * batch_size * length
    if k:
        for i in range(len(parts)):
            drawn = draw_by_ranges(batches, vocab, n, seed + i)
            place = F.floor(F.col("place") / k)
            drawn = drawn.select("batch", F.floor(place / length).alias("row"), (place % length).alias("at"), "id")
            wanted = lines.filter(F.col("part") == i).select("batch", "row", "part", "at")
            negative = wanted.join(drawn, ["batch", "row", "at"]).select("batch", "row", "part", "id", F.lit(1.0).alias("sign"))
            asks = asks.unionByName(negative)
    # One row per different ask of a sentence.
    asks = materialize(asks.groupBy("batch", "row", "part", "id", "sign").agg(F.count("*").alias("times")))
    table = targets.select(F.col("id").cast("bigint").alias("id"), F.col("v").alias("target"))
    left, right = split_hot(asks, table, "id", ["batch", "row"], LINES * 16)
    met = left.join(right, ["id", "_chunk"], "left")
    target = F.when(F.col("target").isNull(), F.raise_error(F.lit("a word without a target vector"))).otherwise(F.col("target"))
    scored = met.select("batch", "row", "part", "sign", "times", target.alias("target")).join(df.select("batch", "row", "v"), ["batch", "row"])
    loss = softplus(F.col("sign") * dot("target", "v")) * F.col("times")
    found = scored.groupBy("batch", "part").agg(F.sum(loss).alias("lost"))
    every = df.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("part"))
    name = F.get(F.array(*[F.lit(p) for p in parts]), F.col("part"))
    value = F.coalesce("lost", F.lit(0.0)) / (batch_size * length)
    return every.join(found, ["batch", "part"], "left").select("batch", name.alias("part"), value.alias("value"))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``key``, which is not NULL, as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]):
            if held and b > a and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def text_total(losses: DataFrame) -> DataFrame:
    """(batch, value): previous plus next plus own."""
    return losses.groupBy("batch").agg(F.sum("value").alias("value"))
