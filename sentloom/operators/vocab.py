"""Word counts, vocabularies and word-vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentloom import EOS, EOS_ID, UNK, UNK_ID
from sentloom.session import materialize


def word_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(word, n) over all rows; counted per task before the shuffle.

    The outer explode keeps the optimizer from tokenising twice, for a filter on the size.
    """
    words = df.select(F.explode_outer(tokens).alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _summary(capacity: int):
    """Arrow lists of tokens → (word, low, error) of one task: at most ``2 * capacity`` words in memory.

    When there are more, the count of the ``capacity``-th most frequent is taken off all counts and
    words without any left go. ``error``, on the one row without word, adds up what was taken
    off: no word has more than that above its ``low``.
    """

    def prune(counts: dict[str, int]) -> tuple[dict[str, int], int]:
        cut = int(np.partition(np.fromiter(counts.values(), np.int64), -capacity)[-capacity])
        return {word: n - cut for word, n in counts.items() if n > cut}, cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        error = 0
        for batch in batches:
            found = batch.column(0).flatten().drop_null().value_counts()
            for word, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > 2 * capacity:
                counts, cut = prune(counts)
                error += cut
        if len(counts) > capacity:
            counts, cut = prune(counts)
            error += cut
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*counts, None], pa.string()),
                pa.array([*counts.values(), 0], pa.int64()),
                pa.array([0] * len(counts) + [error], pa.int64()),
            ],
            names=["word", "low", "error"],
        )

    return run


def frequent_words(
    df: DataFrame, n_words: int, tokens: str = "tokens", capacity: int | None = None
) -> DataFrame:
    """(word, n): exact counts of some words, the ``n_words`` most frequent ones (and all that tie with
    the last) among them, without a shuffle of every task's every word.

    Each task sends a heavy-hitter summary of ``capacity`` words (by default four times the words
    wanted). The sums are lower bounds, and no word has more than E above its own, with E the sum of
    the tasks' errors. With t the lower bound of the last word wanted: if t > E, no word outside the
    summaries can be among the top, nor one below t - E inside, so only the others are counted
    exactly. Else all words are counted. ``df`` is read twice; once if no task had to leave words out.
    """
    sums = materialize(
        df.select(tokens).mapInArrow(_summary(capacity or max(4 * n_words, 1)), "word string, low bigint, error bigint")
        .groupBy("word").agg(F.sum("low").alias("low"), F.sum("error").alias("error"))
    )
    error = sums.filter("word is null").agg(F.sum("error")).first()[0] or 0
    words = sums.filter("word is not null")
    if not error:
        return words.select("word", F.col("low").alias("n"))
    last = words.orderBy(F.desc("low")).limit(n_words).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
    if last["n"] < n_words or last["low"] <= error:
        return word_counts(df, tokens)
    candidates = words.filter(F.col("low") >= last["low"] - error).select("word")
    every = df.select(F.explode_outer(tokens).alias("word")).join(candidates, "word", "left_semi")
    return every.groupBy("word").agg(F.count("*").alias("n"))


def build_vocab(counts: DataFrame, num_words: int = 200_000) -> DataFrame:
    """Top ``num_words - 2`` words by count (ties by word), ids from 2; specials first.

    A histogram of log-scaled counts (at most about a thousand levels) tells below which count
    no word can be among the top, so the sort sees little more than ``num_words`` rows. The
    rank window runs after the limit.
    """
    order = [F.desc("n"), F.asc("word")]
    size = max(num_words - 2, 0)
    level = F.floor(F.log2("n") * 16).cast("int")
    above = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    lowest = (
        counts.groupBy(level.alias("_level"))
        .agg(F.count("*").alias("_words"))
        .withColumn("_sum", F.sum("_words").over(above))
        .filter(F.col("_sum") >= size)
        .agg(F.coalesce(F.max("_level"), F.lit(0)).alias("_lowest"))
    )
    top = counts.filter(level >= lowest.scalar()).orderBy(*order).limit(size)
    words = top.select(
        "word", (F.row_number().over(Window.orderBy(*order)) + 1).cast("int").alias("id")
    )
    special = F.array(
        F.struct(F.lit(EOS).alias("word"), F.lit(EOS_ID).alias("id")),
        F.struct(F.lit(UNK).alias("word"), F.lit(UNK_ID).alias("id")),
    )
    specials = counts.sparkSession.range(1).select(F.inline(special))
    # A corpus word spelled like a special keeps its later id, as in an ordered mapping.
    return specials.unionByName(words).groupBy("word").agg(F.max("id").alias("id"))


def load_vocab(lines: DataFrame, text: str = "text", pos: str = "pos") -> DataFrame:
    """Vocabulary file: id = 0-based line number, first occurrence wins, gaps stay."""
    word = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        lines.select(word.alias("word"), F.col(pos).cast("int").alias("id"))
        .groupBy("word")
        .agg(F.min("id").alias("id"))
    )


def load_embeddings(words: DataFrame, rows: DataFrame, pos: str = "pos") -> DataFrame:
    """i-th word with i-th vector; a repeated word keeps its first place and its last vector."""
    return (
        words.select(pos, "word")
        .join(rows.select(pos, "v"), pos)
        .groupBy("word")
        .agg(F.min(pos).cast("int").alias("id"), F.max_by("v", pos).alias("v"))
    )


def shared_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words in both vocabularies."""
    return a.select("word").intersect(b.select("word"))


def zipf_weights(vocab: DataFrame) -> DataFrame:
    """(id, p) with p = (ln(id+2) - ln(id+1)) / ln(V+1) over the ids of the vocabulary."""
    size = vocab.agg(F.count("*").alias("V")).scalar()
    return vocab.select(
        "word",
        "id",
        ((F.ln(F.col("id") + 2) - F.ln(F.col("id") + 1)) / F.ln(size + 1)).alias("p"),
    )
