"""What the write jobs share: the choice of vocabulary, counters seen on the way, evaluation sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sentloom.operators.evaluation import eval_arrays
from sentloom.operators.vocab import build_vocab, word_counts
from sentloom.session import materialize
from sentloom.sources.sinks import write_vocab, write_word_counts
from sentloom.sources.text import union_domains


@dataclass(frozen=True)
class Written:
    """What a write job gives back: its stored vocabulary, and the counters of its rows as they were
    written."""

    vocab: DataFrame
    counters: dict[str, int]


class Counters:
    """Named counts of the rows that pass some points of a plan. They are taken by the job that
    writes these rows, so nothing is read a second time for them."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, counting its rows; ``counts`` are aggregates by name."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[column.alias(name) for name, column in counts.items()])

    def taken(self) -> dict[str, int]:
        """After the rows were written."""
        return {name: int(value or 0) for seen in self._seen for name, value in seen.get.items()}


def choose_vocab(tokens: DataFrame, path: str, num_words: int, vocab: DataFrame | None) -> DataFrame:
    """The given vocabulary, or a new one of the ``tokens`` column with its counts; written below
    ``path`` either way."""
    if vocab is not None:
        write_vocab(vocab, f"{path}/vocab")
        return vocab
    counts = materialize(word_counts(tokens))
    write_word_counts(counts, f"{path}/counts")
    write_vocab(build_vocab(counts, num_words), f"{path}/vocab")
    return tokens.sparkSession.read.parquet(f"{path}/vocab")


def write_eval_sets(sets: dict[str, DataFrame], vocab: DataFrame, path: str, width: int = 50, oov: str = "unk") -> None:
    """Scored pairs (s1, s2, score) of several domains as fixed-width id and mask arrays, in one
    folder per domain; all folders together are the set "all"."""
    rows = union_domains({name: df.select("s1", "s2", "score") for name, df in sets.items()})
    arrays = [f"{side}_{kind}" for side in ("s1", "s2") for kind in ("ids", "mask")]
    found = eval_arrays(rows, vocab, width, oov).select("domain", *arrays, F.col("score").cast("double").alias("score"))
    found.write.mode("overwrite").partitionBy("domain").parquet(path)
