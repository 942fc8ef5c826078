"""Vocabulary expansion as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sentloom.operators.expand import expand_vocab, fit_space_map, paired_spaces
from sentloom.session import materialize
from sentloom.sources.sinks import write_expanded


def expanded_vocabulary(large: DataFrame, own: DataFrame, oov: str = "unk") -> DataFrame:
    """Shared words, fit, map, override. Inputs are (word, id, v)."""
    if oov == "drop":
        return expand_vocab(large, own, None, oov)
    # The shared words are read twice by the fit; they are stored in between.
    fitted = fit_space_map(materialize(paired_spaces(large, own)))
    return expand_vocab(large, own, fitted, oov)


def write_expanded_vocabulary(
    large: DataFrame, own: DataFrame, path: str, oov: str = "unk"
) -> None:
    write_expanded(expanded_vocabulary(large, own, oov), path)
