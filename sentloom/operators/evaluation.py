"""Scored sentence pairs: fixed-width arrays and correlation with human scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.functions.arrays import length_mask, pad_ids
from sentloom.functions.text import space_tokens, ws_tokens
from sentloom.functions.vectors import cosine
from sentloom.operators.lookup import encode_ids


def eval_arrays(
    df: DataFrame,
    vocab: DataFrame,
    width: int = 50,
    oov: str = "unk",
    text: list[str] | None = None,
    truncate: bool = True,
    single_space: bool = False,
    key: list[str] | None = None,
) -> DataFrame:
    """Columns ``<text>_ids`` and ``<text>_mask`` of ``width`` elements per text column.

    The mask counts all tokens in ``unk`` mode and the known words in ``drop`` mode. Longer
    sentences are cut with ``truncate``, else they are an error.
    """
    text = text or ["s1", "s2"]
    split = space_tokens if single_space else ws_tokens
    tokens = {f"_{t}": split(F.lower(t)) for t in text}
    coded = encode_ids(
        df.withColumns(tokens), vocab, oov, list(tokens), [f"_{t}_ids" for t in text], key=key
    )
    padded = {}
    for t in text:
        ids = F.col(f"_{t}_ids")
        padded[f"{t}_ids"] = pad_ids(ids, width, truncate)
        padded[f"{t}_mask"] = length_mask(F.size(ids), width)
    return coded.withColumns(padded).drop(*tokens, *[f"_{t}_ids" for t in text])


def similarity_pearson(
    df: DataFrame, v1: str = "v1", v2: str = "v2", score: str = "score", by: list[str] | None = None
) -> DataFrame:
    """Pearson correlation of the pair's cosine with the score, over all rows or per group.

    A pair with a zero vector counts with cosine 0. NULL where one side does not vary.
    """
    scored = df.select(
        *(by or []),
        F.coalesce(cosine(v1, v2), F.lit(0.0)).alias("_c"),
        F.col(score).cast("double").alias("_s"),
    )
    spread = F.stddev_pop("_c") * F.stddev_pop("_s")
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.try_divide(F.covar_pop("_c", "_s"), spread).alias("pearson")
    )
