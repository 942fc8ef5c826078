"""Text → vectors, by one or several models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom import EOS
from sentloom.functions.text import append_eos_word, tokenize
from sentloom.functions.vectors import l2_normalize
from sentloom.operators.dense import GruWeights, encode_gru, gru_states
from sentloom.operators.lookup import (
    MAX_BROADCAST_BYTES,
    _known,
    _list_array,
    _lookup,
    bag_sums,
    encode_bow,
    fits,
    joint_index,
    lookup_vectors,
    table_bytes,
)
from sentloom.operators.pooling import mean_vectors

MODES = ("unk", "drop")


@dataclass(frozen=True)
class SentenceModel:
    """A word table (word, v) and, for the recurrent encoder, its weights.

    ``oov`` names the mode: ``unk`` falls back to the vector of the unknown word, ``drop`` to
    zeros. Without weights the encoder is a bag of vectors.
    """

    word_vec: DataFrame
    oov: str = "drop"
    forward: GruWeights | None = None
    backward: GruWeights | None = None

    def __post_init__(self):
        if self.oov not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.oov!r}")


def _tokenised(df: DataFrame, text: str, use_eos: bool, on_empty: str) -> DataFrame:
    if on_empty not in ("zero", "error"):
        raise ValueError(f"on_empty must be 'zero' or 'error', not {on_empty!r}")
    tokens = tokenize(text)
    if use_eos:
        tokens = append_eos_word(tokens, EOS)
    if on_empty == "error":
        tokens = F.when(F.size(tokens) > 0, tokens).otherwise(
            F.raise_error(F.lit("a text has no tokens"))
        )
    return df.withColumn("_tokens", tokens)


def encode(
    df: DataFrame,
    model: SentenceModel,
    text: str = "text",
    out: str = "v",
    use_norm: bool = False,
    use_eos: bool = False,
    on_empty: str = "zero",
    key: list[str] | None = None,
) -> DataFrame:
    """Tokenise, look up, encode, optionally normalise: no shuffle for a bounded word table.

    A text without tokens gives a zero vector, or an error with ``on_empty="error"``. The
    norm of a zero vector is NULL.
    """
    rows = _tokenised(df, text, use_eos, on_empty)
    if model.forward is None:
        coded = encode_bow(rows, model.word_vec, model.oov, "_tokens", out, key)
    else:
        if not fits(model.word_vec, MAX_BROADCAST_BYTES):
            rows = lookup_vectors(rows, model.word_vec, model.oov, "_tokens", "_tokens_v", key)
            rows = rows.drop("_tokens").withColumnRenamed("_tokens_v", "_tokens")
        coded = encode_gru(
            rows, model.word_vec, model.forward, model.backward, model.oov, "_tokens", out
        )
    coded = coded.drop("_tokens")
    return coded.withColumn(out, l2_normalize(out)) if use_norm else coded


def encode_multi(
    df: DataFrame,
    models: list[SentenceModel],
    text: str = "text",
    out: str = "v",
    use_norm: bool = False,
    use_eos: bool = False,
    on_empty: str = "zero",
    key: list[str] | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """All models' vectors side by side in one array.

    Texts are tokenised once and each word is looked up once, in an index that has its row in every
    model. The word tables of all models together are checked against ``max_bytes``; over it, the
    models run on the same rows one after the other. Nothing is joined below the limit.
    """
    if not models:
        raise ValueError("at least one model is needed")
    if sum(table_bytes(model.word_vec) for model in models) > max_bytes:
        parts = [f"_m{i}" for i in range(len(models))]
        for model, part in zip(models, parts, strict=True):
            df = encode(df, model, text, part, use_norm, use_eos, on_empty, key)
        return df.withColumn(out, F.concat(*parts)).drop(*parts)
    index = joint_index([(model.word_vec, model.oov) for model in models])
    weights = [(model.forward, model.backward) for model in models]
    shared = df.sparkSession.sparkContext.broadcast((index, weights))

    def vectors(tokens: pa.Array) -> pa.Array:
        (index, rows, matrices), weights = shared.value
        starts, known = _known(tokens)
        places = rows[_lookup(known, index, len(rows) - 1)]
        parts = [
            bag_sums(places[:, i], starts, matrix) if forward is None else gru_states(matrix, places[:, i], starts, forward, backward)
            for i, (matrix, (forward, backward)) in enumerate(zip(matrices, weights, strict=True))
        ]
        ends = np.cumsum([p.shape[1] for p in parts])
        whole = np.concatenate(parts, axis=1)
        inner = (np.arange(len(whole))[:, None] * ends[-1] + np.concatenate([[0], ends[:-1]])[None, :]).ravel()
        lists = _list_array(np.append(inner, whole.size), pa.array(whole.ravel()))
        return _list_array(np.arange(len(whole) + 1) * len(parts), lists)

    found = F.arrow_udf(vectors, T.ArrayType(T.ArrayType(T.DoubleType())))("_tokens")
    rows = _tokenised(df, text, use_eos, on_empty).withColumn("_parts", found)
    each = F.transform("_parts", l2_normalize) if use_norm else F.col("_parts")
    return rows.withColumn(out, F.flatten(each)).drop("_tokens", "_parts")


def encode_clips(frames: DataFrame, clip: str = "clip_id", v: str = "v") -> DataFrame:
    """(clip, n, v): mean of the frame vectors, one row per frame on input."""
    return mean_vectors(frames, clip, v)
