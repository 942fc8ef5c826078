"""Dense models over Arrow batches: projections and the recurrent sentence encoder.

Weights are small inputs (they are not trained here) and are sent to the executors once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.operators.lookup import MAX_BROADCAST_BYTES, _known, _list_array, _lookup
from sentloom.operators.lookup import fits, shared_matrix

# Fixed value: added to the variance in layer normalisation.
LAYER_NORM_EPSILON = 1e-12

# State values worked on at a time.
_STATE_VALUES = 2 << 20


def _rows(lists: pa.Array) -> np.ndarray:
    """List column of equal lengths → matrix, in double."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _vectors(matrix: np.ndarray) -> pa.Array:
    n, dim = matrix.shape
    return _list_array(np.arange(n + 1) * dim, pa.array(matrix.ravel()))


def layers(
    x: np.ndarray,
    w1: np.ndarray,
    b1: np.ndarray,
    w2: np.ndarray | None = None,
    b2: np.ndarray | None = None,
) -> np.ndarray:
    """Linear map of the rows, or linear - ReLU - linear when ``w2`` is given."""
    y = x @ w1 + b1
    return y if w2 is None else np.maximum(y, 0.0) @ w2 + b2


def project(
    df: DataFrame,
    w1: np.ndarray,
    b1: np.ndarray,
    w2: np.ndarray | None = None,
    b2: np.ndarray | None = None,
    v: str = "v",
    out: str = "projected",
) -> DataFrame:
    """Linear map, or linear - ReLU - linear when ``w2`` is given; one product per batch."""
    weights = df.sparkSession.sparkContext.broadcast((w1, b1, w2, b2))

    def apply(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return _vectors(np.zeros((0, 0)))
        return _vectors(layers(_rows(vectors), *weights.value))

    return df.withColumn(out, F.arrow_udf(apply, T.ArrayType(T.DoubleType()))(F.col(v)))


@dataclass(frozen=True)
class GruWeights:
    """Weights of one direction: gates ``w_h`` [u,2u], ``w_x`` [d,2u]; candidate ``u`` [u,u],
    ``w`` [d,u]. There are no bias terms."""

    w_h: np.ndarray
    w_x: np.ndarray
    u: np.ndarray
    w: np.ndarray

    @property
    def units(self) -> int:
        return self.u.shape[0]


def _layer_norm(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + LAYER_NORM_EPSILON)


def _step(x: np.ndarray, h: np.ndarray, k: GruWeights) -> np.ndarray:
    gates = 1.0 / (1.0 + np.exp(-(_layer_norm(h @ k.w_h) + _layer_norm(x @ k.w_x))))
    z, r = gates[:, : k.units], gates[:, k.units :]
    candidate = np.tanh(r * _layer_norm(h @ k.u) + _layer_norm(x @ k.w))
    return h + z * (candidate - h)


def _final_states(
    matrix: np.ndarray, words: np.ndarray, starts: np.ndarray, k: GruWeights, reverse: bool
) -> np.ndarray:
    """Last state per sentence. Sentences are ordered by length, so that each time step works
    on the sentences that still have words, without padding; a slice of them at a time bounds
    the memory for wide states."""
    sizes = np.diff(starts)
    states = np.zeros((len(sizes), k.units))
    longest_first = np.argsort(-sizes, kind="stable")
    step = max(1, _STATE_VALUES // k.units)
    for at in range(0, len(sizes), step):
        order = longest_first[at : at + step]
        begin, size = starts[order], sizes[order]
        h = np.zeros((len(order), k.units))
        for t in range(int(size[0])):
            active = int(np.searchsorted(-size, -t, "left"))
            place = begin[:active] + (size[:active] - 1 - t if reverse else t)
            h[:active] = _step(matrix[words[place]].astype(np.float64), h[:active], k)
        states[order] = h
    return states


def gru_states(
    matrix: np.ndarray, words: np.ndarray, starts: np.ndarray, forward: GruWeights, backward: GruWeights | None
) -> np.ndarray:
    """Last states of the sentences' words (rows of ``matrix``), of both directions side by side."""
    ends = [_final_states(matrix, words, starts, forward, False)]
    if backward is not None:
        ends.append(_final_states(matrix, words, starts, backward, True))
    return np.concatenate(ends, axis=1)


def encode_gru(
    df: DataFrame,
    word_vec: DataFrame,
    forward: GruWeights,
    backward: GruWeights | None = None,
    oov: str = "unk",
    tokens: str = "tokens",
    out: str = "v",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Final state of a layer-normalised GRU over the word vectors.

    With ``backward`` weights the two directions' states are concatenated; both must have the
    same number of units. An empty sentence gives a zero vector; NULL tokens are left out.
    """
    if backward is not None and backward.units != forward.units:
        raise ValueError("both directions need the same number of units")
    context = df.sparkSession.sparkContext
    kernels = context.broadcast((forward, backward))

    def states(matrix: np.ndarray, words: np.ndarray, starts: np.ndarray) -> pa.Array:
        return _vectors(gru_states(matrix, words, starts, *kernels.value))

    if fits(word_vec, max_bytes):
        shared = shared_matrix(word_vec, oov)

        def encode(tokens: pa.Array) -> pa.Array:
            places, matrix = shared.value
            starts, known = _known(tokens)
            return states(matrix, _lookup(known, places, len(matrix) - 1), starts)

        column = F.col(tokens)
    else:
        # The caller has looked the vectors up by join (``lookup_vectors``) into ``tokens``.
        if not isinstance(df.schema[tokens].dataType.elementType, T.ArrayType):
            raise ValueError("word table over the broadcast limit: pass looked-up vectors")

        def encode(tokens: pa.Array) -> pa.Array:
            starts, flat = _known(tokens)
            return states(_rows(flat), np.arange(len(flat)), starts)

        column = F.col(tokens)
    return df.withColumn(out, F.arrow_udf(encode, T.ArrayType(T.DoubleType()))(column))
