"""Projections and the recurrent encoder against plain loops."""

import numpy as np
import pytest

from sentloom.operators.dense import GruWeights, encode_gru, project
from sentloom.operators.lookup import lookup_vectors


def weights(dim, units, seed):
    rng = np.random.default_rng(seed)
    return GruWeights(
        *(rng.normal(size=s) for s in ((units, 2 * units), (dim, 2 * units), (units, units), (dim, units)))
    )


def norm(v):
    return (v - v.mean()) / np.sqrt(v.var() + 1e-12)


def loop(seq, k):
    h = np.zeros(k.units)
    for x in seq:
        gates = 1 / (1 + np.exp(-(norm(h @ k.w_h) + norm(x @ k.w_x))))
        z, r = gates[: k.units], gates[k.units :]
        h = (1 - z) * h + z * np.tanh(r * norm(h @ k.u) + norm(x @ k.w))
    return h


@pytest.mark.parametrize("oov", ["unk", "drop"])
@pytest.mark.parametrize("both", [True, False])
def test_gru(spark, oov, both):
    rng = np.random.default_rng(1)
    words = ["<eos>", "<unk>", "a", "b", "c"]
    table = {w: rng.normal(size=3).astype(np.float32).tolist() for w in words}
    word_vec = spark.createDataFrame(
        [(w, i, table[w]) for i, w in enumerate(words)], "word string, id int, v array<float>"
    )
    rows = [(i, [str(w) for w in rng.choice(["a", "b", "c", "x"], size=i % 6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(3)
    fw, bw = weights(3, 4, 2), weights(3, 4, 3) if both else None
    unknown = table["<unk>"] if oov == "unk" else [0.0] * 3
    expected = []
    for _, tokens in rows:
        seq = [np.array(table.get(w, unknown)) for w in tokens]
        parts = [loop(seq, fw)] + ([loop(seq[::-1], bw)] if both else [])
        expected.append(np.concatenate(parts))
    found = encode_gru(df, word_vec, fw, bw, oov).orderBy("k").collect()
    np.testing.assert_allclose([r["v"] for r in found], expected, atol=1e-9)
    looked_up = lookup_vectors(df, word_vec, oov, key=["k"], max_bytes=0)
    again = encode_gru(looked_up, word_vec, fw, bw, oov, "vectors", max_bytes=0).orderBy("k").collect()
    np.testing.assert_allclose([r["v"] for r in again], expected, atol=1e-9)


def test_directions_need_equal_units(spark):
    with pytest.raises(ValueError):
        encode_gru(spark.range(1), spark.range(1), weights(3, 4, 1), weights(3, 2, 1))


def test_project(spark):
    rng = np.random.default_rng(4)
    m, w1, b1 = rng.normal(size=(30, 3)), rng.normal(size=(3, 5)), rng.normal(size=5)
    w2, b2 = rng.normal(size=(5, 2)), rng.normal(size=2)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>")
    linear = project(df, w1, b1).orderBy("id").collect()
    np.testing.assert_allclose([r["projected"] for r in linear], m @ w1 + b1)
    deep = project(df, w1, b1, w2, b2).orderBy("id").collect()
    np.testing.assert_allclose(
        [r["projected"] for r in deep], np.maximum(m @ w1 + b1, 0) @ w2 + b2
    )
