"""Vocabulary expansion."""

import numpy as np
import pytest

from sentloom.operators.expand import expand_vocab, fit_space_map, paired_spaces
from sentloom.plans.expansion import expanded_vocabulary


def space(spark, words, matrix):
    rows = [(w, i, [float(x) for x in v]) for i, (w, v) in enumerate(zip(words, matrix))]
    return spark.createDataFrame(rows, "word string, id int, v array<double>")


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(loc=3.0, size=(200, 4))
    y = x @ rng.normal(size=(4, 3)) + 7 + rng.normal(scale=0.1, size=(200, 3))
    words = [f"w{i}" for i in range(200)]
    pairs = paired_spaces(space(spark, words, x).repartition(5), space(spark, words, y))
    fitted = fit_space_map(pairs)
    full, *_ = np.linalg.lstsq(np.hstack([x, np.ones((200, 1))]), y, rcond=None)
    np.testing.assert_allclose(fitted.coef, full[:4], atol=1e-9)
    np.testing.assert_allclose(fitted.intercept, full[4], atol=1e-9)


def test_expansion(spark):
    rng = np.random.default_rng(2)
    shared = [f"w{i}" for i in range(20)]
    large_words = ["big_word", "new", *shared]
    x = rng.normal(size=(22, 3))
    w, b = rng.normal(size=(3, 2)), rng.normal(size=2)
    own_words = ["<eos>", *shared, "own_word", "mine"]
    y = rng.normal(size=(23, 2))
    y[1:21] = x[2:] @ w + b
    large, own = space(spark, large_words, x), space(spark, own_words, y)
    found = expanded_vocabulary(large, own).orderBy("pos").collect()
    # The underscore keeps "big_word" out, but not an own word.
    assert [r["word"] for r in found] == ["new", *shared, "<eos>", "own_word", "mine"]
    assert [r["pos"] for r in found] == list(range(24))
    np.testing.assert_allclose(found[0]["v"], x[1] @ w + b, atol=1e-9)
    np.testing.assert_allclose([r["v"] for r in found[1:21]], y[1:21])
    kept = expanded_vocabulary(large, own, "drop").orderBy("pos").collect()
    assert [r["word"] for r in kept] == own_words
    with pytest.raises(ValueError):
        expand_vocab(large, own, None, "other")
