"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

n-grams of 1 to 3 characters (lower case, runs of other characters than letters as one space) are
hashed to ``FEATURES`` columns. Document frequencies come from all training rows; the weights are
fitted by follow-the-regularised-leader with an elastic-net penalty on a bounded sample, and a
temperature is fitted on a part of the sample that the weights did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.llm.common import free_name, hash_sample, slices

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Different labelled texts of each language, of at most so many bytes, that the classifier is fitted
#: on, and the share kept for the temperature.
FIT_ROWS, FIT_BYTES = 1000, 1 << 16
CALIBRATION_SHARE = 0.2
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTERS[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and their counts over the whole text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    before = np.concatenate([[False], letter[:-1]])
    points = np.concatenate([[np.uint32(32)], points[letter | before], [np.uint32(32)]]).astype(np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    code = np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        code = code[:n] * np.uint32(1_000_003) + points[order - 1 :] + np.uint32(order)
        if order in ORDERS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2_654_435_761)
            counts += np.bincount(mixed >> np.uint32(16), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with letters, and for each feature how many of them have it; tasks add up first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for _, part in slices(batch, "text"):
                for text in part:
                    found = ngram_counts(text.decode())
                    if found:
                        total[found[0]] += 1
                        total[FEATURES] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["feature", "n"])

    sums = texts.select("text").mapInArrow(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    total = np.zeros(FEATURES + 1, np.int64)
    for row in sums.collect():  # one row per feature
        total[row.feature] = row.n
    return int(total[FEATURES]), total[:FEATURES]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        counts = ngram_counts(text)
        if counts is None:
            return None
        values = np.log1p(counts[1]) * self.idf[counts[0]]
        return counts[0], values / max(float(np.sqrt(values @ values)), 1e-12)

    def logits(self, vector: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return vector[1] @ self.weights[vector[0]] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        vector = self.vector(text) if self.languages else None
        if vector is None:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(vector) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class _Ftrl:
    """Proximal follow-the-regularised-leader: per-coordinate rates, weights in closed form."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def step(self, rows, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[rows]
        grown = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = grown


def fit(labelled: DataFrame, n_rows: int = FIT_ROWS) -> Model:
    """Fit on ``n_rows`` texts of each language of ``labelled`` (``text``, ``lang``, both not null), so
    copies and frequent languages don't fill the sample. No rows with letters: a model that answers
    ``und``."""
    n_docs, frequency = document_frequencies(labelled)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    short = labelled.filter(F.octet_length("text") <= FIT_BYTES)
    sample = hash_sample(short.select("text", "lang", F.xxhash64("text", "lang").alias("hash")), n_rows, "lang")
    rows = sorted(((r.hash, r.lang, r.text) for r in sample.toLocalIterator()))
    languages = sorted({lang for _, lang, _ in rows})
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0)
    data = [(v, languages.index(lang)) for _, lang, text in rows if (v := model.vector(text))]
    if not data:
        return Model([], idf, model.weights, model.bias, 1.0)
    held = data[: int(len(data) * CALIBRATION_SHARE)]
    seen = data[len(held) :]
    slopes, offsets = _Ftrl((FEATURES, len(languages))), _Ftrl((1, len(languages)))
    for _ in range(EPOCHS):
        for (rows_, values), label in seen:
            w, b = slopes.weights(rows_), offsets.weights(slice(None))
            error = _softmax(values @ w + b[0])
            error[label] -= 1
            slopes.step(rows_, np.outer(values, error), w)
            offsets.step(slice(None), error[None], b)
    model.weights, model.bias = slopes.weights(slice(None)), offsets.weights(slice(None))[0]
    model.temperature = _temperature(model, held or seen)
    return model


def _temperature(model: Model, data) -> float:
    """The temperature of the least log loss, on a fine scale from 1/20 to 20."""
    logits = np.array([model.logits(v) for v, _ in data])
    labels = np.array([label for _, label in data])
    scale = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in scale]
    return float(scale[int(np.argmin(losses))])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``lang_pred`` and ``score`` (the calibrated probability; 0 where
    the text is null or has no letter). Only the text is looked at. No shuffle."""
    carry = [c for c in df.columns if c != text_col and c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([df.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")
    shared = df.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # plain arrays

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1):
                found = [fitted.predict(text.decode()) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=[*carry, "lang_pred", "score"],
                )

    return df.select(*carry, F.col(text_col).alias(free_name(df, "text"))).mapInArrow(predicted, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` per row of ``docs``. Rows whose
    crc32 of the id (as text; null: empty) leaves 0 modulo 5 are held out of all fitting."""
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(rows.select("doc_id", "held_out", "text"), fit(labelled.select("text", "lang")))
