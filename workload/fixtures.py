"""Inputs of the registered queries, derived from the given tables with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentloom.functions.text import split_sentences, ws_tokens
from sentloom.operators.rank import assign_batches
from sentloom.operators.windows import adjacent_pairs
from sentloom.plans.corpus import text_vocab
from sentloom.session import materialize
from sentloom.sources.tables import read_texts
from sentloom.sources.text import sentences_from_texts

# Sizes the queries use; the SQL counterparts take them from here.
NUM_WORDS = 20_000
BATCH = 32
HALF = 32  # dimensions of each half of an embedding
LANGS = ("en", "de", "fr", "es")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return read_texts(spark, f"{sf}/documents.parquet", "doc_id", ["text", "lang", "source"])


def sentences(spark, sf) -> DataFrame:
    """(doc_id, pos, text): every sentence of every document."""
    return sentences_from_texts(documents(spark, sf), "doc_id")


def corpus(spark, sf) -> DataFrame:
    """(doc_id, pos, tokens)"""
    return sentences(spark, sf).select("doc_id", "pos", ws_tokens("text").alias("tokens"))


def vocab(spark, sf) -> DataFrame:
    return text_vocab(documents(spark, sf), "doc_id", num_words=NUM_WORDS)


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def word_vec(spark, sf) -> DataFrame:
    """(word, id, v): the vocabulary words whose id is a vector's id; a stored table."""
    vectors = embeddings(spark, sf).select(F.col("vec_id").alias("id"), "v")
    return materialize(
        vocab(spark, sf).join(vectors, "id").select("word", F.col("id").cast("int"), "v")
    )


def turns(spark, sf) -> DataFrame:
    """(conv_id, turn, text, tokens)"""
    rows = read_texts(spark, f"{sf}/conversations.parquet", ["conv_id", "turn"], ["role", "text"])
    return rows.withColumn("tokens", ws_tokens(F.lower("text")))


def captions(spark, sf) -> DataFrame:
    """(clip_id, pos, tokens): a document is a clip, each sentence a caption."""
    return corpus(spark, sf).withColumnRenamed("doc_id", "clip_id")


def features(spark, sf) -> DataFrame:
    """(clip_id, v); documents beyond the last vector have no feature."""
    return embeddings(spark, sf).select(F.col("vec_id").alias("clip_id"), "v")


def turn_pairs(spark, sf) -> DataFrame:
    """(conv_id, turn, s1, s2): each turn with the next one."""
    rows = turns(spark, sf).select("conv_id", "turn", F.lower("text").alias("text"))
    return adjacent_pairs(rows, "conv_id", "turn", "text")


def scored_pairs(spark, sf) -> DataFrame:
    """(doc_id, pos, lang, s1, s2, score): sentences that follow each other, with the document's
    quality as score."""
    parts = split_sentences(F.lower("text"))
    rows = (
        documents(spark, sf)
        .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
        .select("doc_id", "lang", F.col("quality").cast("double").alias("score"), parts.alias("s"))
    )
    n = F.greatest(F.size("s") - 1, F.lit(0))
    zipped = F.arrays_zip(
        F.slice("s", F.lit(1), n).alias("s1"), F.slice("s", F.lit(2), n).alias("s2")
    )
    pairs = rows.select("doc_id", "lang", "score", F.posexplode_outer(zipped).alias("pos", "p"))
    return pairs.filter(F.col("pos").isNotNull()).select(
        "doc_id", "pos", "lang", "p.s1", "p.s2", "score"
    )


def vec_pairs(spark, sf) -> DataFrame:
    """(id, x, y): the two halves of each embedding."""
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("id"),
        F.slice("v", 1, HALF).alias("x"),
        F.slice("v", HALF + 1, HALF).alias("y"),
    )


def batched(spark, sf) -> DataFrame:
    return assign_batches(vec_pairs(spark, sf), BATCH, "id")


def wave(rows: int, cols: int, a: int, b: int, scale: float) -> np.ndarray:
    """Weights with a formula both engines can evaluate: sin(a*i + b*j + 1) / scale."""
    i, j = np.indices((rows, cols))
    return np.sin(a * i + b * j + 1.0) / scale


def linear_weights() -> tuple:
    return wave(HALF, HALF, 7, 13, 6.0), wave(1, HALF, 0, 5, 10.0)[0]


def hidden_weights(hidden: int, outputs: int, inputs: int = HALF) -> tuple:
    return (
        wave(inputs, hidden, 7, 13, 6.0),
        wave(1, hidden, 0, 5, 10.0)[0],
        wave(hidden, outputs, 3, 11, 4.0),
        wave(1, outputs, 0, 2, 10.0)[0],
    )
