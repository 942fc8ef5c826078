"""Captions, pairs and labelled captions → records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.functions.text import shorter_than, ws_tokens
from sentloom.operators.joins import caption_features, with_key
from sentloom.operators.lookup import encode_ids
from sentloom.operators.rank import limit_ordered
from sentloom.operators.windows import cap_per_group
from sentloom.plans.jobs import Counters, Written, choose_vocab
from sentloom.session import materialize, scratch
from sentloom.sources.sinks import write_splits


def _short_rows(rows: DataFrame, tokens: list[str], max_len: int, counters: Counters | None) -> DataFrame:
    """Rows that pass the length rule. With ``counters`` they are stored, which counts them once
    whatever the encoding does with them."""
    short = reduce(and_, [shorter_than(t, max_len) for t in tokens])
    if counters is None:
        return rows.filter(short)
    watched = counters.watch(
        rows,
        sentences_considered=F.count("*"),
        sentences_too_long=F.count_if(~short),
        sentences_output=F.count_if(short),
    )
    return materialize(watched.filter(short))


def _coded_captions(
    captions: DataFrame,
    features: DataFrame,
    vocab: DataFrame,
    out: str,
    oov: str,
    per_clip: int,
    max_len: int,
    add_eos: bool,
    order: str | list[str],
    counters: Counters | None = None,
) -> DataFrame:
    """Captions without feature go first, where they are read if the clip ids fit, then the cap counts,
    then the length rule. Features join only to the captions that are left."""
    keys = [order] if isinstance(order, str) else order
    if counters is not None:
        captions = counters.watch(captions, sentences_seen=F.count("*"))
    with_feature = with_key(captions, features, "clip_id")
    capped = cap_per_group(with_feature, "clip_id", keys, per_clip)
    short = _short_rows(capped, ["tokens"], max_len, counters)
    return encode_ids(short, vocab, oov, "tokens", out, add_eos, key=["clip_id", *keys]).drop(
        "tokens"
    )


def image_records(
    captions: DataFrame,
    features: DataFrame,
    vocab: DataFrame,
    oov: str = "drop",
    per_clip: int = 40,
    max_len: int = 30,
    add_eos: bool = True,
    order: str | list[str] = "pos",
    counters: Counters | None = None,
) -> DataFrame:
    """(clip_id, order, sentence, image) from (clip_id, order, tokens) and (clip_id, v)."""
    coded = _coded_captions(
        captions, features, vocab, "sentence", oov, per_clip, max_len, add_eos, order, counters
    )
    return caption_features(coded, features.select("clip_id", F.col("v").alias("image")))


def clip_records(
    captions: DataFrame,
    clips: DataFrame,
    vocab: DataFrame,
    oov: str = "drop",
    per_clip: int = 40,
    max_len: int = 30,
    add_eos: bool = True,
    order: str | list[str] = "pos",
    counters: Counters | None = None,
) -> DataFrame:
    """(clip_id, order, encode, clip, nb_frames) from (clip_id, order, tokens) and (clip_id,
    frames); the frames are flattened."""
    coded = _coded_captions(
        captions, clips, vocab, "encode", oov, per_clip, max_len, add_eos, order, counters
    )
    flat = clips.select(
        "clip_id",
        F.flatten("frames").alias("clip"),
        F.size("frames").cast("bigint").alias("nb_frames"),
    )
    return caption_features(coded, flat)


def pair_records(
    pairs: DataFrame,
    vocab: DataFrame,
    oov: str = "drop",
    max_len: int = 30,
    add_eos: bool = True,
    key: list[str] | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """Pairs (…, s1, s2) as text → the same with id arrays; both must pass the length rule."""
    rows = pairs.withColumns({"s1": ws_tokens("s1"), "s2": ws_tokens("s2")})
    short = _short_rows(rows, ["s1", "s2"], max_len, counters)
    coded = encode_ids(short, vocab, oov, ["s1", "s2"], ["_1", "_2"], add_eos, key=key)
    return coded.withColumns({"s1": F.col("_1"), "s2": F.col("_2")}).drop("_1", "_2")


def label_records(
    labelled: DataFrame,
    vocab: DataFrame,
    oov: str = "drop",
    max_len: int = 30,
    add_eos: bool = True,
    key: list[str] | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """(…, tokens, obj_id) → (…, encode, feature); the label is a one-element feature."""
    short = _short_rows(labelled, ["tokens"], max_len, counters)
    coded = encode_ids(short, vocab, oov, "tokens", "encode", add_eos, key=key)
    return coded.withColumn("feature", F.array(F.col("obj_id").cast("float"))).drop(
        "tokens", "obj_id"
    )


def write_captions(
    captions: DataFrame,
    features: DataFrame,
    path: str,
    kind: str = "image",
    vocab: DataFrame | None = None,
    num_words: int = 200_000,
    oov: str = "drop",
    per_clip: int = 40,
    max_len: int = 30,
    add_eos: bool = True,
    order: str | list[str] = "pos",
    max_sentences: int = 0,
    **split,
) -> Written:
    """The whole caption job: (clip_id, order, tokens) and features, (clip_id, v) for images or
    (clip_id, frames) for clips → ``vocab``, ``train`` and ``validation`` below ``path``.

    A vocabulary is built of all captions unless one is given. ``max_sentences`` keeps the first
    records by clip and order, 0 all; ``split`` are the options of ``write_splits`` (validation
    rows, shards, seed). Returns the vocabulary and the counters.
    """
    records = {"image": image_records, "clip": clip_records}
    if kind not in records:
        raise ValueError(f"kind must be one of {sorted(records)}, not {kind!r}")
    keys = ["clip_id", *([order] if isinstance(order, str) else order)]
    with scratch(captions.sparkSession):
        vocab = choose_vocab(captions, path, num_words, vocab)
        counters = Counters()
        found = records[kind](captions, features, vocab, oov, per_clip, max_len, add_eos, order, counters)
        write_splits(limit_ordered(found, max_sentences, *keys), path, kind, *keys, **split)
    return Written(vocab, counters.taken())


def write_pairs(
    pairs: DataFrame,
    path: str,
    key: list[str],
    vocab: DataFrame | None = None,
    num_words: int = 200_000,
    oov: str = "drop",
    max_len: int = 30,
    add_eos: bool = True,
    max_sentences: int = 0,
    **split,
) -> Written:
    """The whole pair job: texts (key, s1, s2) → id pairs as train and validation shards; options as
    for :func:`write_captions`. A new vocabulary is of both sides."""
    both = pairs.select(F.concat(ws_tokens("s1"), ws_tokens("s2")).alias("tokens"))
    with scratch(pairs.sparkSession):
        vocab = choose_vocab(both, path, num_words, vocab)
        counters = Counters()
        found = pair_records(pairs, vocab, oov, max_len, add_eos, key, counters)
        write_splits(limit_ordered(found, max_sentences, *key), path, "pair", *key, **split)
    return Written(vocab, counters.taken())


def write_labels(
    labelled: DataFrame,
    path: str,
    key: list[str],
    vocab: DataFrame | None = None,
    num_words: int = 200_000,
    oov: str = "drop",
    max_len: int = 30,
    add_eos: bool = True,
    max_sentences: int = 0,
    **split,
) -> Written:
    """The whole label job: (key, tokens, obj_id) → labelled ids as train and validation shards; options
    as for :func:`write_captions`."""
    with scratch(labelled.sparkSession):
        vocab = choose_vocab(labelled, path, num_words, vocab)
        counters = Counters()
        found = label_records(labelled, vocab, oov, max_len, add_eos, key, counters)
        write_splits(limit_ordered(found, max_sentences, *key), path, "label", *key, **split)
    return Written(vocab, counters.taken())
