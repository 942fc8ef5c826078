"""Corpus → id triples, split and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentloom.functions.text import ws_tokens
from sentloom.operators.lookup import MAX_BROADCAST_BYTES, append_eos, encode_ids, fits, id_encoder
from sentloom.operators.rank import limit_ordered
from sentloom.operators.vocab import build_vocab, word_counts
from sentloom.operators.windows import neighbours, row_triples, usable_triple
from sentloom.plans.jobs import Counters, Written, choose_vocab, write_eval_sets
from sentloom.session import materialize, scratch
from sentloom.sources.sinks import write_splits
from sentloom.sources.text import sentence_arrays

PARTS = ["decode_pre", "encode", "decode_post"]


def corpus_vocab(df: DataFrame, tokens: str = "tokens", num_words: int = 200_000) -> DataFrame:
    """Stored vocabulary of a token column."""
    return materialize(build_vocab(word_counts(df, tokens), num_words))


def text_vocab(
    texts: DataFrame, key: str, text: str = "text", num_words: int = 200_000
) -> DataFrame:
    """Stored vocabulary of a table of whole texts."""
    arrays = sentence_arrays(texts, key, text)
    return corpus_vocab(arrays.select(F.flatten("sentences").alias("tokens")), num_words=num_words)


def id_triples(
    sentences: DataFrame,
    vocab: DataFrame,
    group: str = "file",
    order: str = "pos",
    tokens: str = "tokens",
    oov: str = "unk",
    max_len: int = 30,
    add_eos: bool = False,
    max_bytes: int = MAX_BROADCAST_BYTES,
    counters: Counters | None = None,
) -> DataFrame:
    """Id triples of a sentence table. Each sentence is encoded once and stored, before the window, and
    the window carries ids and the token count (the length rule looks at tokens). ``counters`` counts
    the sentences seen, considered, too long and put out, when the result is written."""
    coded = encode_ids(
        sentences, vocab, oov, tokens, "_ids", add_eos, [group, order], max_bytes
    )
    item = F.struct(F.size(tokens).alias("n"), F.col("_ids").alias("ids"))
    coded = materialize(coded.select(group, order, item.alias("_item")))
    near = neighbours(coded, group, order, "_item")
    items = {"decode_pre": "previous", "encode": "_item", "decode_post": "next"}
    sizes = [F.coalesce(F.col(f"{source}.n"), F.lit(0)) for source in items.values()]
    considered, short = F.least(*sizes) > 0, F.greatest(*sizes) < max_len if max_len else F.lit(True)
    keep = considered & short
    if counters is not None:
        near = counters.watch(
            near,
            sentences_seen=F.count("*"),
            sentences_considered=F.count_if(considered),
            sentences_too_long=F.count_if(considered & ~short),
            sentences_output=F.count_if(keep),
        )
    return near.filter(keep).select(
        group, order, *[F.col(f"{source}.ids").alias(p) for p, source in items.items()]
    )


def text_id_triples(
    texts: DataFrame,
    vocab: DataFrame,
    key: str,
    text: str = "text",
    oov: str = "unk",
    max_len: int = 30,
    add_eos: bool = False,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Id triples of a table of whole texts: one scan, no shuffle.

    All sentences of a text are encoded in one array; the triples are cut from it.
    """
    if not fits(vocab, max_bytes):
        flat = sentence_arrays(texts, key, text).select(
            key, F.posexplode_outer("sentences").alias("pos", "tokens")
        )
        flat = flat.filter(F.col("pos").isNotNull())
        return id_triples(flat, vocab, key, "pos", "tokens", oov, max_len, add_eos, max_bytes)
    encode = id_encoder(vocab, oov, nested=True)
    coded = sentence_arrays(texts, key, text).withColumn("ids", encode("sentences"))
    # Pair every sentence's ids with its token count, so that the length rule can be applied.
    items = F.arrays_zip(
        F.transform("sentences", F.size).alias("n"), F.col("ids").alias("ids")
    )
    raw = row_triples(coded.select(key, items.alias("items")), "items", [key])
    keep = F.lit(True)
    for p in PARTS:
        n = F.col(f"{p}.n")
        keep = keep & (n > 0) & ((n < max_len) if max_len else F.lit(True))
    eos = append_eos if add_eos and oov == "drop" else (lambda ids: ids)
    return raw.filter(keep).select(key, "pos", *[eos(F.col(f"{p}.ids")).alias(p) for p in PARTS])


def text_triples(
    texts: DataFrame, key: str, text: str = "text", max_len: int = 30
) -> DataFrame:
    """Token triples of a table of whole texts, without shuffle."""
    raw = row_triples(sentence_arrays(texts, key, text), "sentences", [key])
    return raw.filter(usable_triple(max_len))


def write_corpus(
    sentences: DataFrame,
    path: str,
    num_words: int = 200_000,
    oov: str = "drop",
    max_len: int = 30,
    n_validation: int = 50_000,
    train_shards: int = 100,
    validation_shards: int = 1,
    seed: int = 123,
    group: str = "file",
    order: str = "pos",
    text: str = "text",
    vocab: DataFrame | None = None,
    max_sentences: int = 0,
    eval_sets: dict[str, DataFrame] | None = None,
) -> Written:
    """The whole job: counts and vocabulary (unless one is given), triples, split, shards.

    ``max_sentences`` keeps only the first triples in file and line order; 0 keeps all (the counters
    are of all sentences). Writes ``counts``, ``vocab``, ``train`` and ``validation`` below ``path``,
    and the scored pairs of ``eval_sets`` as arrays below ``eval``; returns the vocabulary and the
    counters.
    """
    with scratch(sentences.sparkSession):
        tokens = sentences.select(group, order, ws_tokens(text).alias("tokens"))
        vocab = choose_vocab(tokens, path, num_words, vocab)
        if eval_sets:
            write_eval_sets(eval_sets, vocab, f"{path}/eval", oov=oov)
        counters = Counters()
        records = id_triples(tokens, vocab, group, order, "tokens", oov, max_len, counters=counters)
        write_splits(
            limit_ordered(records, max_sentences, group, order),
            path,
            "triple",
            group,
            order,
            n_validation=n_validation,
            train_shards=train_shards,
            validation_shards=validation_shards,
            seed=seed,
        )
    return Written(vocab, counters.taken())
