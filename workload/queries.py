"""One query per operator family. Each takes (spark, folder of the tables)."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentloom.functions import arrays as A
from sentloom.functions import text as X
from sentloom.functions import vectors as V
from sentloom.operators import evaluation, expand, losses, neighbours, sampling, windows
from sentloom.operators.dense import GruWeights, encode_gru, project
from sentloom.operators.lookup import encode_bow, encode_ids, lookup_ids, lookup_vectors
from sentloom.operators.pooling import mean_vectors
from sentloom.operators.rank import (
    assign_batches,
    assign_shards,
    limit_ordered,
    permute_features,
    positional_join,
    ranked,
    shuffle_key,
    split_by_count,
)
from sentloom.operators.vocab import (
    build_vocab,
    frequent_words,
    load_embeddings,
    load_vocab,
    shared_words,
    word_counts,
    zipf_weights,
)
from sentloom.plans import captions as caption_plans
from sentloom.plans import corpus as corpus_plans
from sentloom.plans import encoding, evaluation as evaluation_plans
from sentloom.plans.encoding import SentenceModel
from sentloom.plans.expansion import expanded_vocabulary
from sentloom.session import checkpoint_root, materialize
from sentloom.sources import sets, sinks
from sentloom.sources import text as sources
from workload import fixtures as fx

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def joined(col: Column | str, sep: str = " ") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def outline(v: Column | str) -> list[Column]:
    """A vector as four numbers: first, last, sum of squares, alternating weighted sum."""
    v = F.col(v) if isinstance(v, str) else v
    sums = F.arrow_udf(_outline_sums, "struct<square: double, weighted: double>")(v)
    return [
        r6(F.get(v, F.lit(0))).alias("v_first"),
        r6(F.element_at(v, -1)).alias("v_last"),
        r6(sums["square"]).alias("v_square"),
        r6(sums["weighted"]).alias("v_weighted"),
    ]


def _outline_sums(lists: pa.Array) -> pa.Array:
    """Both sums of every vector of a batch, added in the order of the elements; NULL for a NULL vector
    or one with a NULL element."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    flat = lists.flatten()
    absent = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
    square, weighted = np.zeros((2, len(sizes)))
    null = lists.is_null().to_numpy(zero_copy_only=False)[order]
    falling = -sizes[order]
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(falling, -i, "left"))
        x = values[begin[:n] + i].astype(np.float64)
        square[:n] += x * x
        weighted[:n] += x * (i % 7 + 1)
        if absent is not None:
            null[:n] |= absent[begin[:n] + i]
    back = np.argsort(order, kind="stable")
    found = [pa.array(total[back], mask=null[back]) for total in (square, weighted)]
    return pa.StructArray.from_arrays(found, names=["square", "weighted"])


# --- sources and text ---------------------------------------------------------------------


@query
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentences(spark, sf).select("doc_id", "pos", "text")


@query
def sentence_files(spark, sf):
    """All sentences written to text files in order, and read again with file and line number;
    the rank over both is the rank in the documents."""
    path = _fresh_path(spark)
    rows = fx.sentences(spark, sf).repartitionByRange("doc_id", "pos")
    rows.sortWithinPartitions("doc_id", "pos").select("text").write.text(path)
    lines = sources.read_sentences(spark, f"{path}/*.txt")
    return ranked(lines, "file", "pos").select("rank", "text")


@query
def scored_files(spark, sf):
    """Scored pairs written as tab-separated lines and read again."""
    path = _fresh_path(spark)
    line = F.concat_ws(
        "\t",
        F.replace("s1", F.lit("\t"), F.lit(" ")),
        F.replace("s2", F.lit("\t"), F.lit(" ")),
        F.col("score").cast("string"),
    )
    fx.scored_pairs(spark, sf).select(line).write.text(path)
    return sources.read_scored_pairs(spark, [path], header=False)


@query
def scored_files_header(spark, sf):
    """The same with an id column and a header line in every file."""
    path = _fresh_path(spark)
    fields = [F.replace(c, F.lit("\t"), F.lit(" ")).alias(c) for c in ("s1", "s2")]
    pairs = fx.scored_pairs(spark, sf).select(
        F.concat_ws("-", "doc_id", "pos").alias("pair_id"), *fields, "score"
    )
    pairs.write.option("sep", "\t").option("quote", "").option("header", "true").csv(path)
    return sources.read_scored_pairs(spark, [path])


@query
def ws_tokens(spark, sf):
    return fx.corpus(spark, sf).select(
        "doc_id", "pos", F.size("tokens").alias("n"), joined("tokens").alias("tokens")
    )


@query
def space_tokens(spark, sf):
    tokens = X.lower_tokens(X.space_tokens("text"))
    return fx.turns(spark, sf).select(
        "conv_id", "turn", F.size(tokens).alias("n"), joined(tokens, "|").alias("tokens")
    )


@query
def clean_caption(spark, sf):
    tokens = X.clean_caption("text")
    return fx.documents(spark, sf).select(
        "doc_id", F.size(tokens).alias("n"), joined(tokens).alias("tokens")
    )


@query
def tokenize(spark, sf):
    tokens = X.append_eos_word(X.tokenize("text"))
    return fx.documents(spark, sf).select(
        "doc_id", F.size(tokens).alias("n"), joined(tokens).alias("tokens")
    )


@query
def tagged_tokens(spark, sf):
    # Every token tagged with its document's source; the tokens that hold a slash drop out.
    docs = fx.documents(spark, sf).select("doc_id", "text", "source")
    line = F.array_join(
        F.transform(X.ws_tokens("text"), lambda t: F.concat(t, F.lit("/"), F.col("source"))), " "
    )
    tokens = X.tagged_tokens("line")
    return docs.select("doc_id", line.alias("line")).select(
        "doc_id", F.size(tokens).alias("n"), joined(tokens).alias("tokens")
    )


def _caption_lines(spark, sf, sep: str) -> DataFrame:
    """``conv_id <sep> text``; the lines of system turns have no separator."""
    return fx.turns(spark, sf).select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.replace("text", F.lit(sep), F.lit("")))
        .otherwise(F.concat(F.col("conv_id").cast("string"), F.lit(sep), "text"))
        .alias("text"),
    )


@query
def captions_tab(spark, sf):
    rows = sources.read_captions(_caption_lines(spark, sf, "\t"))
    return rows.select("conv_id", "turn", "clip_id", joined("tokens").alias("tokens"))


@query
def captions_spaces(spark, sf):
    rows = sources.read_captions(_caption_lines(spark, sf, "    "), sources.FOUR_SPACES)
    return rows.select("conv_id", "turn", "clip_id", joined("tokens").alias("tokens"))


@query
def pair_lines(spark, sf):
    lines = fx.turn_pairs(spark, sf).select(
        "conv_id", "turn", F.concat("s1", F.lit("\t"), "s2", F.lit("\n")).alias("text")
    )
    return sources.read_pairs(lines).select("conv_id", "turn", "s1", "s2")


def _labelled(spark, sf) -> DataFrame:
    labels = fx.embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    lines = (
        fx.sentences(spark, sf)
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "pos",
            F.concat(
                F.replace("text", F.lit("\t"), F.lit(" ")),
                F.lit("\t"),
                F.coalesce(F.col("label").cast("string"), F.lit("none")),
            ).alias("text"),
        )
    )
    return sources.read_labelled(lines)


@query
def labelled_onehot(spark, sf):
    return _labelled(spark, sf).select(
        "doc_id",
        "pos",
        "obj_id",
        joined("tokens").alias("tokens"),
        joined(A.one_hot("obj_id", 80), "").alias("one_hot"),
    )


@query
def union_domains(spark, sf):
    pairs = materialize(fx.scored_pairs(spark, sf))
    langs = [r.lang for r in pairs.select("lang").distinct().collect()]
    parts = {lang: pairs.filter(F.col("lang").eqNullSafe(F.lit(lang))).drop("lang") for lang in langs}
    return sources.union_domains(parts).select("doc_id", "pos", "domain", "s1", "s2", "score")


# --- vocabulary ---------------------------------------------------------------------------


@query
def word_counts_all(spark, sf):
    return word_counts(fx.corpus(spark, sf))


@query
def vocabulary(spark, sf):
    return build_vocab(word_counts(fx.corpus(spark, sf)), fx.NUM_WORDS)


@query
def vocabulary_summaries(spark, sf):
    """``vocabulary`` from heavy-hitter summaries of the tasks."""
    return build_vocab(frequent_words(fx.corpus(spark, sf), fx.NUM_WORDS - 2), fx.NUM_WORDS)


def _word_lines(spark, sf) -> DataFrame:
    """The words of all turns in order, one per line: (pos, text)."""
    words = fx.turns(spark, sf).select(
        "conv_id", "turn", F.posexplode("tokens").alias("i", "text")
    )
    return ranked(words, "conv_id", "turn", "i", name="pos").select("pos", "text")


@query
def vocabulary_file(spark, sf):
    return load_vocab(_word_lines(spark, sf))


@query
def embedding_file(spark, sf):
    words = _word_lines(spark, sf).withColumnRenamed("text", "word")
    rows = fx.embeddings(spark, sf).select(F.col("vec_id").alias("pos"), "v")
    return load_embeddings(words, rows).select("word", "id", *outline("v"))


@query
def shared_vocabulary(spark, sf):
    docs = word_counts(fx.corpus(spark, sf))
    talk = word_counts(fx.turns(spark, sf))
    return shared_words(docs, talk)


@query
def zipf(spark, sf):
    words = build_vocab(word_counts(fx.corpus(spark, sf)), fx.NUM_WORDS)
    return zipf_weights(materialize(words)).select("word", "id", F.round("p", 9).alias("p"))


# --- ids and triples ----------------------------------------------------------------------


@query
def encode_ids_unk(spark, sf):
    coded = encode_ids(fx.corpus(spark, sf), fx.vocab(spark, sf), "unk")
    return coded.select("doc_id", "pos", joined("ids").alias("ids"))


@query
def encode_ids_drop(spark, sf):
    coded = encode_ids(fx.corpus(spark, sf), fx.vocab(spark, sf), "drop", add_eos=True)
    return coded.select("doc_id", "pos", joined("ids").alias("ids"))


@query
def encode_ids_joined(spark, sf):
    """``encode_ids_drop`` by the join that a vocabulary over the limit takes."""
    coded = encode_ids(
        fx.corpus(spark, sf), fx.vocab(spark, sf), "drop", add_eos=True, key=["doc_id", "pos"], max_bytes=0
    )
    return coded.select("doc_id", "pos", joined("ids").alias("ids"))


@query
def triples(spark, sf):
    found = corpus_plans.text_triples(fx.documents(spark, sf), "doc_id")
    return found.select("doc_id", "pos", *[joined(p).alias(p) for p in corpus_plans.PARTS])


@query
def triples_ids(spark, sf):
    found = corpus_plans.text_id_triples(
        fx.documents(spark, sf), fx.vocab(spark, sf), "doc_id", oov="unk"
    )
    return found.select("doc_id", "pos", *[joined(p).alias(p) for p in corpus_plans.PARTS])


@query
def turn_triples(spark, sf):
    # Turns are whole messages, longer than sentences: the length rule is set accordingly.
    found = windows.triples(fx.turns(spark, sf), "conv_id", "turn", max_len=200)
    return found.select("conv_id", "turn", *[joined(p).alias(p) for p in corpus_plans.PARTS])


@query
def sentence_row_triples(spark, sf):
    found = corpus_plans.id_triples(
        fx.corpus(spark, sf), fx.vocab(spark, sf), "doc_id", "pos", oov="drop", add_eos=True
    )
    return found.select("doc_id", "pos", *[joined(p).alias(p) for p in corpus_plans.PARTS])


@query
def corpus_stats(spark, sf):
    return windows.row_triple_stats(sources.sentence_arrays(fx.documents(spark, sf), "doc_id"))


@query
def corpus_job_stats(spark, sf):
    """The counters that the whole corpus job takes while it writes its triples."""
    rows = fx.sentences(spark, sf)
    written = corpus_plans.write_corpus(rows, _fresh_path(spark), fx.NUM_WORDS, "unk", group="doc_id")
    return spark.createDataFrame([written.counters])


@query
def caption_job_stats(spark, sf):
    """The counters of the whole caption job."""
    written = caption_plans.write_captions(
        fx.captions(spark, sf), fx.features(spark, sf), _fresh_path(spark), num_words=fx.NUM_WORDS, n_validation=100
    )
    return spark.createDataFrame([written.counters])


@query
def turn_stats(spark, sf):
    near = windows.neighbours(fx.turns(spark, sf), "conv_id", "turn", "tokens")
    return windows.triple_stats(near, max_len=60)


@query
def pair_stats(spark, sf):
    tokens = {"s1": X.ws_tokens("s1"), "s2": X.ws_tokens("s2")}
    return windows.length_stats(fx.turn_pairs(spark, sf).withColumns(tokens), ["s1", "s2"])


@query
def first_triples(spark, sf):
    found = corpus_plans.text_triples(fx.documents(spark, sf), "doc_id")
    top = limit_ordered(found, 1000, "doc_id", "pos")
    return top.select("doc_id", "pos", joined("encode").alias("encode"))


# --- captions and pairs -------------------------------------------------------------------


@query
def captions_capped(spark, sf):
    capped = windows.cap_per_group(fx.captions(spark, sf), "clip_id", "pos", 40)
    return capped.filter(X.shorter_than("tokens", 30)).select(
        "clip_id", "pos", joined("tokens").alias("tokens")
    )


@query
def caption_stats(spark, sf):
    return windows.caption_stats(fx.captions(spark, sf), fx.features(spark, sf))


@query
def captions_bucketed(spark, sf):
    """``captions_features`` with the features stored in buckets by clip."""
    features = sinks.store_bucketed(fx.features(spark, sf), "clip_id")
    found = caption_plans.image_records(fx.captions(spark, sf), features, fx.vocab(spark, sf))
    return found.select("clip_id", "pos", joined("sentence").alias("sentence"), *outline("image"))


@query
def captions_features(spark, sf):
    found = caption_plans.image_records(
        fx.captions(spark, sf), fx.features(spark, sf), fx.vocab(spark, sf)
    )
    return found.select("clip_id", "pos", joined("sentence").alias("sentence"), *outline("image"))


def _clips(spark, sf) -> DataFrame:
    """(clip_id, frames): eight vectors in order are the frames of one clip."""
    frames = assign_batches(fx.embeddings(spark, sf), 8, "vec_id")
    return frames.groupBy(F.col("batch").alias("clip_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("row", "v"))), lambda s: s["v"]
        ).alias("frames")
    )


@query
def captions_clips(spark, sf):
    found = caption_plans.clip_records(
        fx.captions(spark, sf), materialize(_clips(spark, sf)), fx.vocab(spark, sf), "unk"
    )
    return found.select(
        "clip_id", "pos", "nb_frames", joined("encode").alias("encode"), *outline("clip")
    )


@query
def captions_positional(spark, sf):
    # i-th turn with the i-th labelled document, whose id names the image row.
    lines = fx.turns(spark, sf).select("conv_id", "turn")
    indices = fx.table(spark, sf, "labels").select("doc_id")
    placed = positional_join(lines, indices, ["conv_id", "turn"], ["doc_id"])
    images = ranked(fx.embeddings(spark, sf), "vec_id", name="doc_id")
    return placed.join(images.select("doc_id", "v"), "doc_id").select(
        "conv_id", "turn", "position", "doc_id", *outline("v")
    )


@query
def pairs_ids(spark, sf):
    coded = caption_plans.pair_records(
        fx.turn_pairs(spark, sf), fx.vocab(spark, sf), max_len=60, key=["conv_id", "turn"]
    )
    return coded.select("conv_id", "turn", joined("s1").alias("s1"), joined("s2").alias("s2"))


@query
def labelled_ids(spark, sf):
    coded = caption_plans.label_records(_labelled(spark, sf), fx.vocab(spark, sf))
    return coded.select(
        "doc_id", "pos", joined("encode").alias("encode"), r6(F.get("feature", F.lit(0))).alias("label")
    )


@query
def caption_pairs(spark, sf):
    rows = fx.sentences(spark, sf)
    return windows.adjacent_pairs(rows, "doc_id", "pos", "text").select("doc_id", "pos", "s1", "s2")


# --- order, split, shards, batches ----------------------------------------------------------


@query
def train_validation_split(spark, sf):
    rows = fx.corpus(spark, sf).withColumn("key", shuffle_key(123, "doc_id", "pos"))
    return split_by_count(rows, 5000, "key", "doc_id", "pos").select("doc_id", "pos", "split")


@query
def shards(spark, sf):
    rows = fx.corpus(spark, sf).select("doc_id", "pos")
    return assign_shards(rows, "doc_id", "pos", n_validation=5000, train_shards=100).select(
        "doc_id", "pos", "split", "rank", "shard"
    )


@query
def stored_records(spark, sf):
    """Pairs written as shards and read again as records of their kind."""
    tokens = {"t1": X.ws_tokens("s1"), "t2": X.ws_tokens("s2")}
    pairs = fx.turn_pairs(spark, sf).withColumns(tokens).drop("s1", "s2")
    coded = encode_ids(pairs, fx.vocab(spark, sf), "unk", ["t1", "t2"], ["s1", "s2"])
    placed = sinks.to_records(
        sinks.shards(coded, 10, "conv_id", "turn"), "pair", "rank", "shard"
    )
    path = _fresh_path(spark)
    sinks.write_shards(placed, path, "pairs", 10)
    stored = sources.read_records(spark, [f"{path}/shard=pairs-*"], "pair")
    return stored.select(joined("s1").alias("s1"), joined("s2").alias("s2"))


@query
def stored_set(spark, sf):
    """The pairs of ``stored_records`` committed as a set, checked and read again."""
    tokens = {"t1": X.ws_tokens("s1"), "t2": X.ws_tokens("s2")}
    pairs = fx.turn_pairs(spark, sf).withColumns(tokens).drop("s1", "s2")
    coded = encode_ids(pairs, fx.vocab(spark, sf), "unk", ["t1", "t2"], ["s1", "s2"])
    path = _fresh_path(spark)
    sets.write_set(coded, path, "pair", "conv_id", "turn", n_validation=20, train_shards=10)
    parts = [sets.read_set(spark, path, split, verify=True) for split in sets.SPLITS]
    return parts[0].unionByName(parts[1]).select(joined("s1").alias("s1"), joined("s2").alias("s2"))


@query
def stored_images(spark, sf):
    """Captions with their features written as train and validation shards, and read again."""
    found = caption_plans.image_records(
        fx.captions(spark, sf), fx.features(spark, sf), fx.vocab(spark, sf)
    )
    path = _fresh_path(spark)
    sinks.write_splits(
        found, path, "image", "clip_id", "pos", n_validation=100, train_shards=10
    )
    return _stored_splits(spark, path, "image", lambda df: df.select(
        "split", joined("sentence").alias("sentence"), *outline("image")))


@query
def stored_labels(spark, sf):
    """Labelled texts written as train and validation shards, and read again."""
    found = caption_plans.label_records(_labelled(spark, sf), fx.vocab(spark, sf))
    path = _fresh_path(spark)
    sinks.write_splits(
        found, path, "label", "doc_id", "pos", n_validation=100, train_shards=4
    )
    return _stored_splits(spark, path, "label", lambda df: df.select(
        "split", joined("encode").alias("encode"), r6(F.get("feature", F.lit(0))).alias("feature")))


def _stored_splits(spark, path: str, kind: str, shown) -> DataFrame:
    parts = [
        shown(sources.read_records(spark, [f"{path}/{split}/shard={split}-*"], kind)
              .withColumn("split", F.lit(split)))
        for split in ("train", "validation")
    ]
    return parts[0].unionByName(parts[1])


@query
def stored_vocabulary(spark, sf):
    """The vocabulary and the counts of all words, written and read again."""
    path = _fresh_path(spark)
    sinks.write_vocab(fx.vocab(spark, sf), f"{path}/vocab")
    sinks.write_word_counts(word_counts(fx.corpus(spark, sf)), f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts").select(F.lit("count").alias("kind"), "word", "n")
    words = spark.read.parquet(f"{path}/vocab").select(
        F.lit("id").alias("kind"), "word", F.col("id").cast("bigint").alias("n")
    )
    return counts.unionByName(words)


@query
def stored_expansion(spark, sf):
    """``expand_vocab`` written and read again."""
    large, own = _spaces(spark, sf)
    fixed = expand.SpaceMap(fx.wave(16, 16, 7, 13, 6.0), fx.wave(1, 16, 0, 5, 10.0)[0])
    path = _fresh_path(spark)
    sinks.write_expanded(expand.expand_vocab(large, own, fixed), path)
    return spark.read.parquet(path).select("pos", "word", *outline("v"))


def _fresh_path(spark) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/records-{uuid.uuid4().hex}"


@query
def batches(spark, sf):
    rows = fx.corpus(spark, sf).select("doc_id", "pos")
    return assign_batches(rows, 128, "doc_id", "pos").select("doc_id", "pos", "batch", "row")


@query
def permuted_features(spark, sf):
    rows = permute_features(fx.embeddings(spark, sf).select("vec_id", "v"), "vec_id", "v")
    return rows.select("vec_id", *outline("v"))


# --- arrays ---------------------------------------------------------------------------------


@query
def padded_ids(spark, sf):
    """Ids padded to the longest sentence of their batch, with the mask."""
    coded = encode_ids(fx.corpus(spark, sf), fx.vocab(spark, sf), "drop")
    rows = assign_batches(coded.select("doc_id", "pos", "ids"), 128, "doc_id", "pos")
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    return rows.withColumn("width", width).select(
        "doc_id",
        "pos",
        "width",
        joined(A.pad_ids("ids", F.col("width"))).alias("ids"),
        joined(A.length_mask(F.size("ids"), F.col("width")), "").alias("mask"),
    )


@query
def eval_arrays(spark, sf):
    found = evaluation.eval_arrays(fx.scored_pairs(spark, sf), fx.vocab(spark, sf), 50, "unk")
    cols = ["s1_ids", "s1_mask", "s2_ids", "s2_mask"]
    return found.select("doc_id", "pos", "score", *[joined(c).alias(c) for c in cols])


@query
def eval_arrays_drop(spark, sf):
    found = evaluation.eval_arrays(
        fx.turn_pairs(spark, sf), fx.vocab(spark, sf), 70, "drop", single_space=True
    )
    cols = ["s1_ids", "s1_mask", "s2_ids", "s2_mask"]
    return found.select("conv_id", "turn", *[joined(c).alias(c) for c in cols])


@query
def shifted_ids(spark, sf):
    """Decoder input: a zero step first, the last step dropped; and the last step itself."""
    coded = encode_ids(fx.turns(spark, sf), fx.vocab(spark, sf), "unk")
    return coded.select(
        "conv_id",
        "turn",
        joined(A.shift_right("ids", F.lit(0))).alias("input"),
        A.gather("ids", F.size("ids") - 1).alias("last"),
    )


@query
def regrouped(spark, sf):
    """A vector cut into steps of 16, every second step masked, and flattened again."""
    steps = A.regroup("v", 16)
    masked = A.apply_mask(
        F.transform(steps, lambda s: F.transform(s, lambda x: x.cast("double"))),
        F.array(*[F.lit(m) for m in (1, 0, 1, 0)]),
    )
    return fx.embeddings(spark, sf).select(
        "vec_id",
        F.size(steps).alias("steps"),
        r6(F.get(A.gather(steps, F.lit(2)), F.lit(0))).alias("third_step"),
        *outline(F.flatten(masked)),
    )


# --- vectors ----------------------------------------------------------------------------------


@query
def word_vectors(spark, sf):
    """Sequence of word vectors per turn, with the unknown word's vector as fallback."""
    found = lookup_vectors(fx.turns(spark, sf), fx.word_vec(spark, sf), "unk")
    return found.select(
        "conv_id", "turn", F.posexplode("vectors").alias("i", "v")
    ).select("conv_id", "turn", "i", *outline("v"))


@query
def word_vectors_joined(spark, sf):
    """``word_vectors`` by the join, its rows numbered for want of a key."""
    found = lookup_vectors(fx.turns(spark, sf), fx.word_vec(spark, sf), "unk", max_bytes=0)
    return found.select(
        "conv_id", "turn", F.posexplode("vectors").alias("i", "v")
    ).select("conv_id", "turn", "i", *outline("v"))


@query
def id_vectors(spark, sf):
    """Vectors by id; an id without a vector gets zeros."""
    coded = encode_ids(fx.turns(spark, sf), fx.vocab(spark, sf), "unk")
    table = fx.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "v")
    return (
        lookup_ids(coded, table)
        .select("conv_id", "turn", F.posexplode("vectors").alias("i", "v"))
        .select("conv_id", "turn", "i", *outline("v"))
    )


@query
def mean_pool(spark, sf):
    """One clip per label, its vectors are the frames."""
    return mean_vectors(fx.embeddings(spark, sf), "label").select(
        "label", F.col("n").cast("bigint").alias("n"), *outline("v")
    )


@query
def padded_clips(spark, sf):
    """Clips of eight frames in order, padded to ten, flattened; and their mean."""
    return _clips(spark, sf).select(
        F.col("clip_id").alias("batch"),
        F.size("frames").alias("n"),
        F.size(A.pad_flat("frames", 10, 64)).alias("padded"),
        r6(V.dot(A.pad_flat("frames", 10, 64), A.pad_flat("frames", 10, 64))).alias("flat_square"),
        r6(F.get(A.pad_flat("frames", 10, 64), F.lit(64))).alias("second_frame"),
        *outline(V.mean_pool("frames", 64)),
    )


@query
def padded_vectors(spark, sf):
    """The clips' frames as sequences of vectors, padded to ten, with the mask."""
    return _clips(spark, sf).select(
        F.col("clip_id").alias("batch"),
        joined(A.length_mask(F.size("frames"), 10), "").alias("mask"),
        F.size(A.pad_vectors("frames", 10, 64)).alias("padded"),
        *outline(F.flatten(A.pad_vectors("frames", 10, 64))),
    )


@query
def sentence_bow(spark, sf):
    coded = encode_bow(fx.corpus(spark, sf), fx.word_vec(spark, sf), "drop")
    return coded.select("doc_id", "pos", *outline("v"))


@query
def bow_joined(spark, sf):
    """``sentence_bow`` by the join."""
    coded = encode_bow(
        fx.corpus(spark, sf), fx.word_vec(spark, sf), "drop", key=["doc_id", "pos"], max_bytes=0
    )
    return coded.select("doc_id", "pos", *outline("v"))


@query
def encoded_texts(spark, sf):
    """Tokenise, look up with the unknown word's vector, sum, normalise."""
    model = SentenceModel(fx.word_vec(spark, sf), "unk")
    texts = fx.documents(spark, sf).select("doc_id", "text")
    return encoding.encode(texts, model, use_norm=True, use_eos=True).select(
        "doc_id", *outline("v")
    )


@query
def encoded_multi(spark, sf):
    words = fx.word_vec(spark, sf)
    models = [SentenceModel(words, "drop"), SentenceModel(words, "unk")]
    turns = fx.turns(spark, sf).select("conv_id", "turn", "text")
    coded = encoding.encode_multi(turns, models, use_eos=False)
    return coded.select("conv_id", "turn", F.size("v").alias("dim"), *outline("v"))


@query
def unit_vectors(spark, sf):
    return fx.embeddings(spark, sf).select("vec_id", *outline(V.l2_normalize("v")))


@query
def cosine_pairs(spark, sf):
    return fx.vec_pairs(spark, sf).select(
        "id", r6(V.cosine("x", "y")).alias("cosine"), r6(V.dot("x", "y")).alias("dot")
    )


@query
def nearest(spark, sf):
    found = neighbours.knn(fx.embeddings(spark, sf), 10, "vec_id")
    return found.select("id", "neighbour", "rank", r6("similarity").alias("similarity"))


@query
def nearest_indexed(spark, sf):
    """``nearest`` through the pivot index, in small blocks."""
    found = neighbours.knn(fx.embeddings(spark, sf), 10, "vec_id", rows_per_block=256, max_bytes=0)
    return found.select("id", "neighbour", "rank", r6("similarity").alias("similarity"))


@query
def nearest_of_label(spark, sf):
    """The vectors of one label against all vectors, which stay where they are."""
    vectors = fx.embeddings(spark, sf)
    found = neighbours.knn_queries(vectors.filter(F.col("label") == 0), vectors, 10, "vec_id")
    return found.select("id", "neighbour", "rank", r6("similarity").alias("similarity"))


@query
def neighbour_overlap(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    x = pairs.select("id", F.col("x").alias("v"))
    y = pairs.select("id", F.col("y").alias("v"))
    found = neighbours.neighbour_overlap(x, y, 10)
    return found.select("n", "shared", r6("overlap").alias("overlap"))


@query
def overlap_report(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    x = pairs.select("id", F.col("x").alias("v"))
    y = pairs.select("id", F.col("y").alias("v"))
    mapped = project(x, *fx.linear_weights(), out="v")
    found = neighbours.overlap_report(x, mapped, y, 10)
    return found.select("comparison", "n", "shared", r6("overlap").alias("overlap"))


@query
def similarity_moments(spark, sf):
    found = neighbours.similarity_moments(fx.embeddings(spark, sf))
    return found.select("n", r6("mean").alias("mean"), r6("mean_square").alias("mean_square"))


@query
def similarity_pearson(spark, sf):
    """Cosine of two sentences' bags of vectors against the score, per language."""
    words = fx.word_vec(spark, sf)
    pairs = fx.scored_pairs(spark, sf).withColumns(
        {"t1": X.ws_tokens("s1"), "t2": X.ws_tokens("s2")}
    )
    coded = encode_bow(encode_bow(pairs, words, "drop", "t1", "v1"), words, "drop", "t2", "v2")
    found = evaluation.similarity_pearson(coded, by=["lang"])
    return found.select("lang", "n", r6("pearson").alias("pearson"))


@query
def neighbour_pairs(spark, sf):
    """Each document that has a vector with the texts of its three nearest."""
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    vectors = fx.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "v")
    with_text = vectors.join(docs.select("id"), "id", "left_semi")
    return neighbours.neighbour_pairs(docs, with_text, 3)


# --- metrics ----------------------------------------------------------------------------------


def _by_batch(found: DataFrame) -> DataFrame:
    return found.select("batch", "n", r6("value").alias("value"))


@query
def batch_negatives(spark, sf):
    found = losses.batch_negatives(fx.batched(spark, sf))
    return found.select("id", "batch", "row", "negative")


@query
def ranking_loss(spark, sf):
    return _by_batch(losses.ranking_loss(fx.batched(spark, sf)))


@query
def ranking_loss_projected(spark, sf):
    mapped = losses.projected(fx.batched(spark, sf), fx.hidden_weights(16, fx.HALF))
    return _by_batch(losses.ranking_loss(mapped))


@query
def element_l2(spark, sf):
    return _by_batch(losses.element_l2(fx.batched(spark, sf)))


@query
def structure_alignment(spark, sf):
    rows = fx.batched(spark, sf)
    parts = [
        losses.structure_alignment(rows, kind).select(
            F.lit(kind).alias("kind"), "batch", "n", r6("value").alias("value")
        )
        for kind in losses.ALIGNMENTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def match_pairs(spark, sf):
    found = losses.match_pairs(fx.batched(spark, sf))
    return found.select("batch", "row", "label", r6(V.dot("x", "y")).alias("dot"))


@query
def contrast_scores(spark, sf):
    return _by_batch(losses.contrast_scores(fx.batched(spark, sf)))


@query
def match_classifier(spark, sf):
    weights = fx.hidden_weights(8, 2, 2 * fx.HALF)
    return _by_batch(losses.match_classifier(fx.batched(spark, sf), *weights))


@query
def projected_vectors(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    linear = project(pairs, *fx.linear_weights(), v="x", out="p")
    deep = project(pairs, *fx.hidden_weights(16, fx.HALF), v="x", out="p")
    return linear.select("id", F.lit(0).alias("layers"), *outline("p")).unionByName(
        deep.select("id", F.lit(1).alias("layers"), *outline("p"))
    )


@query
def pair_metrics_projected(spark, sf):
    """All metrics, those on projected vectors too, in one pass."""
    weights = fx.hidden_weights(16, fx.HALF)
    found = evaluation_plans.pair_metrics(fx.batched(spark, sf), weights)
    return found.select("metric", r6("value").alias("value"))


TOTAL_WEIGHTS = {"ranking": 0.5, "rho": 1.0, "l2": 0.0, "quick": 2.0}


@query
def weighted_total(spark, sf):
    found = evaluation_plans.total_loss(fx.batched(spark, sf), TOTAL_WEIGHTS)
    return found.select(r6("total").alias("total"))


@query
def split_metrics(spark, sf):
    """The metrics on training and validation pairs, each batched in its own order."""
    keyed = fx.vec_pairs(spark, sf).withColumn("key", shuffle_key(123, "id"))
    rows = split_by_count(keyed, 160, "key", "id")
    parts = [
        assign_batches(rows.filter(F.col("split") == name), fx.BATCH, "key", "id")
        for name in ("train", "validation")
    ]
    found = evaluation_plans.split_metrics(*parts)
    return found.select("split", "metric", r6("value").alias("value"))


# --- negative sampling --------------------------------------------------------------------------

NS_BATCH, NS_LENGTH, NS_K = 8, 30, 1


def _ns_triples(spark, sf, words: DataFrame) -> DataFrame:
    """Batches of id triples with the sentence's bag of vectors (first half of the dimensions)."""
    found = corpus_plans.text_triples(fx.documents(spark, sf), "doc_id", max_len=NS_LENGTH)
    inputs = words.select("word", F.slice("v", 1, fx.HALF).alias("v"))
    parts = corpus_plans.PARTS
    with_v = encode_bow(found, inputs, "drop", "encode", "v")
    coded = encode_ids(with_v, words, "drop", parts, [f"_{p}" for p in parts])
    rows = coded.select("doc_id", "pos", "v", *[F.col(f"_{p}").alias(p) for p in parts])
    return assign_batches(rows, NS_BATCH, "doc_id", "pos")


def _ns_ids(spark, sf, words: DataFrame):
    """The same batches without the vectors, and what adds them: their words are known by the ids, so that
    only ids are ranked and moved. Where a word or an id repeats, ids don't tell the vectors."""
    if any(not words.groupBy(c).count().filter("count > 1").isEmpty() for c in ("word", "id")):
        return _ns_triples(spark, sf, words), None
    found = corpus_plans.text_triples(fx.documents(spark, sf), "doc_id", max_len=NS_LENGTH)
    parts = corpus_plans.PARTS
    coded = encode_ids(found, words, "drop", parts, [f"_{p}" for p in parts])
    rows = coded.select("doc_id", "pos", *[F.col(f"_{p}").alias(p) for p in parts])
    inputs = words.select(F.col("id").cast("string").alias("word"), F.slice("v", 1, fx.HALF).alias("v"))

    def vectors(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("_words", F.transform("encode", lambda i: i.cast("string")))
        return encode_bow(named, inputs, "drop", "_words", "v").drop("_words")

    return assign_batches(rows, NS_BATCH, "doc_id", "pos", whole=True), vectors


@query
def sample_negatives(spark, sf):
    words = fx.word_vec(spark, sf)
    rows = corpus_plans.text_triples(fx.documents(spark, sf), "doc_id", max_len=NS_LENGTH)
    batches = assign_batches(rows.select("doc_id", "pos"), NS_BATCH, "doc_id", "pos")
    return sampling.sample_negatives(
        batches.filter(F.col("row") == 0), words, NS_BATCH, NS_LENGTH, NS_K
    )


@query
def positive_pairs(spark, sf):
    words = fx.word_vec(spark, sf)
    found = sampling.positive_pairs(
        _ns_triples(spark, sf, words), keep=["batch", "row"]
    )
    return found.select("batch", "row", "part", "t", "id")


@query
def negative_sampling_loss(spark, sf):
    words = fx.word_vec(spark, sf)
    targets = words.select("id", F.slice("v", fx.HALF + 1, fx.HALF).alias("v"))
    found = sampling.negative_sampling_loss(
        _ns_triples(spark, sf, words), targets, words, NS_BATCH, NS_LENGTH, NS_K
    )
    return sampling.text_total(found).select("batch", r6("value").alias("value"))


@query
def negative_sampling_loss_joined(spark, sf):
    """``negative_sampling_loss`` with words and targets that no task holds."""
    words = fx.word_vec(spark, sf)
    targets = words.select("id", F.slice("v", fx.HALF + 1, fx.HALF).alias("v"))
    rows, vectors = _ns_ids(spark, sf, words)
    found = sampling.negative_sampling_loss(
        rows, targets, words, NS_BATCH, NS_LENGTH, NS_K, max_bytes=0, vectors=vectors
    )
    return sampling.text_total(found).select("batch", r6("value").alias("value"))


# --- vocabulary expansion -------------------------------------------------------------------------


def _spaces(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Large space: vectors' first 16 dimensions for the vocabulary of the documents. Own space:
    the next 16 for the words of the conversations that have a vector, in id order."""
    words = fx.word_vec(spark, sf)
    large = words.select("word", "id", F.slice("v", 1, 16).alias("v"))
    talk = word_counts(fx.turns(spark, sf)).select("word")
    own = words.join(talk, "word", "left_semi").select(
        "word", "id", F.slice("v", 17, 16).alias("v")
    )
    return large, own


@query
def space_map_gram(spark, sf):
    large, own = _spaces(spark, sf)
    found = expand.gram_sums(expand.paired_spaces(large, own))
    return found.select("kind", "i", "j", r6("value").alias("value"))


@query
def space_map_residuals(spark, sf):
    """Products of the fitted map's residuals with the large space, and their sums: a least-squares
    fit leaves them zero."""
    pairs = materialize(expand.paired_spaces(*_spaces(spark, sf)))
    fitted = expand.fit_space_map(pairs)
    left = project(pairs, fitted.coef, fitted.intercept, v="x", out="_mapped").select(
        "x", F.zip_with("y", "_mapped", lambda y, m: y - m).alias("y")
    )
    found = expand.gram_sums(left, ("y", "xy"))
    return found.select("kind", "i", "j", r6("value").alias("value"))


@query
def space_map_applied(spark, sf):
    """The map with fixed coefficients on every word of the large space."""
    large, _ = _spaces(spark, sf)
    fixed = expand.SpaceMap(fx.wave(16, 16, 7, 13, 6.0), fx.wave(1, 16, 0, 5, 10.0)[0])
    mapped = expand.apply_space_map(large, fixed)
    return mapped.select("word", "id", *outline("mapped"))


@query
def expand_vocab(spark, sf):
    large, own = _spaces(spark, sf)
    fixed = expand.SpaceMap(fx.wave(16, 16, 7, 13, 6.0), fx.wave(1, 16, 0, 5, 10.0)[0])
    found = expand.expand_vocab(large, own, fixed)
    return found.select("pos", "word", *outline("v"))


@query
def expand_vocab_fitted(spark, sf):
    large, own = _spaces(spark, sf)
    found = expanded_vocabulary(large, own)
    return found.select("pos", "word", *outline("v"))


# --- recurrent encoder ------------------------------------------------------------------------------


def gru_weights(dim: int, units: int, seed: int) -> GruWeights:
    """Weights by a formula that both engines can evaluate."""
    shapes = [(units, 2 * units, 3, 5), (dim, 2 * units, 7, 11), (units, units, 2, 9), (dim, units, 4, 3)]
    return GruWeights(*[fx.wave(rows, cols, a + seed, b, 3.0) for rows, cols, a, b in shapes])


@query
def sentence_gru(spark, sf):
    words = fx.word_vec(spark, sf)
    coded = encode_gru(
        fx.turns(spark, sf), words, gru_weights(64, 16, 1), gru_weights(64, 16, 2), "unk"
    )
    return coded.select("conv_id", "turn", *outline("v"))
