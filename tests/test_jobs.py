"""Whole write jobs, committed sets, summaries of frequent words, bucketed features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentloom.operators.joins import caption_features
from sentloom.operators.vocab import build_vocab, frequent_words, word_counts
from sentloom.plans.captions import write_captions, write_labels, write_pairs
from sentloom.plans.corpus import write_corpus
from sentloom.sources.sets import manifests, read_set, write_set
from sentloom.sources.sinks import store_bucketed
from sentloom.sources.text import read_records


def words_of(n_rows, seed):
    rng = np.random.default_rng(seed)
    return [[f"w{int(x)}" for x in rng.zipf(1.3, 30) % 5000] for _ in range(n_rows)]


@pytest.mark.parametrize(("n", "capacity"), [(5, 400), (5, 2000), (5, 10), (50, 60), (20, 10**6), (10**5, 10)])
def test_frequent_words_are_exact(spark, n, capacity):
    rows = [(w,) for w in words_of(600, n)] + [(None,), ([],), (["w1", None],)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(6)
    wanted = {r.word: r.n for r in word_counts(df).collect()}
    found = {r.word: r.n for r in frequent_words(df, n, capacity=capacity).collect()}
    assert all(wanted[w] == c for w, c in found.items())
    top = sorted(wanted, key=lambda w: (-wanted[w], w))[:n]
    assert set(top) <= set(found)
    if (n, capacity) == (5, 400):
        assert len(found) < len(wanted) / 4  # only candidates were counted
    ways = [sorted(map(tuple, build_vocab(c, n + 2).collect())) for c in (word_counts(df), frequent_words(df, n, capacity=capacity))]
    assert ways[0] == ways[1]


def test_bucketed_features_are_not_shuffled(spark):
    features = spark.range(200).select(F.col("id").alias("clip_id"), F.array(F.col("id").cast("double")).alias("v"))
    captions = spark.range(900).select((F.col("id") % 250).alias("clip_id"), F.col("id").alias("pos"))
    stored = store_bucketed(features, "clip_id", 8)
    plain = caption_features(captions.hint("merge"), features)
    found = caption_features(captions.hint("merge"), stored)
    assert sorted(map(str, plain.collect())) == sorted(map(str, found.collect()))
    plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (plain, found)]
    assert plans[1] * 2 == plans[0]  # one side of two


def test_scratch_leaves_nothing(spark, tmp_path):
    from pathlib import Path

    from sentloom.session import checkpoint_root, materialize, scratch

    root = Path(checkpoint_root(spark).removeprefix("file:"))
    kept = materialize(spark.range(3))
    before = set(root.iterdir())
    with pytest.raises(ZeroDivisionError), scratch(spark):
        assert materialize(spark.range(5)).count() == 5
        raise ZeroDivisionError
    assert set(root.iterdir()) == before and kept.count() == 3


def test_captions_job(spark, tmp_path):
    captions = spark.createDataFrame(
        [(c, p, ["a"] * (1 + 10 * p) + [f"b{c}"]) for c in range(6) for p in range(5)] + [(9, 0, ["lost"])],
        "clip_id long, pos long, tokens array<string>",
    )
    features = spark.createDataFrame([(c, [float(c), 1.0]) for c in range(6)], "clip_id long, v array<double>")
    options = {"per_clip": 4, "max_len": 30, "n_validation": 5, "train_shards": 2}
    written = write_captions(captions, features, f"{tmp_path}/image", num_words=50, **options)
    assert written.counters == {"sentences_seen": 31, "sentences_considered": 24, "sentences_too_long": 6, "sentences_output": 18}
    rows = [read_records(spark, f"{tmp_path}/image/{s}/shard=*", "image") for s in ("train", "validation")]
    assert [r.count() for r in rows] == [13, 5]
    assert spark.read.parquet(f"{tmp_path}/image/counts").filter("word = 'lost'").count() == 1
    ids = {r.word: r.id for r in written.vocab.collect()}
    assert {tuple(r.sentence[-2:]) for r in rows[0].union(rows[1]).collect()} == {(ids[f"b{c}"], 0) for c in range(6)}
    clips = features.select("clip_id", F.array("v", "v").alias("frames"))
    again = write_captions(captions, clips, f"{tmp_path}/clip", "clip", vocab=written.vocab, max_sentences=7, **options)
    assert again.counters == written.counters
    rows = [read_records(spark, f"{tmp_path}/clip/{s}/shard=*", "clip") for s in ("train", "validation")]
    assert [r.count() for r in rows] == [2, 5] and rows[0].first().nb_frames == 2
    with pytest.raises(ValueError, match="kind"):
        write_captions(captions, features, "x", "sound")


def test_pair_and_label_jobs(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"one two {i % 3}", "three " * (i % 7)) for i in range(30)], "k long, s1 string, s2 string")
    written = write_pairs(pairs, f"{tmp_path}/p", ["k"], max_len=6, n_validation=4, train_shards=2)
    assert written.counters == {"sentences_considered": 30, "sentences_too_long": 4, "sentences_output": 26}
    assert {"one", "three"} <= {r.word for r in written.vocab.collect()}
    assert read_records(spark, f"{tmp_path}/p/train/shard=*", "pair").count() == 22
    labels = spark.createDataFrame([(i, ["x"] * (i % 5), i) for i in range(20)], "k long, tokens array<string>, obj_id int")
    written = write_labels(labels, f"{tmp_path}/l", ["k"], max_len=4, n_validation=3, train_shards=1, oov="unk")
    assert written.counters["sentences_output"] == 16
    found = read_records(spark, f"{tmp_path}/l/*/shard=*", "label")
    assert sorted(r.feature[0] for r in found.collect()) == [float(i) for i in range(20) if i % 5 != 4]


def test_evaluation_sets_of_the_corpus_job(spark, tmp_path):
    lines = spark.createDataFrame([("f", i, f"word{i % 5} other") for i in range(20)], "file string, pos long, text string")
    pairs = {name: spark.createDataFrame([("Word1 other", "none", 2.5)] * n, "s1 string, s2 string, score double") for name, n in (("x", 2), ("y", 3))}
    write_corpus(lines, str(tmp_path), n_validation=0, train_shards=1, eval_sets=pairs, oov="unk")
    found = spark.read.parquet(f"{tmp_path}/eval")
    assert {r.domain: r["count"] for r in found.groupBy("domain").count().collect()} == {"x": 2, "y": 3}
    row = found.first()
    assert len(row.s1_ids) == len(row.s2_mask) == 50 and sum(row.s1_mask) == 2 and row.score == 2.5


def test_a_failed_write_leaves_the_set_before_it(spark, tmp_path):
    def pairs(n):
        return spark.range(n).select("id", F.array("id").alias("s1"), F.array(F.col("id") + 1).alias("s2"))

    path, options = str(tmp_path / "sets"), {"n_validation": 3, "train_shards": 4}
    with pytest.raises(ValueError, match="no committed set"):
        read_set(spark, path, "train")
    first = write_set(pairs(23), path, "pair", "id", **options)
    assert first.agg(F.sum("n_rows")).first()[0] == 23 and first.count() == 5
    broken = pairs(50).withColumn("s1", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("s1")))
    with pytest.raises(Exception, match="lost"):
        write_set(broken, path, "pair", "id", **options)
    assert read_set(spark, path, "train", verify=True).count() == 20
    write_set(pairs(30), path, "pair", "id", **options)
    assert sorted(r.s1[0] for s in ("train", "validation") for r in read_set(spark, path, s, verify=True).collect()) == list(range(30))
    assert manifests(spark, path).select("version").distinct().count() == 2
    shard = next((tmp_path / "sets").glob("set-*/train/shard=train-00001*/*.parquet"))
    folder = read_set(spark, path, "train").inputFiles()[0].split("/train/")[0]
    for shard in (tmp_path / "sets" / folder.rsplit("/", 1)[1] / "train").glob("shard=train-00001*/*.parquet"):
        shard.unlink()
    with pytest.raises(ValueError, match="differ"):
        read_set(spark, path, "train", verify=True)
