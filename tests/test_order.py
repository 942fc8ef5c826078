"""Rank, split, shards, batches, sinks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentloom.operators import rank
from sentloom.plans.corpus import write_corpus
from sentloom.sources import sinks
from sentloom.sources.text import read_records


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        (F.col("id") * 37 % 1000).alias("id"), F.lit("x" * 10).alias("payload")
    ).repartition(7)


def test_ranked(spark, rows):
    found = rank.ranked(rows, "id", total="n").collect()
    assert all(r["rank"] == r["id"] and r["n"] == 1000 for r in found) and len(found) == 1000


def test_hash_ranked_is_the_sorted_order(rows):
    keyed = rows.withColumn("key", rank.shuffle_key(123, "id"))
    found = rank.hash_ranked(keyed, "key", "id", total="n").collect()
    found.sort(key=lambda r: (r["key"], r["id"]))
    assert [r["rank"] for r in found] == list(range(1000))
    assert {r["n"] for r in found} == {1000}


@pytest.mark.parametrize("n", [0, 1, 137, 1000, 5000])
def test_split_is_a_partition(rows, n):
    keyed = rows.withColumn("key", rank.shuffle_key(123, "id"))
    found = rank.split_by_count(keyed, n, "key", "id").collect()
    held = {r["id"] for r in found if r["split"] == "validation"}
    first = sorted(found, key=lambda r: (r["key"], r["id"]))[:n]
    assert len(found) == 1000 and held == {r["id"] for r in first}


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60))
def test_shard_rule(n, s):
    borders = [i * n // s for i in range(s + 1)]
    for r in range(n):
        shard = ((r + 1) * s - 1) // n
        assert borders[shard] <= r < borders[shard + 1]


def test_shard_borders(spark):
    r = spark.range(10).select("id", rank.shard_of(F.col("id"), F.lit(10), 3).alias("s")).collect()
    assert [x["s"] for x in r] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_shards_are_even(rows):
    found = rank.assign_shards(rows, "id", n_validation=130, train_shards=7, validation_shards=2)
    sizes = {(r["split"], r["shard"]): r["count"] for r in found.groupBy("split", "shard").count().collect()}
    train = [n for (split, _), n in sizes.items() if split == "train"]
    held = [n for (split, _), n in sizes.items() if split == "validation"]
    assert (len(train), sum(train), len(held), sum(held)) == (7, 870, 2, 130)
    assert max(train) - min(train) <= 1 and max(held) - min(held) <= 1


def test_order_does_not_depend_on_partitions(rows):
    cols = ["id", "split", "rank", "shard"]
    found = [
        sorted(map(tuple, rank.assign_shards(df, "id", n_validation=10).select(*cols).collect()))
        for df in (rows.repartition(1), rows.repartition(11))
    ]
    assert found[0] == found[1]


def test_limit_ordered(rows, monkeypatch):
    monkeypatch.setattr(rank, "SMALL_LIMIT", 10)
    for n in (5, 77):
        found = rank.limit_ordered(rows, n, "id").collect()
        assert sorted(r["id"] for r in found) == list(range(n))
    assert rank.limit_ordered(rows, 0, "id").count() == 1000


def test_permutation_keeps_all_values(spark, rows):
    df = rows.select("id", (F.col("id") * 2).alias("v"))
    found = rank.permute_features(df, "id", "v").collect()
    assert sorted(r["v"] for r in found) == [2 * i for i in range(1000)]
    assert any(r["v"] != 2 * r["id"] for r in found)


def test_batches(rows):
    found = rank.assign_batches(rows, 32, "id").collect()
    assert all((r["batch"], r["row"]) == divmod(r["id"], 32) for r in found)


def test_written_shards_come_back(spark, rows, tmp_path):
    df = sinks.shards(rows.select("id"), 4, "id").select(
        F.array("id").alias("s1"), F.array("id", "rank").alias("s2"), "rank", "shard"
    )
    sinks.write_shards(df, str(tmp_path / "out"), "train", 4, rows_per_file=100)
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == [f"shard=train-{i:05d}-of-00004" for i in range(4)]
    back = read_records(spark, f"{tmp_path}/out/shard=train-*", "pair")
    assert sorted(r["s1"][0] for r in back.collect()) == list(range(1000))
    one = read_records(spark, f"{tmp_path}/out/shard=train-00001*", "pair")
    assert sorted(r["s2"][1] for r in one.collect()) == list(range(250, 500))
    with pytest.raises(ValueError):
        read_records(spark, "x", "unknown")


def test_whole_corpus_job(spark, tmp_path):
    lines = [(f"f{i % 3}", i // 3, f"word{i % 5} other word{i % 11}") for i in range(90)]
    df = spark.createDataFrame(lines, "file string, pos long, text string")
    written = write_corpus(df, str(tmp_path), num_words=50, n_validation=10, train_shards=3)
    vocab = written.vocab
    assert written.counters == {"sentences_seen": 90, "sentences_considered": 84, "sentences_too_long": 0, "sentences_output": 84}
    train = read_records(spark, f"{tmp_path}/train/shard=*", "triple")
    held = read_records(spark, f"{tmp_path}/validation/shard=*", "triple")
    assert (train.count(), held.count()) == (3 * 28 - 10, 10)
    assert all(len(r["encode"]) == 3 for r in train.union(held).collect())
    assert spark.read.parquet(f"{tmp_path}/vocab").count() == vocab.count() == 2 + 12
    write_corpus(df, f"{tmp_path}/first", n_validation=0, train_shards=2, vocab=vocab, max_sentences=7)
    assert read_records(spark, f"{tmp_path}/first/train/shard=*", "triple").count() == 7
    counts = spark.read.parquet(f"{tmp_path}/counts")
    assert counts.agg(F.sum("n")).first()[0] == 270


def test_null_keys_have_a_rank(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert {(r.k, r["rank"], r.v) for r in rank.ranked(df, "k").collect()} == {(None, 0, "a"), (1, 1, "b"), (2, 2, "c")}
    small = sorted(map(str, rank.limit_ordered(df, 2, "k").collect()))
    monkeypatch.setattr("sentloom.operators.rank.SMALL_LIMIT", 0)
    assert sorted(map(str, rank.limit_ordered(df, 2, "k").select("k", "v").collect())) == small
