"""Sources, tokens, vocabularies, ids, triples: hand-written edge cases."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sentloom.functions import text as X
from sentloom.operators import windows
from sentloom.operators.lookup import encode_ids
from sentloom.operators.vocab import build_vocab, load_embeddings, load_vocab, word_counts
from sentloom.plans import captions as plans
from sentloom.plans.corpus import id_triples, text_id_triples
from sentloom.sources import text as sources


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def vocab(spark):
    words = [("<eos>", 0), ("<unk>", 1), ("a", 2), ("b", 3), ("c", 4)]
    return spark.createDataFrame(words, "word string, id int")


def test_tokens(spark):
    assert column(spark, X.ws_tokens(F.lit("  a\t b \x0b\n"))) == ["a", "b"]
    assert column(spark, X.ws_tokens(F.lit(""))) == []
    assert column(spark, X.space_tokens(F.lit("a  b "))) == ["a", "", "b", ""]
    assert column(spark, X.clean_caption(F.lit("It's a Dog, [ok]^!"))) == ["its", "a", "dog", "ok"]
    assert column(spark, X.tokenize(F.lit("Don't stop. Élan-x, 3!"))) == [
        "don't", "stop", ".", "élan-x", ",", "3", "!",
    ]


def test_tagged_tokens(spark):
    line = "Dog/NN runs/VBZ fast ./. a/b/c x/1N The/D"
    assert column(spark, X.tagged_tokens(F.lit(line))) == ["dog/NN", "runs/VB", "the/D"]


def test_sentence_files(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 3), ("c", 1)):
        lines = [f"{name} line {i} " + "x" * (i % 90) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n", newline="\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sources.read_sentences(spark, f"{tmp_path}/a.txt,{tmp_path}/[bc].txt").cache()
        number = F.split("text", " ")[2].cast("bigint")
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 4004
        assert df.filter(F.col("pos") != number).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(AnalysisException):
        sources.read_sentences(spark, f"{tmp_path}/a.txt,{tmp_path}/none*.txt").count()


def test_captions_without_separator(spark):
    df = spark.createDataFrame([(0, "7\tA dog runs"), (1, "no tab here")], "pos long, text string")
    assert values(sources.read_captions(df).orderBy("pos"), "clip_id", "tokens") == [
        ("7", ["A", "dog", "runs"]), ("no tab here", []),
    ]
    df = spark.createDataFrame([(0, "v1    a b")], "pos long, text string")
    assert values(sources.read_captions(df, sources.FOUR_SPACES), "clip_id", "tokens") == [
        ("v1", ["a", "b"])
    ]


def test_pairs_lose_only_the_line_end(spark):
    df = spark.createDataFrame([("a b\tc d\n",), ("a\tlast",)], "text string")
    assert values(sources.read_pairs(df), "s1", "s2") == [("a b", "c d"), ("a", "last")]


def test_malformed_labels_are_dropped(spark):
    lines = [("A dog.\t17\n",), ("bad\tx",), ("no tab",), ("big\t99999999999",), ("ok\t-3",)]
    df = sources.read_labelled(spark.createDataFrame(lines, "text string"))
    assert values(df, "tokens", "obj_id") == [(["a", "dog"], 17), (["ok"], -3)]


def test_scored_pairs(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / name).write_text(f"id\tA\tB\tscore\n1\t{name} \"a\"\tb\t4.5\n")
    paths = [str(tmp_path / n) for n in ("train", "test")]
    df = sources.read_scored_pairs(spark, paths)
    assert sorted(values(df, "s1", "s2", "score")) == [
        ('test "a"', "b", 4.5), ('train "a"', "b", 4.5),
    ]
    (tmp_path / "plain").write_text("x\ty\t1.0\n")
    plain = sources.read_scored_pairs(spark, [str(tmp_path / "plain")], header=False)
    both = sources.union_domains({"news": plain, "trial": df})
    assert {(r["domain"], r["s1"]) for r in both.collect()} == {
        ("news", "x"), ("trial", 'test "a"'), ("trial", 'train "a"'),
    }


def test_vocabulary_from_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "a", "d"],), ([],)], "tokens array<string>")
    counts = word_counts(df)
    assert sorted(values(counts, "word", "n")) == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]
    assert sorted(values(build_vocab(counts, 5), "id", "word")) == [
        (0, "<eos>"), (1, "<unk>"), (2, "a"), (3, "b"), (4, "c"),
    ]
    ids = [i for (i,) in values(build_vocab(counts, 100), "id")]
    assert sorted(ids) == list(range(6))


def test_vocabulary_file_keeps_gaps(spark):
    lines = [(0, "x"), (1, " y "), (2, "x"), (3, "z")]
    df = load_vocab(spark.createDataFrame(lines, "pos long, text string"))
    assert sorted(values(df, "word", "id")) == [("x", 0), ("y", 1), ("z", 3)]


def test_repeated_word_keeps_last_vector(spark):
    words = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pos long, word string")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "pos long, v array<float>")
    assert sorted(values(load_embeddings(words, rows), "word", "id", "v")) == [
        ("x", 0, [2.0]), ("y", 1, [1.0]),
    ]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_encode_ids(spark, vocab, max_bytes):
    rows = [(0, ["a", "q", "b"]), (1, ["q", "r"]), (2, []), (3, ["c"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")

    def ids(oov, **options):
        coded = encode_ids(df, vocab, oov, key=["k"], max_bytes=max_bytes, **options)
        return [r["ids"] for r in coded.orderBy("k").collect()]

    assert ids("unk") == [[2, 1, 3], [1, 1], [], [4]]
    assert ids("drop") == [[2, 3], [], [], [4]]
    assert ids("drop", add_eos=True) == [[2, 3, 0], [0], [0], [4, 0]]
    assert ids("unk", add_eos=True) == ids("unk")
    with pytest.raises(ValueError):
        ids("other")


def test_encoding_does_not_depend_on_partitions(spark, vocab):
    rows = [(i, ["abcqr"[(i * j) % 5] for j in range(i % 7)]) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    found = [
        encode_ids(df.repartition(n), vocab, "drop").orderBy("k").select("k", "ids").collect()
        for n in (1, 13)
    ]
    assert found[0] == found[1]


def sentence_table(spark, files):
    rows = [(f, i, t.split()) for f, lines in files.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, pos long, tokens array<string>")


def words(n):
    return " ".join(["a"] * n)


FILES = {
    "gap": ["s0", "s1", "", "s3", "s4", "s5"],
    "one": ["only"],
    "two": ["x", "y"],
    "long": ["p", words(29), "q", words(30), "r", words(31), "s", "t", "u"],
}
EXPECTED = {("gap", 4), ("long", 1), ("long", 7)}


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 1000])
def test_triples(spark, chunk_rows):
    df = sentence_table(spark, FILES)
    found = windows.triples(df, "file", "pos", chunk_rows=chunk_rows).collect()
    assert {(r["file"], r["pos"]) for r in found} == EXPECTED
    middle = next(r for r in found if r["file"] == "gap")
    assert (middle["decode_pre"], middle["encode"], middle["decode_post"]) == (["s3"], ["s4"], ["s5"])
    everything = windows.triples(df, "file", "pos", max_len=0, chunk_rows=chunk_rows)
    assert everything.count() == 1 + 7


def test_counters_of_rows_and_of_texts_agree(spark):
    df = sentence_table(spark, FILES)
    rows = windows.triple_stats(windows.neighbours(df, "file", "pos", "tokens")).first()
    assert tuple(rows) == (sum(map(len, FILES.values())), 8, 5, 3)
    by_file = [(f, [t.split() for t in lines]) for f, lines in FILES.items()]
    arrays = spark.createDataFrame(by_file, "file string, sentences array<array<string>>")
    assert windows.row_triple_stats(arrays).first() == rows


def test_neighbours_with_gaps_in_the_order(spark):
    rows = [("f", p, p) for p in (0, 1, 7, 8, 30, 31, 32, 99)] + [("g", 5, 5)]
    df = spark.createDataFrame(rows, "file string, pos long, x long")
    near = windows.neighbours(df, "file", "pos", "x", chunk_rows=4)
    assert sorted(values(near, "x", "previous", "next"), key=lambda t: t[0]) == [
        (0, None, 1), (1, 0, 7), (5, None, None), (7, 1, 8), (8, 7, 30), (30, 8, 31),
        (31, 30, 32), (32, 31, 99), (99, 32, None),
    ]


def test_id_triples_of_rows_and_of_texts_agree(spark, vocab):
    texts = [(k, "\n".join(lines)) for k, lines in enumerate((["a b", "q", "c c", "b"], ["a"], ["a", "b", "c"]))]
    docs = spark.createDataFrame(texts, "k long, text string")
    from_texts = text_id_triples(docs, vocab, "k", oov="drop", add_eos=True)
    rows = sources.sentences_from_texts(docs, "k").select("k", "pos", X.ws_tokens("text").alias("tokens"))
    from_rows = id_triples(rows, vocab, "k", "pos", oov="drop", add_eos=True)
    joined = text_id_triples(docs, vocab, "k", oov="drop", add_eos=True, max_bytes=0)
    cols = ("k", "pos", "decode_pre", "encode", "decode_post")
    assert sorted(values(joined, *cols)) == sorted(values(from_rows, *cols))
    assert sorted(values(from_texts, *cols)) == sorted(values(from_rows, *cols)) == [
        (0, 1, [2, 3, 0], [0], [4, 4, 0]),
        (0, 2, [0], [4, 4, 0], [3, 0]),
        (2, 1, [2, 0], [3, 0], [4, 0]),
    ]


def test_cap_counts_before_the_length_rule(spark, vocab):
    rows = [("v", i, words(31 if i == 3 else 2).split()) for i in range(41)]
    rows.append(("without feature", 0, ["a"]))
    captions = spark.createDataFrame(rows, "clip_id string, pos long, tokens array<string>")
    features = spark.createDataFrame([("v", [1.0])], "clip_id string, v array<float>")
    found = plans.image_records(captions, features, vocab).collect()
    assert sorted(r["pos"] for r in found) == [i for i in range(40) if i != 3]
    assert all(r["sentence"] == [2, 2, 0] and r["image"] == [1.0] for r in found)


def test_adjacent_pairs_are_linear(spark):
    df = sentence_table(spark, {"f": ["a", "b", "c"]}).withColumn("t", F.col("tokens")[0])
    assert sorted(values(windows.adjacent_pairs(df, "file", "pos", "t"), "s1", "s2")) == [
        ("a", "b"), ("b", "c"),
    ]


def test_lines_survive_another_split_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    name = "spark.sql.files.minPartitionNum"
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set(name, "4")
        df = sources.read_sentences(spark, f"{tmp_path}/a.txt")
        spark.conf.set(name, "7")
        assert df.filter(F.col("text") == F.concat(F.lit("line "), F.col("pos").cast("string"))).count() == 20_000
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_caption_stats(spark):
    rows = [(1, p, ["w"] * (40 if p == 0 else 3)) for p in range(5)] + [(2, 0, ["w"]), (3, 0, None)]
    captions = spark.createDataFrame(rows, "clip_id long, pos long, tokens array<string>")
    features = spark.createDataFrame([(1,), (1,), (4,)], "clip_id long")
    found = windows.caption_stats(captions, features, n=3)
    assert found.collect() == [(7, 3, 1, 2)]
    assert windows.caption_stats(captions.limit(0), features).collect() == [(0, 0, 0, 0)]


def test_tokens_by_both_ways_of_splitting(spark):
    """Texts with spaces only are split at single spaces, others at runs of any ASCII white space."""
    texts = ["", " ", "a", "  a  b ", "a\tb", "\x0ba\x0c\rb\n", "a b c", " a", ".* [x] \\ c", " \t", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for col in ("t", F.lower("t"), F.concat("t", F.lit(""))):
        found = {r["i"]: r["x"] for r in df.select("i", X.ws_tokens(col).alias("x")).collect()}
        assert [found[i] for i in range(len(texts))] == [t if t is None else [w.decode() for w in t.encode().split()] for t in texts]
    plan = df.select(X.ws_tokens("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(lambda" in plan and ",  , -1)" in plan
