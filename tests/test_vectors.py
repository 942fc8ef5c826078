"""Arrays, vectors, encodings, neighbours, metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentloom.functions import arrays as A
from sentloom.functions import vectors as V
from sentloom.operators import losses, sampling
from sentloom.operators.evaluation import eval_arrays, similarity_pearson
from sentloom.operators.lookup import encode_bow, encode_ids, lookup_vectors
from sentloom.operators.neighbours import knn, neighbour_overlap, similarity_moments
from sentloom.operators.pooling import mean_vectors
from sentloom.operators.rank import assign_batches
from sentloom.plans.encoding import SentenceModel, encode


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(values):
    return F.array(*[F.lit(v) for v in values])


def vectors(spark, matrix, name="v"):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"id long, {name} array<double>")


def test_padding(spark):
    assert column(spark, A.pad_ids(lit([5, 6]), 4)) == [5, 6, 0, 0]
    assert column(spark, A.pad_ids(lit(range(1, 52)), 50, truncate=True)) == list(range(1, 51))
    assert column(spark, A.length_mask(2, 4)) == [1, 1, 0, 0]
    assert column(spark, A.length_mask(51, 50)) == [1] * 50
    with pytest.raises(Exception, match="longer than the padded width"):
        column(spark, A.pad_ids(lit([1, 2, 3]), 2))
    seq = F.array(lit([1.0, 2.0]))
    assert column(spark, A.pad_vectors(seq, 2, 2)) == [[1.0, 2.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="between 1 and"):
        column(spark, A.pad_vectors(F.slice(seq, 1, 0), 2, 2))
    assert column(spark, A.pad_flat(seq, 3, 2)) == [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]


def test_array_functions(spark):
    assert column(spark, A.shift_right(lit([7, 8, 9]), F.lit(0))) == [0, 7, 8]
    assert column(spark, A.gather(lit([7, 8, 9]), F.lit(2))) == 9
    assert column(spark, A.one_hot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert column(spark, A.one_hot(F.lit(9), 4)) == [0, 0, 0, 0]
    assert column(spark, A.regroup(lit(range(6)), 2)) == [[0, 1], [2, 3], [4, 5]]
    masked = A.apply_mask(F.array(lit([1.0]), lit([2.0])), lit([0, 1]))
    assert column(spark, masked) == [[0.0], [2.0]]


def test_zero_vector(spark):
    assert column(spark, V.l2_normalize(lit([0.0, 0.0]))) is None
    assert column(spark, V.cosine(lit([0.0, 0.0]), lit([1.0, 2.0]))) is None
    assert column(spark, V.l2_normalize(lit([3.0, 4.0]))) == [0.6, 0.8]


WORDS = {"<eos>": [1.0, 0.0], "<unk>": [0.5, 0.5], "a": [1.0, 2.0], "b": [-3.0, 0.25]}


@pytest.fixture(scope="module")
def word_vec(spark):
    rows = [(w, i, v) for i, (w, v) in enumerate(WORDS.items())]
    return spark.createDataFrame(rows, "word string, id int, v array<float>")


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
@pytest.mark.parametrize("oov", ["unk", "drop"])
def test_bag_of_vectors(spark, word_vec, oov, max_bytes):
    rows = [(0, ["a", "b", "x"]), (1, []), (2, ["x"]), (3, ["b", "b"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    unknown = WORDS["<unk>"] if oov == "unk" else [0.0, 0.0]
    expected = [np.sum([WORDS.get(w, unknown) for w in t] + [[0, 0]], axis=0) for _, t in rows]
    found = encode_bow(df, word_vec, oov, key=["k"], max_bytes=max_bytes).orderBy("k").collect()
    np.testing.assert_allclose([r["v"] for r in found], expected)
    seqs = lookup_vectors(df, word_vec, oov, key=["k"], max_bytes=max_bytes).orderBy("k").collect()
    assert [r["vectors"] for r in seqs] == [[WORDS.get(w, unknown) for w in t] for _, t in rows]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("keyed", [True, False])
def test_both_ways_are_one_result(spark, word_vec, kind, keyed):
    vectors = word_vec.withColumn("v", (F.col("v").cast("array<double>"))).withColumn(
        "v", F.transform("v", lambda x: x + 0.1).cast(f"array<{kind}>")
    )
    rows = [(0, ["a", None, "x"]), (None, ["b"]), (2, None), (3, []), (4, [None])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    key = ["k"] if keyed else None
    for oov in ("unk", "drop"):
        for encode, out in ((encode_bow, "v"), (lookup_vectors, "vectors")):
            sides = [encode(df, vectors, oov, key=key, max_bytes=m) for m in (1 << 20, 0)]
            assert sides[0].schema[out].dataType == sides[1].schema[out].dataType
            assert len({str(sorted(x.select("k", out).collect(), key=str)) for x in sides}) == 1
        ids = [encode_ids(df, vectors, oov, key=key, max_bytes=m) for m in (1 << 20, 0)]
        assert len({str(sorted(x.select("k", "ids").collect(), key=str)) for x in ids}) == 1


def test_unknown_vector_is_needed_both_ways(spark, word_vec):
    df = spark.createDataFrame([(0, ["a"])], "k long, tokens array<string>")
    for max_bytes in (1 << 20, 0):
        with pytest.raises(ValueError, match="needs a vector"):
            encode_bow(df, word_vec.filter("word <> '<unk>'"), "unk", max_bytes=max_bytes)


def test_encode(spark, word_vec):
    df = spark.createDataFrame([(0, "A b! A"), (1, "")], "k long, text string")
    model = SentenceModel(word_vec, "drop")
    found = {r["k"]: r["v"] for r in encode(df, model, use_eos=True, use_norm=True).collect()}
    total = np.array([1.0 - 3.0 + 1.0 + 1.0, 2.0 + 0.25 + 2.0])
    np.testing.assert_allclose(found[0], total / np.linalg.norm(total))
    np.testing.assert_allclose(found[1], [1.0, 0.0])
    assert {r["v"] is None for r in encode(df, model, use_norm=True).filter("k = 1").collect()} == {True}
    with pytest.raises(Exception, match="no tokens"):
        encode(df, model, on_empty="error").collect()
    with pytest.raises(ValueError):
        SentenceModel(word_vec, "other")


def test_eval_arrays(spark):
    vocab = spark.createDataFrame([("<eos>", 0), ("<unk>", 1), ("a", 2)], "word string, id int")
    df = spark.createDataFrame([("A q a", " ".join(["a"] * 51))], "s1 string, s2 string")
    row = eval_arrays(df, vocab, 50, "unk").first()
    assert row["s1_ids"][:4] == [2, 1, 2, 0] and sum(row["s1_mask"]) == 3
    assert len(row["s2_ids"]) == 50 and row["s2_mask"] == [1] * 50
    assert sum(eval_arrays(df, vocab, 50, "drop").first()["s1_mask"]) == 2
    with pytest.raises(Exception, match="longer than the padded width"):
        eval_arrays(df, vocab, 30, "unk", truncate=False).collect()


def test_means_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 5))
    df = vectors(spark, m).withColumn("g", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    found = {r["g"]: (r["n"], r["v"]) for r in mean_vectors(df.repartition(6), "g").collect()}
    hot = m[np.arange(3000) % 3 != 0]
    assert found[-1][0] == len(hot) and len(found) == 1001
    np.testing.assert_allclose(found[-1][1], hot.mean(axis=0))
    np.testing.assert_allclose(found[3][1], m[3])


def brute_force(m, k, own):
    unit = m / np.sqrt(np.maximum((m * m).sum(1, keepdims=True), 1e-12))
    s = np.round(unit @ unit.T, 10)
    found = {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if own or j != i), key=lambda j: (-s[i, j], j))
        found[i] = order[:k]
    return found


@pytest.mark.parametrize("rows_per_block", [37, 10_000])
@pytest.mark.parametrize("own", [True, False])
def test_neighbours_are_exact(spark, rows_per_block, own):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 6))
    m[50:120] = m[7]  # a third of the rows are copies
    m[190] = 0.0
    found: dict = {}
    for r in knn(vectors(spark, m), 5, include_self=own, rows_per_block=rows_per_block).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["neighbour"])
    assert found == brute_force(m, 5, own)


def test_overlap_of_a_space_with_itself(spark):
    m = np.random.default_rng(6).normal(size=(60, 4))
    df = vectors(spark, m)
    assert neighbour_overlap(df, df, 5).first()["overlap"] == 1.0
    strict = neighbour_overlap(df, df, 5, strict_reference=True).first()
    assert (strict["n"], strict["shared"], strict["overlap"]) == (60, 300, 1.0)


def test_similarity_moments(spark):
    m = np.random.default_rng(7).normal(size=(80, 4))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    row = similarity_moments(vectors(spark, m).repartition(4)).first()
    s = unit @ unit.T
    np.testing.assert_allclose([row["n"], row["mean"], row["mean_square"]], [80, s.mean(), (s**2).mean()])


def test_pearson_counts_zero_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.1], 5.0), ([0.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 1.0], [0.0, 1.0], 3.0)]
    df = spark.createDataFrame(rows, "v1 array<double>, v2 array<double>, score double")
    c = [1 / np.sqrt(1.01), 0.0, np.sqrt(0.5)]
    row = similarity_pearson(df).first()
    assert row["n"] == 3
    np.testing.assert_allclose(row["pearson"], np.corrcoef(c, [5.0, 1.0, 3.0])[0, 1])
    assert similarity_pearson(df.withColumn("score", F.lit(0.1))).first()["pearson"] is None


def test_batch_metrics_against_loops(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(26, 4)), rng.normal(size=(26, 4))
    df = spark.createDataFrame(
        [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))],
        "id long, x array<double>, y array<double>",
    )
    rows = assign_batches(df, 20, "id")
    found = {r["batch"]: r["value"] for r in losses.ranking_loss(rows).collect()}
    a, b = (m[:20] / np.linalg.norm(m[:20], axis=1, keepdims=True) for m in (x, y))
    per_row = []
    for i in range(10):
        loss = 0.0
        for j in range(10, 20):
            loss += max(0.0, 0.5 - a[i] @ b[i] + a[j] @ b[i]) / 2
            loss += max(0.0, 0.5 - a[i] @ b[i] + a[i] @ b[j]) / 2
        per_row.append(loss)
    np.testing.assert_allclose(found[0], np.mean(per_row))
    assert found[1] is None  # six rows, all of them negatives
    with pytest.raises(ValueError):
        losses.structure_alignment(rows, "L3")
    three = assign_batches(df, 13, "id")
    with pytest.raises(Exception, match="odd size"):
        losses.match_pairs(three).collect()


def test_all_metrics_in_one_pass(spark):
    rows = [(b, r, [float(r + b), 1.0], [1.0, float(r * r % 5)]) for b in range(2) for r in range(12)]
    df = spark.createDataFrame(rows, "batch long, row int, x array<double>, y array<double>")
    swap = (np.array([[0.0, 1.0], [1.0, 0.0]]), np.zeros(2))
    found = {(r["batch"], r["metric"]): r["value"] for r in
             losses.batch_metrics(df, list(losses.METRICS), swap).collect()}
    swapped = losses.projected(df, swap)
    both = losses.projected(swapped, swap, "y")
    for name, single in [
        ("ranking", losses.ranking_loss(df)), ("ranking_f", losses.ranking_loss(swapped)),
        ("ranking_both", losses.ranking_loss(both)), ("l2_f", losses.element_l2(swapped)),
        ("rho_f", losses.structure_alignment(swapped)), ("quick_f", losses.contrast_scores(swapped)),
    ]:
        for row in single.collect():
            assert found[row["batch"], name] == pytest.approx(row["value"]), name
    with pytest.raises(ValueError, match="needs weights"):
        losses.batch_metrics(df, ["l2_f"])
    empty = losses.batch_metrics(df.limit(0), ["l2"])
    assert losses.mean_over_batches(empty, ["l2"]).collect() == [("l2", None)]


def test_weighted_total(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 100.0)], "metric string, value double")
    assert losses.weighted_total(df, {"a": 1.0, "b": 0.5, "c": 0.0}).first()["total"] == 3.5


def test_negatives_are_different_words(spark):
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(100)], "word string, id int")
    batches = spark.range(5).select(F.col("id").alias("batch"))
    found = sampling.sample_negatives(batches, vocab, 2, 10, 3).collect()
    assert len(found) == 5 * 60
    for batch in range(5):
        assert len({r["id"] for r in found if r["batch"] == batch}) == 60
    again = sampling.sample_negatives(batches.repartition(3), vocab, 2, 10, 3).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    with pytest.raises(Exception, match="cannot draw"):
        sampling.sample_negatives(batches, vocab, 10, 10, 3).collect()


def test_frequent_words_are_drawn_more_often():
    words = sampling.WordDraw.of(np.arange(1000))
    hits = np.zeros(1000)
    for batch in range(400):
        hits[words.places(batch, 50, 123)] += 1
    assert hits[:10].mean() > hits[10:100].mean() > hits[100:].mean() > 0


def test_draw_of_all_words_ends():
    words = sampling.WordDraw.of(np.arange(300) * 7)
    for batch in range(5):
        found = words.places(batch, 300, 1)
        assert sorted(found) == list(range(300))
        assert list(words.places(batch, 20, 1)) == list(dict.fromkeys(words.places(batch, 20, 1)))


def test_normalised_texts_reach_a_python_function(spark):
    from sentloom.plans.encoding import encode_multi
    from workload.queries import outline

    words = spark.createDataFrame([("a", [3.0, 4.0]), ("<unk>", [0.0, 1.0])], "word string, v array<double>")
    texts = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "")], "id long, text string")
    for coded in (
        encode(texts, SentenceModel(words, "unk"), use_norm=True),
        encode_multi(texts, [SentenceModel(words, "unk")], use_norm=True),
    ):
        square = {r["id"]: r["v_square"] for r in coded.select("id", *outline("v")).collect()}
        assert square == {1: 1.0, 2: 1.0, 3: None}


def test_unit_vectors_reach_a_python_function(spark):
    import pyarrow as pa

    from workload.queries import outline

    rows = vectors(spark, [[3.0, 4.0], [0.0, 0.0], [0.0, 5.0]])
    found = {r["id"]: r for r in rows.select("id", *outline(V.l2_normalize("v"))).collect()}
    assert [found[0][c] for c in ("v_first", "v_last", "v_square", "v_weighted")] == [0.6, 0.8, 1.0, 2.2]
    assert found[1]["v_square"] is None and found[2]["v_weighted"] == 2.0
    length = F.arrow_udf(lambda lists: pa.compute.list_value_length(lists), "int")
    nested = F.get(F.transform(F.array("v"), V.l2_normalize), F.lit(0))
    assert {r["id"]: r["n"] for r in rows.select("id", length(nested).alias("n")).collect()} == {0: 2, 1: None, 2: 2}


def test_masked_vectors_reach_a_python_function(spark):
    from workload.queries import outline

    # The columns' numbers must be above the few that Spark's normal form gives to bound variables.
    for _ in range(30):
        rows = vectors(spark, [[3.0, 4.0, 5.0, 6.0], [1.0, 2.0, 3.0, 4.0]])
    masked = F.flatten(A.apply_mask(A.regroup("v", 2), lit([1, 0])))
    found = rows.select("id", *outline(masked)).orderBy("id").collect()
    assert [(r["v_first"], r["v_last"], r["v_square"], r["v_weighted"]) for r in found] == [(3.0, 0.0, 25.0, 11.0), (1.0, 0.0, 5.0, 5.0)]
    empty = F.array(lit([1.0]), F.lit(None).cast("array<double>"), lit([2.0]))
    mask = F.array(F.lit(None).cast("int"), F.lit(1), F.lit(1))
    assert column(spark, A.apply_mask(empty, mask)) == [[None], None, [2.0]]
