"""The ways for tables that no task can hold, against the ways in memory and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dense import weights
from test_vectors import brute_force, vectors

from sentloom.operators import sampling
from sentloom.operators.expand import fit_space_map, triangular_factor
from sentloom.operators.joins import split_hot
from sentloom.operators.lookup import encode_bow, lookup_ids, lookup_vectors
from sentloom.operators.neighbours import PivotIndex, knn, knn_queries, vector_key
from sentloom.operators.windows import neighbours
from sentloom.plans.encoding import SentenceModel, encode, encode_multi


def found_by_id(df):
    out: dict = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("rows_per_block", [25, 1000])
@pytest.mark.parametrize("own", [True, False])
def test_index_is_exact(spark, rows_per_block, own):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(230, 6))
    m[50:120] = m[7]  # a third of the rows are copies
    m[190:195] = 0.0
    m[200:210] = rng.normal(size=(10, 6)) * 1e-8  # shorter than the norm's floor
    found = found_by_id(knn(vectors(spark, m).repartition(3), 5, include_self=own, rows_per_block=rows_per_block, max_bytes=0))
    assert found == brute_force(m, 5, own)


def test_index_leaves_blocks_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 10
    m = np.concatenate([c + rng.normal(size=(60, 16)) * 0.3 for c in centres])
    rows = vectors(spark, m).select(vector_key().alias("key"), "id", "v")
    index = PivotIndex.build(rows, 5, 40)
    near = index.search(rows.select("key", "v"))
    grid = len(m) * len(index.cells)
    assert len(index.cells) >= 12 and sum(index.visits) < grid / 3
    wanted = brute_force(m, 5, True)
    got = {r["id"]: [x["neighbour"] for x in r["near"]] for r in rows.join(near, "key").collect()}
    assert got == wanted


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_queries_against_a_corpus(spark, max_bytes):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 5))
    df = vectors(spark, m).repartition(4)
    asked = df.filter("id % 10 = 3").unionByName(spark.createDataFrame([(999, None)], df.schema))
    found = found_by_id(knn_queries(asked, df, 4, include_self=False, rows_per_block=30, max_bytes=max_bytes))
    wanted = brute_force(m, 4, False)
    assert found == {i: wanted[i] for i in range(3, 150, 10)}
    assert knn_queries(asked, df.limit(0), 4, max_bytes=max_bytes).count() == 0
    assert knn_queries(asked.limit(0), df, 4, max_bytes=max_bytes).count() == 0


def test_hot_keys_are_split(spark):
    asks = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("key"))
    left, right = split_hot(asks, spark.range(60).withColumnRenamed("id", "key"), "key", ["id"], 40)
    assert left.groupBy("key", "_chunk").count().agg(F.max("count")).first()[0] < 100
    assert left.join(right, ["key", "_chunk"]).count() == 1000


@pytest.mark.parametrize(("words", "range_bits"), [(100, 3), (3000, 6)])
def test_draw_by_ranges_is_the_same(spark, words, range_bits):
    vocab = spark.createDataFrame([(f"w{i}", i * 3) for i in range(words)], "word string, id int")
    batches = spark.range(5).select(F.col("id").alias("batch"))
    same = sampling.sample_negatives(batches, vocab, 2, 10, 3).collect()
    ranges = sampling.draw_by_ranges(batches, vocab, 60, 123, range_bits).collect()
    assert sorted((r["batch"], r["place"], r["id"]) for r in ranges) == sorted((r["batch"], r["position"] * 3 + r["slot"], r["id"]) for r in same)
    other = sampling.sample_negatives(batches, vocab, 2, 10, 3, max_bytes=0)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, same))
    assert [f.dataType for f in other.schema] == [f.dataType for f in sampling.sample_negatives(batches, vocab, 2, 10, 3).schema]
    with pytest.raises(ValueError, match="cannot draw"):
        sampling.draw_by_ranges(batches, vocab, 3001, 1)


def test_loss_by_join_is_the_same(spark):
    rng = np.random.default_rng(4)
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(300)], "word string, id int")
    targets = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id int, v array<double>")
    rows = [(b, r, rng.normal(size=4).tolist(), *[[int(x) for x in rng.integers(0, 9, rng.integers(0, 6))] for _ in range(3)]) for b in range(4) for r in range(3)]
    rows.append((9, 0, [1.0, 0.0, 0.0, 0.0], [], [], []))
    df = spark.createDataFrame(rows, "batch long, row int, v array<double>, decode_pre array<int>, decode_post array<int>, encode array<int>")
    ways = [
        {(r["batch"], r["part"]): r["value"] for r in sampling.negative_sampling_loss(df, targets, vocab, 3, 6, 2, max_bytes=m).collect()}
        for m in (0, 1 << 20)
    ]
    assert ways[0].keys() == ways[1].keys()
    np.testing.assert_allclose([ways[0][k] for k in ways[1]], list(ways[1].values()), atol=1e-12)
    with pytest.raises(Exception, match="without a target"):
        sampling.negative_sampling_loss(df, targets.filter("id > 3"), vocab, 3, 6, 2, max_bytes=0).collect()
    with pytest.raises(Exception, match="padded width"):
        sampling.negative_sampling_loss(df, targets, vocab, 3, 2, 2, max_bytes=0).collect()


def test_loss_by_runs_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(300)], "word string, id int")
    targets = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id int, v array<double>")
    rows = [(b, r, rng.normal(size=4).tolist(), *[[int(x) for x in rng.integers(0, 300, rng.integers(0, 6))] for _ in range(3)]) for b in range(40) for r in range(3)]
    df = spark.createDataFrame(rows, "batch long, row int, v array<double>, decode_pre array<int>, decode_post array<int>, encode array<int>")
    monkeypatch.setattr(sampling, "GROUP_ROWS", 6)
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 24)
    options = [{}, {"max_bytes": 0}, {"max_bytes": 0, "block_bytes": 0}]  # sent, by runs, word by word
    ways = [{(r["batch"], r["part"]): r["value"] for r in sampling.negative_sampling_loss(df, targets, vocab, 3, 6, 2, **o).collect()} for o in options]
    assert len(ways[0]) == 120 and ways[0].keys() == ways[1].keys() == ways[2].keys()
    for other in ways[1:]:
        np.testing.assert_allclose([other[k] for k in ways[0]], list(ways[0].values()), atol=1e-12)
    # Without words drawn one by one: a row per number thrown went through a shuffle before.
    monkeypatch.setattr(sampling, "draw_by_ranges", None)
    assert sampling.negative_sampling_loss(df, targets, vocab, 3, 6, 2, max_bytes=0).count() == 120


@pytest.mark.parametrize("n", [0, 5, 60, 290, 300])
def test_many_draws_at_once_are_the_same(n):
    words = sampling.WordDraw.of(np.arange(300) * 3)
    batches = np.arange(700, dtype=np.int64) * 11
    found = words.places_many(batches, n, 7)
    assert found.shape == (700, n) and all((found[i] == words.places(int(b), n, 7)).all() for i, b in enumerate(batches))


def word_vec(spark, dim=3, double=False):
    rng = np.random.default_rng(1)
    rows = [(w, i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i, w in enumerate(["<eos>", "<unk>", "a", "b", "c"])]
    return spark.createDataFrame(rows, f"word string, id int, v array<{'double' if double else 'float'}>")


@pytest.mark.parametrize("oov", ["unk", "drop"])
def test_gather_in_slices(spark, oov):
    table = word_vec(spark)
    rows = [(1, ["a", None, "x"]), (2, None), (3, []), (4, ["b"] * 50), (5, ["c", "a"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").coalesce(1)
    ways = [lookup_vectors(df, table, oov, key=["k"], slice_bytes=b, max_bytes=m) for b, m in ((1, 1 << 20), (24, 1 << 20), (1 << 25, 1 << 20), (1, 0))]
    assert len({tuple(f.dataType.simpleString() for f in way.schema) for way in ways}) == 1
    results = [sorted(map(str, way.collect())) for way in ways]
    assert all(r == results[0] for r in results)
    ids = spark.createDataFrame([(1, [2, None, 77]), (2, None), (3, [4] * 9)], "k long, ids array<int>").coalesce(1)
    ways = [lookup_ids(ids, table.select("id", "v"), slice_bytes=b, max_bytes=m, key=["k"]) for b, m in ((1, 1 << 20), (1 << 25, 1 << 20), (1, 0))]
    assert len({str(sorted(map(str, way.collect()))) for way in ways}) == 1
    # A column of the result's name is replaced.
    assert lookup_vectors(ids.withColumn("tokens", F.array(F.lit("a"))), table, oov, out="IDS").columns == ["k", "tokens", "IDS"]


def test_bags_by_join(spark):
    table = word_vec(spark, 4, True)
    rows = [(1, ["a", None, "x", "a"]), (None, ["b", "c"]), (3, []), (4, None), (5, ["x"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    for oov in ("unk", "drop"):
        ways = [{r["k"]: r["v"] for r in encode_bow(df, table, oov, key=["k"], max_bytes=m).collect()} for m in (0, 1 << 20)]
        assert ways[0].keys() == ways[1].keys()
        for k in ways[0]:
            np.testing.assert_allclose(ways[0][k], ways[1][k], atol=1e-12)


@pytest.mark.parametrize("oov", ["unk", "drop"])
def test_gru_leaves_null_tokens_out(spark, oov):
    from sentloom.operators.dense import encode_gru

    table, fw = word_vec(spark), weights(3, 4, 2)
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, [None]), (3, ["a", "b"]), (4, None)], "k long, tokens array<string>")
    small = {r["k"]: r["v"] for r in encode_gru(df, table, fw, oov=oov).collect()}
    looked_up = lookup_vectors(df, table, oov, key=["k"], max_bytes=0)
    large = {r["k"]: r["v"] for r in encode_gru(looked_up, table, fw, oov=oov, tokens="vectors", max_bytes=0).collect()}
    assert small[1] == small[3] and small[2] == small[4] == [0.0] * 4
    for k in small:
        np.testing.assert_allclose(large[k], small[k], atol=1e-12)


def test_models_in_one_pass(spark):
    a, b = word_vec(spark), word_vec(spark, 5, True).filter("word <> 'b'")
    models = [SentenceModel(a, "unk"), SentenceModel(b, "drop"), SentenceModel(a, "drop", weights(3, 2, 1), weights(3, 2, 2))]
    df = spark.createDataFrame([(1, "a b zzz"), (2, ""), (3, "c"), (4, None)], "k long, text string")
    for norm in (False, True):
        one = {r["k"]: r["v"] for r in encode_multi(df, models, use_norm=norm).collect()}
        each = [{r["k"]: r["v"] for r in encode(df, m, use_norm=norm).collect()} for m in models]
        many = {r["k"]: r["v"] for r in encode_multi(df, models, use_norm=norm, key=["k"], max_bytes=0).collect()}
        for k in one:
            parts = [e[k] for e in each]
            wanted = None if any(p is None for p in parts) else sum(parts, [])
            assert (one[k] is None) == (wanted is None) == (many[k] is None)
            if wanted is not None:
                np.testing.assert_allclose(one[k], wanted, atol=1e-12)
                np.testing.assert_allclose(many[k], wanted, atol=1e-12)
    with pytest.raises(Exception, match="no tokens"):
        encode_multi(df, models, on_empty="error").collect()


def pairs_of(spark, x, y, parts=40):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y array<double>").repartition(parts, "id")


def test_fit_does_not_square_the_condition(spark):
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.normal(size=(400, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = u @ np.diag([1e5, 1.0, 1e-1, 1e-3, 1e-5]) @ v  # condition 1e10: its square is beyond double
    y = x @ rng.normal(size=(5, 2)) + 3
    fitted = fit_space_map(pairs_of(spark, x, y))
    full, *_ = np.linalg.lstsq(np.hstack([x, np.ones((400, 1))]), y, rcond=None)
    assert fitted.rank == 5
    np.testing.assert_allclose(x @ fitted.coef + fitted.intercept, y, atol=1e-7)
    c = x - x.mean(0)
    gram, *_ = np.linalg.lstsq(c.T @ c, c.T @ (y - y.mean(0)), rcond=None)
    assert np.abs(fitted.coef - full[:5]).max() < 1e-2 < np.abs(gram - full[:5]).max()


def test_fit_reports_the_rank(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    x = np.hstack([x, x[:, :1] + x[:, 1:2]])
    y = x @ rng.normal(size=(4, 2)) + 1
    fitted = fit_space_map(pairs_of(spark, x, y))
    assert fitted.rank == 3
    c, d = x - x.mean(0), y - y.mean(0)
    np.testing.assert_allclose(fitted.coef, np.linalg.pinv(c) @ d, atol=1e-9)
    one = fit_space_map(pairs_of(spark, x[:1], y[:1], 1))
    assert one.rank == 0
    np.testing.assert_allclose(one.intercept, y[0])
    r = triangular_factor(pairs_of(spark, x, y, 70))
    a = np.hstack([np.ones((50, 1)), x, y])
    np.testing.assert_allclose(r.T @ r, a.T @ a, atol=1e-9)


def test_neighbours_over_runs(spark):
    rows = [(g, p, f"{g}{p}") for g, n in (("a", 40), ("b", 1), ("c", 7)) for p in range(n) if p % 11 != 5] + [(None, 1, "x"), (None, 30, "y")]
    df = spark.createDataFrame(rows, "g string, p long, t string").repartition(4)
    ways = [sorted(map(str, neighbours(df, "g", "p", "t", size).collect())) for size in (1, 3, 10, 10**6)]
    assert all(way == ways[0] for way in ways)
    by_group: dict = {}
    for g, p, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by_group.setdefault(g, []).append(t)
    got = {(r["g"], r["t"]): (r["previous"], r["next"]) for r in neighbours(df, "g", "p", "t", 3).collect()}
    for g, texts in by_group.items():
        for i, t in enumerate(texts):
            assert got[g, t] == (texts[i - 1] if i else None, texts[i + 1] if i + 1 < len(texts) else None)
    plan = neighbours(df, "g", "p", "t", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_scan_where_bounds_exclude_nothing(spark, monkeypatch):
    monkeypatch.setattr("sentloom.operators.neighbours._SCAN_BYTES", 1 << 13)
    m = np.random.default_rng(9).normal(size=(300, 16))
    m[100:120], m[150] = m[3], 0.0
    rows = vectors(spark, m).select(vector_key().alias("key"), "id", "v")
    index = PivotIndex.build(rows, 5, 20)
    found = {r["key"]: [x["neighbour"] for x in r["near"]] for r in index.search(rows.groupBy("key").agg(F.any_value("v").alias("v"))).collect()}
    unit = m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), 1e-12))
    sims = np.round(unit @ unit.T, 10)
    for r in rows.collect():
        assert found[r["key"]] == list(np.lexsort((np.arange(300), -sims[r["id"]]))[:5])
    # A round of visits, then one scan: before, every (query, block) visit was a row with the vector.
    assert len(index.visits) == 2


@pytest.mark.parametrize("least", [None, 0.2])
def test_scored_in_tiles(monkeypatch, least):
    from sentloom.operators import neighbours

    for name, size in (("_TILE_ROWS", 7), ("_TILE_COLUMNS", 11), ("_EXACT", 13)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(3)
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(20, 5)), rng.normal(size=(60, 5))))
    b[30:50] = a[4]
    sims = np.round(a @ b.T, 10)
    for own in (None, np.arange(20) * 2):
        bound = None if least is None else np.full(20, least)
        found = [np.concatenate(c) for c in zip(*neighbours._scored(np.arange(20), a, np.arange(60), b, 4, bound, own), strict=True)]
        for i in range(20):
            order = [j for j in np.lexsort((np.arange(60), -sims[i])) if (least is None or sims[i, j] >= least) and (own is None or j != own[i])][:4]
            assert list(found[1][found[0] == i]) == order
            np.testing.assert_allclose(found[2][found[0] == i], sims[i, order])


def test_bag_sums_add_in_order(monkeypatch):
    from sentloom.operators import lookup

    monkeypatch.setattr(lookup, "LONG_SENTENCE", 4)  # before, one reduceat over all words
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(50, 3)).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum([0, 3, 4, 5, 0, 40, 1])])
    rows = rng.integers(0, 50, starts[-1])
    for sums, a, b in zip(lookup.bag_sums(rows, starts, matrix), starts, starts[1:], strict=False):
        total = np.zeros(3)
        for i in rows[a:b]:
            total = total + matrix[i]
        assert (sums == total).all()


def test_numbered_rows_meet_without_a_second_shuffle(spark):
    df = spark.createDataFrame([(["w0", "x"],), (["w1"],), (None,)], "tokens array<string>")
    found = lookup_vectors(df, word_vec(spark), "drop", max_bytes=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "coalesce(_row_key" not in plan  # a NULL-safe join deals the vectors out again
    assert found.count() == 3


def test_bags_move_a_vector_per_word_of_a_block(spark):
    """The joined bags ask for a word once per block of sentences; rows of a key that repeats count
    together, a long row comes in parts, NULL tokens are left out."""
    from sentloom.operators import lookup

    words = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [10.0, 20.0]), ("a", [0.5, 0.0])], "word string, v array<double>")
    rows = [(i, ["a", "b", "x", None, "a"]) for i in range(500)] + [(500, ["b"] * 400), (501, None), (502, []), (7, ["b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").coalesce(2)
    stored, _ = lookup._bags_by_block(df, words, "drop", "tokens", 1 << 10)
    asked = stored.select(F.explode("_words")).count()
    assert asked <= 3 * stored.select("_block").distinct().count()
    assert stored.filter("k = 500").count() > 1
    whole = {k: tokens for k, tokens in rows}
    for some in (df, df.filter("k < 400 and k <> 7 or k is null")):
        coded = encode_bow(some, words, "drop", key=["k"], max_bytes=0, block_bytes=1 << 10)
        assert coded.columns == ["k", "tokens", "v"]
        found = {r["k"]: r["v"] for r in coded.collect()}
        assert coded.count() == some.count()
        for k, v in found.items():
            bag = [w for key, tokens in rows if key == k for w in tokens or []]
            a, b = bag.count("a"), bag.count("b")
            assert v == [1.5 * a + 10 * b, 2.0 * a + 20 * b], k
        if some is not df:
            assert all(r["tokens"] == whole[r["k"]] for r in coded.collect())


def test_captions_without_clip_are_left_out_where_they_are(spark):
    from sentloom.operators.joins import with_key

    captions = spark.createDataFrame([(i % 7 if i % 7 else None, i) for i in range(50)], "clip_id long, pos long")
    clips = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (None, [3.0]), (5, None), (90, [4.0])], "clip_id long, v array<double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for max_bytes, join in ((1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            found = with_key(captions, clips, "clip_id", max_bytes)
            assert join in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(r["pos"] for r in found.collect()) == [i for i in range(50) if i % 7 in (1, 5)]
        from sentloom.plans.captions import image_records

        words = spark.createDataFrame([("a", 2)], "word string, id int")
        plan = image_records(captions.withColumn("tokens", F.array(F.lit("a"))), clips, words)._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin [clip_id" in plan.toString() and "LeftSemi" in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_neighbours_need_one_window_and_no_join(spark):
    rows = [("a", i, f"a{i}") for i in range(9)] + [(None, i, f"n{i}") for i in (0, 3, 5)] + [("b", None, "x"), ("b", None, "y"), ("b", 7, "z")]
    df = spark.createDataFrame(rows, "g string, i long, x string")
    near = neighbours(df.filter("g = 'a'"), "g", "i", "x")
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    for chunk_rows in (2, 4, 1000):
        near = neighbours(df, "g", "i", "x", chunk_rows)
        assert near.columns == ["g", "i", "x", "previous", "next"]
        found = {r["x"]: (r["previous"], r["next"]) for r in near.collect()}
        assert len(found) == near.count() == len(rows)
        assert all(found[f"a{i}"] == (f"a{i - 1}" if i else None, f"a{i + 1}" if i < 8 else None) for i in range(9))
        assert [found[f"n{i}"] for i in (0, 3, 5)] == [(None, "n3"), ("n0", "n5"), ("n3", None)]
        assert found["x"][1] is None and found["y"][1] is None


def test_ranked_computes_its_rows_twice(spark):
    """Once for the keys and once for the other columns, and not again for the sample of the sort."""
    from sentloom.operators.rank import ranked

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).repartition(4, "id").withColumn("x", F.col("id") * 2).mapInArrow(count, "id long, x long")
    found = ranked(df, "id").collect()
    assert sorted((r["id"], r["x"], r["rank"]) for r in found) == [(i, 2 * i, i) for i in range(1000)]
    assert seen.value <= 2000


def test_loss_adds_vectors_where_rows_are_scored(spark):
    """A run's ids are moved once, without vectors, and nothing is stored; the losses are those of the
    other ways."""
    from sentloom.operators.lookup import encode_bow

    rng = np.random.default_rng(5)
    sentences = [[int(x) for x in rng.integers(0, 40, rng.integers(0, 6))] for _ in range(240)]
    rows = [(i // 3, i % 3, *(sentences[(i + j) % 240] for j in (0, 1, 2))) for i in range(240)]
    df = spark.createDataFrame(rows, "batch long, row int, decode_pre array<int>, encode array<int>, decode_post array<int>").repartition(3)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)], "id int, v array<double>")
    vocab, inputs = table.select("id"), table.select(F.col("id").cast("string").alias("word"), F.reverse("v").alias("v"))

    def vectors(rows):
        return encode_bow(rows.withColumn("_w", F.transform("encode", lambda i: i.cast("string"))), inputs, "drop", "_w", "v").drop("_w")

    def losses(df, **options):
        found = sampling.negative_sampling_loss(df, table, vocab, 3, 6, 2, **options)
        return found, {(r["batch"], r["part"]): r["value"] for r in found.collect()}

    _, before = losses(vectors(df), max_bytes=0)
    for options in ({}, {"max_bytes": 0, "block_bytes": 0}, {"max_bytes": 0}):
        found, now = losses(df, vectors=vectors, **options)
        assert now.keys() == before.keys() and len(now) == 240
        assert all(now[k] == pytest.approx(before[k], abs=1e-9) for k in now)
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_run" in line]
    assert len(moved) == 1 and plan.index("Exchange hashpartitioning(_run") > plan.index("ArrowEvalPython")
    assert losses(df.limit(0), vectors=vectors, max_bytes=0)[1] == {}


def test_groups_of_equal_keys(spark):
    import pyarrow as pa

    parts = [[1, 1, 2], [], [2], [2, 3], [3], [5, 7]]
    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], names=["k"]) for p in parts]
    assert [t["k"].to_pylist() for t in sampling._groups(iter(batches), "k")] == [[1, 1], [2, 2, 2], [3, 3], [5], [7]]


def test_narrow_rows_are_ranked_whole(spark):
    """Without a join; rows whose keys repeat go by it, as before."""
    from sentloom.operators.rank import ranked

    rows = [(i * 37 % 100, None if i == 4 else i, f"x{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "a long, b long, x string").repartition(4)
    found = ranked(df, "a", "b", whole=True, total="n")
    assert found.columns == ["a", "b", "x", "rank", "n"]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r["rank"], r["x"], r["n"])
    assert sorted(map(key, found.collect())) == sorted(map(key, ranked(df, "a", "b", total="n").collect()))
    twice = df.unionByName(df.filter("a < 5"))
    assert ranked(twice, "a", "b", whole=True).count() == ranked(twice, "a", "b").count() == 95 + 5 * 4
    assert ranked(df.limit(0), "a", whole=True).count() == 0
