"""Edge rows through every operator, against plain versions where one exists."""

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import brute  # noqa: E402
from compare import duck, local_spark  # noqa: E402

import corpus_pipeline  # noqa: E402
from sentloom.llm import chat, decontam, langid, packing, pii, quality, sharding, simhash, urls, warc  # noqa: E402
from sentloom.llm.common import hash_sample, lookup_join  # noqa: E402
from sentloom.llm.components import connected_components  # noqa: E402
from sentloom.llm.oracle import ORACLES  # noqa: E402
from sentloom.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, base string"
LONG = "word " * 20_000 + "Mail a.b@c.de and +1 (017) 555-7713. " + "other words here " * 3000
TEXTS = [
    None, "", " \n\t", "short", LONG, LONG, "Ünï ÉCOLE a b c\x0b d\x1c e " * 20, "<|endoftext|> x", "don't 12,5 %%% &c.",
    "ip 1.2.3.4 and 256.1.1.1 card 4111 1111 1111 1111 phone +49 30 1234567 017 x@y.zz x@y", "一二三 四五 " * 60,
    "one two three four five six seven eight nine ten eleven", "ONE two, three-four FIVE six seven! eight nine ten",
]


@pytest.fixture(scope="module")
def spark():
    return local_spark()


@pytest.fixture(scope="module")
def docs(spark):
    ids = [*range(len(TEXTS) - 2), None, 3]  # a null and a repeated id
    rows = [(i, t, "en" if i else None, None if i == 2 else "s", 1, "x", 7, "y") for i, t in zip(ids, TEXTS, strict=True)]
    return spark.createDataFrame(rows + rows[4:6], SCHEMA)  # and repeated rows


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def texts(df):
    return [row.text for row in df.collect()]


def test_quality(docs, none):
    found = sorted(quality.ledger(docs).collect(), key=str)
    wanted = sorted((quality._measure((t or "").encode())[0] for t in texts(docs)))
    assert sorted(r.n_words for r in found) == wanted
    for text in TEXTS:
        n, chars, symbols, dup, repeat, _ = quality._measure((text or "").encode())
        b = brute.quality(text)
        assert [n, chars, symbols, dup, repeat] == [b[k] for k in quality.MEASURES[:-1]]
    assert quality.keep_passing(docs).columns == docs.columns
    assert quality.ledger(none).count() == 0 and quality.ablation(quality.ledger(none)).count() == 0


def test_ablation(docs):
    led = quality.ledger(docs)
    rows = {r.rule: r for r in quality.ablation(led).collect()}
    failed = [r.failed & quality.policy_mask("2") for r in led.collect()]
    assert rows["few_words"].rejects == sum(f & 1 for f in failed)
    assert rows["few_words"].alone == sum(f == 1 for f in failed)


def check_pieces(pieces, window):
    sequences = defaultdict(list)
    for start, length, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sum(window - sum(n for _, n in parts) for parts in sequences.values())


def test_packing(docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(packing.TOKENIZER))
    rows = packing.pack_documents(docs).collect()
    check_pieces([(r.start, r.length, r.sequence_id, r.offset) for r in rows], 4096)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for row in docs.dropDuplicates().collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(set(got[row.doc_id, len(ids)]))
        joined = b"".join(p for _, p in pieces)
        if len({s for s, _ in pieces}) == len(pieces):  # repeated rows may be cut elsewhere
            assert brute.crc(ids) == brute.crc(brute.np.frombuffer(joined, "<u4"))
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("partitions", [1, 211])
def test_packing_at_any_partitioning(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions, "doc_id")
    rows = packing.pack_documents(docs).drop("ids").collect()
    padding = check_pieces([(r.start, r.length, r.sequence_id, r.offset) for r in rows], 4096)
    tokens = sum(r.length for r in rows)
    assert padding < 0.01 * tokens
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r.length)
    cut = sum(len(p) > -(-n // 4096) for (_, n), p in pieces.items())
    assert cut < 0.1 * len(pieces)


def test_ids_of_letters_that_change_when_lower_cased():
    import random

    words, rng = packing.WordTokenizer(packing.TOKENIZER), random.Random(1)
    pool = "aZéÉİıßſŒẞǅΣςﬀÅ漢字кЖ,.!?;:'\"-12 \u0301\u0307\n\t<|>%"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        wanted = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert brute.np.frombuffer(ids, "<u4").tolist() == wanted, text


def test_packer_fills_windows():
    rng, pieces = brute.np.random.default_rng(1), []
    packer = packing.SumOfSquaresPacker(lambda k, s, n, q, o: pieces.append((s, n, q, o)), 0, window=64, max_open=8)
    sizes = [int(x) for x in rng.integers(1, 200, 3000)]
    for i, n in enumerate(sizes):
        packer.add(i, n)
    packer.finish()
    assert sum(n for _, n, _, _ in pieces) == sum(sizes)
    assert check_pieces(pieces, 64) < 2 * 64 + 64


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + [
    "a@b.c@d.e", "@x.y", "..@a.b-c.d.", "1.2.3.4.5.6.7.8", "0001.2.3.4 1234567890123456789", "+1234567 +12 34(56)78 9", "a@b.c1.2.3.4",
    "4111-1111-1111-1111 4111  1111", "+" * 50 + "1 23456789",
])
def test_base_spans(text):
    assert pii.base_spans(text) == brute.personal_data(text)


def test_field_adds_a_repeated_number(docs, none):
    text = "call +1 (017) 555-7713 now. " + "words " * 30 + "again +1 (017) 555-7713 ok"
    field = pii.Field.fit([pii.Graph(text, pii.base_spans(text))] * 20)
    other = "call +10175557713 now " + "words " * 30 + "or 10175557713 ok"
    added = pii.added_spans(field, other, pii.base_spans(other))
    assert [(kind, other[a:b]) for kind, a, b in added] == [("phone", "10175557713")]
    found = pii.find_personal_data(docs)
    assert found.count() == docs.count() and pii.find_personal_data(none).count() == 0
    redacted = [r.text for r in pii.redact(found).collect() if r.text and "card" in r.text]
    assert redacted[0] == "ip [IP] and 256.1.1.1 card [CARD] phone [PHONE] [EMAIL] x@y"


def test_field_finds_forms_that_patterns_reject():
    valid, invalid, secret = "4111111111111111", "9807915762804490", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    fitted = [f"some words {valid} and version 3. of 2019 with 12 parts", f'token = "{secret}" under version 4.0.'] * 10
    field = pii.Field.fit([pii.Graph(t, pii.base_spans(t) + pii.seed_spans(t)) for t in fitted])
    text = f'pay {invalid} by version 3. or token = "{secret}" in 2019'
    known = pii.base_spans(text) + pii.seed_spans(text)
    assert pii.base_spans(text) == [] and [text[a:b] for _, a, b in known] == [secret]
    assert [(kind, text[a:b]) for kind, a, b in pii.added_spans(field, text, known)] == [("card", invalid)]


def test_field_takes_many_numbers():
    text = "call +1 (017) 555-7713 " + " ".join(str(10**9 + i % 5000) for i in range(60_000))
    field = pii.Field.fit([pii.Graph("call +1 (017) 555-7713 ok", [("phone", 5, 22)])] * 3)
    assert isinstance(pii.added_spans(field, text, pii.base_spans(text)), list)


def test_sample_has_every_language(spark):
    rows = [("copy", "en")] * 500 + [(f"text {i}", "de") for i in range(40)] + [("seul", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("hash", F.xxhash64("text", "lang")).repartition(4)
    found = [(r.lang, r.text) for r in hash_sample(df, 10, "lang").collect()]
    assert sorted(lang for lang, _ in found) == ["de"] * 10 + ["en", "fr"]
    assert len(hash_sample(df, 10).collect()) == len({r.hash for r in hash_sample(df, 10).collect()}) == 10


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    prints = [r.fp & (2**64 - 1) for r in rows]
    assert sorted(prints) == sorted(brute.fingerprint(t) for t in texts(docs))
    assert [r.component_id for r in rows] == brute.components([r.doc_id for r in rows], prints)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_in_large_buckets(spark):
    rng = brute.np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=brute.np.uint64)
    prints = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (60, 2))})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for thresholds in ([0, 0, 0], [1, 0, -1], [-1, 2, -1]):
        groups = simhash.plan_partitions(nodes)[0]
        roots = {r.node: r.root for r in connected_components(simhash.links(nodes, groups, thresholds)).collect()}
        least = brute.components(list(range(len(prints))), prints)
        mine = defaultdict(set)
        for p, s, c in zip(prints, signed, least, strict=True):
            mine[roots.get(s, s)].add(c)
        assert all(len(x) == 1 for x in mine.values()) and len(mine) == len(set(least))


def test_near_copies_are_judged_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (7, a), (7, b), (None, c), (None, d), (None, d), (9, c), (9, c)]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], SCHEMA.split(", _text")[0])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(kept, key=lambda r: r[1]) == [(1, a), (7, b), (9, c), (None, d)]


def test_thresholds():
    costs = [{-1: 0, 0: 8, 1: 99, 2: 999}, {-1: 0, 0: 1, 1: 2, 2: 99}, {-1: 0, 0: 9, 1: 99, 2: 999}]
    assert simhash.choose_thresholds(costs) == [0, 1, -1]


def test_decontamination(spark, docs, none):
    items = {1: TEXTS[11], 2: "five six", 3: None, 4: "", 5: "nothing of it is anywhere", 12: TEXTS[12], 6: "Word"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontam.decontaminate(docs, bench).collect()
    got = sorted((r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in rows)
    assert got == sorted(brute.contamination(t, items) for t in texts(docs))
    assert decontam.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.filter("false")).collect())


def test_decontamination_is_linear_in_the_text(spark):
    import time

    item = " ".join(f"w{i}" for i in range(3000))
    bench = spark.createDataFrame([(i, item) for i in range(40)] + [(99, "x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, (item + " own words ") * 66), (2, "x y z"), (3, "w1 w2 w3")], "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert time.time() - start < 60
    assert (rows[1].n_words, rows[1].n_hit, len(rows[1]["items"])) == (66 * 3002, 66 * 3000, 40)
    assert rows[2]["items"] == ["99"] and not rows[3].contaminated


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a b\r\nX: y", big), (5, None, big), (5, "u", big), (None, "u", big), (2, "u", "small"), (3, "u", "small"), (4, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(warc.with_references(pages), str(tmp_path / "w"))
    for split in (64, 1000, 1 << 20):
        found = warc.read_warc(manifest, split)
        got = sorted((r.page_id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in found.collect())
        assert got == sorted([("1", "revisit", "5", 1200), ("5", "response", "", 1200), ("5", "response", "", 1200), ("", "revisit", "5", 1200), ("2", "response", "", 5), ("3", "response", "", 5), ("4", "response", "", 0)])
    empty = warc.write_warc(warc.with_references(pages.filter("false")), str(tmp_path / "e"))
    assert warc.read_warc(empty).count() == 0


def test_damaged_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(warc.with_references(pages), str(tmp_path / "w")).collect()
    path = Path(manifest[0].path.removeprefix("file:"))
    whole = path.read_bytes()
    third = [i for i in range(len(whole)) if whole.startswith(b"\x1f\x8b\x08", i)][2]
    for damaged in (whole[: third + 150] + bytes(x ^ 255 for x in whole[third + 150 : third + 152]) + whole[third + 152 :], whole[:-20]):
        path.write_bytes(damaged)
        sized = spark.createDataFrame([(manifest[0].path, len(damaged), 5)], "path string, bytes long, records long")
        with pytest.raises(Exception, match="damaged|cut off"):
            warc.read_warc(sized).collect()


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("", "/q", "block"), (None, "/", "block")], "host string, path string, verdict string")
    index = urls.build_index(rules)
    wanted = {
        None: ("", "", None, "allow"), "no": ("", "", None, "allow"), "http://A.com/x?y": ("a.com", "/x", "a.com/x", "block"),
        "http://b.a.com/xyz#": ("b.a.com", "/xyz", "a.com/x", "block"), "http://ba.com/x": ("ba.com", "/x", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"), "http://" + "." * 3000 + "com/": ("." * 3000 + "com", "/", "com/", "allow"),
    }
    df = spark.createDataFrame([(u, "z") for u in wanted], "url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, index).collect()]
    assert sorted(got, key=str) == sorted(wanted.values(), key=str)
    nothing = urls.judge_urls(df, urls.build_index(rules.filter("false")))
    assert {r.rule for r in nothing.collect()} == {None}


def test_digest_collision_is_confirmed(spark, monkeypatch):
    index = urls.build_index(spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string"))
    part = urls._Part(index.folder, index.parts[0])
    assert part.rule(0) == (3, "block", "com/")


def test_chat(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "q"), turn("assistant", "x <|end|>")]
    pairs = spark.createDataFrame(
        [(1, a, [a[0], turn("assistant", "y")]), (2, a, a), (3, None, a), (4, [], None)],
        f"id int, chosen {chat.TURNS}, rejected {chat.TURNS}",
    )
    r = {x.id: x for x in chat.format_preferences(pairs).collect()}
    assert r[1].prompt == "<|user|>\nq<|end|>\n" and r[1].chosen == "<|assistant|>\nx < |end|><|end|>\n"
    s = r[1].chosen_spans[0]
    assert r[1].chosen[s.start : s.end] == "x < |end|><|end|>"
    assert r[2].chosen == r[2].rejected == "" and r[2].prompt_turns == 2
    assert r[3].prompt == r[3].chosen == "" and r[3].rejected and r[4].rejected == ""


def test_sharding(docs, none):
    rows = sharding.document_shards(docs, 4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count()
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.document_shards(none, 4).count() == 0


def test_sharding_spreads_hot_ids_and_small_strata(spark):
    rows = [(7, f"text {i}", f"s{i}", "x") for i in range(400)] + [(None, f"t{i}", "big", "y") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, SHARD string")
    found = sharding.document_shards(df, 4).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
    assert {len(v) for v in by_shard.values()} == {200}
    assert all(sorted(r.slot for r in v) == list(range(200)) for v in by_shard.values())
    assert all(99 <= sum(r.source == "big" for r in v) <= 101 for v in by_shard.values())
    keyed = df.withColumn("SLOT", F.lit(1)).withColumn("_hash", F.lit(2))
    assert sharding.stratified_shards(keyed, "source", "doc_id", 3).columns == ["doc_id", "text", "source", "shard", "slot"]


def test_language_columns_of_other_case(spark):
    df = spark.createDataFrame([(1, "ein Text", "de", 1)], "doc_id long, text string, lang string, SCORE int")
    model = langid.Model([], None, None, None, 1.0)
    assert langid.predict(df, model).columns == ["doc_id", "lang", "lang_pred", "score"]


def test_language(spark, docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert langid.Model([], None, None, None, 1.0).predict("text") == ("und", 0.0)
    assert langid.ngram_counts("12 !?") is None and langid.identify(none).count() == 0


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op10_language"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)


def test_lookup_join_hot_key(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert {r.id: r.top for r in lookup_join(left, right, "k", "n", "id").collect()} == {
        r.id: r.top for r in left.join(right, "k", "left").select("id", "top").collect()
    }


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    mine = QUERIES[name](spark, FOLDER)
    other = duck(FOLDER).execute(ORACLES[name]).fetchall()
    order = [c[0] for c in duck(FOLDER).execute(f"SELECT * FROM ({ORACLES[name]}) LIMIT 0").description]
    assert sorted(map(str, map(tuple, mine.select(*order).collect()))) == sorted(map(str, other))


def test_pipeline_stages(spark, docs, none):
    sf = FOLDER
    for table_, size in ((docs, None), (none, 0)):
        stage = table_
        for _, function in corpus_pipeline.STAGES[:-1]:
            stage = function(spark, stage, sf)
            assert stage.columns == table_.columns
        assert corpus_pipeline.STAGES[-1][1](spark, stage, sf).count() >= (size or 0)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    kept = [r for r in docs.collect() if not quality_fails(r.text)]
    ids = [r.doc_id for r in kept]
    groups = brute.components(ids, [brute.fingerprint(r.text) for r in kept])
    kept = [r for r, g in zip(kept, groups, strict=True) if r.doc_id == g]
    kept = {r.doc_id for r in kept if not brute.contamination(r.text, bench)[1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()} == kept


def quality_fails(text):
    b = brute.quality(text)
    n, lines = b["n_words"], [x for x in (text or "").split("\n") if x.split()]
    return (
        b["base_failed"] or 10 * b["n_symbols"] > 3 * n or 2 * b["n_dup_lines"] > len(lines)
        or b["word_chars"] < 2 * n or b["word_chars"] > 20 * n
    )
