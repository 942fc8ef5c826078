"""The registered queries against the plain versions, on whole small tables."""

import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import brute  # noqa: E402
from compare import local_spark  # noqa: E402

from sentloom.llm import packing, pii  # noqa: E402
from sentloom.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return local_spark()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def check_op1(rows, docs, spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(packing.TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, doc in docs.items():
        ids = [*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at
    assert padding < 4096  # one task


def check_op2(rows, docs, spark):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    for r in rows:
        wanted = brute.contamination(docs[r.doc_id].text, bench)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == wanted and r.contaminated == (r.n_hit > 0)


def check_op5(rows, docs, spark):
    added = 0
    for r in rows:
        text = docs[r.doc_id].text or ""
        base = sorted(brute.personal_data(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert set(base) <= set(spans)
        more = set(spans) - set(base)
        assert all(text[a:b].strip() and a >= 0 for _, a, b in more)
        assert all(b <= c or d <= a for _, a, b in more for _, c, d in base)
        added += len(more)
    assert added


def check_op6(rows, docs, spark):
    prints = [brute.fingerprint(docs[r.doc_id].text) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == brute.components([r.doc_id for r in rows], prints)


def check_op8(rows, docs, spark):
    slots, mixture, shards = defaultdict(list), Counter(), Counter()
    sources = Counter(d.source for d in docs.values())
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
        mixture[r.shard, docs[r.doc_id].source] += 1
        shards[r.shard] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 8
    for shard in shards:
        for source, n in sources.items():
            assert abs(mixture[shard, source] - n / 8) < 2, (shard, source)


def check_op9(rows, docs, spark):
    for r in rows:
        wanted = brute.quality(docs[r.doc_id].text)
        assert {k: r[k] for k in wanted} == wanted
        assert not (r.base_failed and r.kept)


def check_op10(rows, docs, spark):
    learned = {d.lang for i, d in docs.items() if zlib.crc32(str(i).encode()) % 5 and d.lang and d.text}
    right = total = 0
    for r in rows:
        doc = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in doc.text or ""):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learned
        if r.held_out and doc.lang:
            right, total = right + (r.lang_pred == doc.lang), total + 1
    assert right > 0.9 * total


@pytest.mark.parametrize("name", ["op1_packing", "op2_decontamination", "op5_personal_data", "op6_simhash", "op8_sharding", "op9_quality", "op10_language"])
def test_registered_query(spark, docs, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs)
    if name != "op1_packing":
        assert len(rows) == len(docs)
    globals()[f"check_{name.split('_')[0]}"](rows, docs, spark)
