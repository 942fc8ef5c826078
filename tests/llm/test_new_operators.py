"""Line dedup, prefix trie and hard negatives: edge rows against plain versions."""

import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from compare import local_spark  # noqa: E402

from sentloom.llm import bursttrie, linededup, negatives  # noqa: E402

SPACES = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def spark():
    return local_spark()


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plain_lines(texts, min_docs, min_chars):
    docs = Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[line_key(x)] < min_docs or len(line_key(x)) < min_chars]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


TEXTS = [
    None, "", " \n\t", "a\nB \nc", "A\nb\nÉ x", "é X\nÉ x\nd\n", "\n\na\n\nb", "long line\n" * 3000, "x " * 30_000 + "\nLONG LINE", "a\r\nb \nz",
    *["copy one\ncopy two\n\nown"] * 7, *[f"Common Line\nown {i}\n common line\t" for i in range(40)],
]


@pytest.mark.parametrize(("min_docs", "min_chars", "batches"), [(2, 1, 1), (10, 1, 5), (2, 4, 3)])
def test_frequent_lines_are_dropped(spark, min_docs, min_chars, batches):
    rows = [(i if i % 5 else None, t, "k", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string, text_key long").repartition(5)
    found = linededup.drop_frequent_lines(docs, "text", min_docs, min_chars, batches)
    assert found.columns == ["doc_id", "text", "text_key", "n_lines", "n_dropped", "kept"]
    got = sorted(((r.text or "", r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str)
    wanted = [((t or ""), *p) for t, p in zip(TEXTS, plain_lines(TEXTS, min_docs, min_chars), strict=True)]
    assert got == sorted(wanted, key=str)


def test_runs_are_levelled_and_keep_all_counts(spark):
    runs, counts = linededup.LineRuns(spark, 4), Counter()
    for batch in range(7):
        rows = [(h, h, 1 + (h + batch) % 2, 1) for h in range(batch, batch + 12)]
        counts.update({h: n for h, _, n, _ in rows})
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, n_lines long"))
        assert len([run for run in runs.levels if run is not None]) == (batch + 1).bit_count()
    assert {r.h1 for r in runs.settled().collect()} == {h for h, n in counts.items() if n >= 4}
    runs.close()
    assert not linededup.LineRuns(spark).settled().collect()


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.drop_frequent_lines(none).count() == 0


def plain_trie(sequences):
    """{conv: [(role, text), …]} → the nodes' rows."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def total(p):
        parts = [total(q) for q in below[p]]
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        return sum(x for x, _ in parts) or 1, own + sum(x for _, x in parts)

    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        leaves, saved = total(p)
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def conversations(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(400, n, replace=False):
        for turn in range(rng.integers(1, 9)):
            rows.append((int(c), turn, ["user", None, "bot"][rng.integers(0, 3)], ["", "a", "bb", None, "ééé"][rng.integers(0, 5)]))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (-105, 1, "user", "x"), (-5, 3, "u", "y"), (-5, 3, "a", "z"), (None, 1, "u", "lost")]
    rows += [(900 + c, t, "u", f"t{t % 7}") for c in range(3) for t in range(9 + c)]
    return rows + rows[:3]


@pytest.mark.parametrize(("limit", "piece"), [(20_000, 4096), (3, 4096), (4, 5)])
def test_trie(spark, limit, piece):
    rows = conversations(limit + piece, 60)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [tuple(r) for r in bursttrie.prefix_trie(turns, limit, piece).collect()]
    assert sorted(got, key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_of_one_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string, CONV string, n long"
    assert bursttrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    long = [(3, t, "u", "w" * (t % 3), "x", 1) for t in range(9000)]
    got = [tuple(r) for r in bursttrie.prefix_trie(spark.createDataFrame(long, schema)).collect()]
    n = len(plain_rebuilt([r[:4] for r in long])[3])
    assert sorted(r[1] for r in got) == list(range(n + 1)) and {r[3] for r in got} == {1} and {r[6] for r in got} == {0}


def plain_negatives(rows):
    """[(id, label, vector)] of different ids."""
    v = {i: [int(np.floor(256 * float(x))) for x in vec] for i, label, vec in rows}
    label = {i: (label + 1) % 10 if i % 7 == 0 else label for i, label, _ in rows}
    out = []
    for a in (i for i in v if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(v[a], v[i], strict=True)) for i in v if i != a and len(v[i]) == len(v[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            inside = [i for i in order if label[i] != label[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(inside[:10], 1)]
    return sorted(out)


def mined(spark, rows, **limits):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, LABEL_ string, row string").repartition(3)
    moved = df.selectExpr("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "embedding")
    found = negatives.quantised(moved)
    return sorted(tuple(r) for r in negatives.hard_negatives(found, found.filter("id % 100 = 0")).collect())


@pytest.mark.parametrize(("scale", "dim", "blocks"), [(1.0, 8, 1 << 22), (1e5, 3, 1 << 22), (0.01, 4, 300)])
def test_negatives(spark, monkeypatch, scale, dim, blocks):
    monkeypatch.setattr(negatives, "BLOCK_VALUES", blocks)
    monkeypatch.setattr(negatives, "GROUP_VALUES", 4 * dim)
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(700, dim)) * scale
    vectors[100:180] = vectors[100]  # ties
    vectors[200] = 0
    rows = [(i, int(rng.integers(0, 10)), [float(x) for x in v], "x", "y") for i, v in enumerate(vectors)]
    bad = [(None, 1, [1.0] * dim), (5000, None, [1.0] * dim), (5100, 1, None), (5200, 1, [None] + [1.0] * (dim - 1)), (5300, 1, [float("nan")] * dim),
           (5400, 1, [float("inf")] * dim)]
    other = [(6000, 1, [1.0]), (6001, 1, [2.0]), (6003, 2, [1.5]), (6100, 1, [])]
    more = [(*r, "x", "y") for r in bad + other]
    got = mined(spark, rows + more + rows[:20])
    assert got == plain_negatives([r[:3] for r in rows] + other)
    assert got


def test_reading_stops_before_the_end():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n, seen = 5000, 0
    group = pa.table({"id": np.arange(n), "row": [str(i) for i in range(n)], "label": np.zeros(n, int), "v": list(rng.integers(-99, 99, (n, 3)).astype(float))})
    lists = negatives.Lists(group)
    for places, scores, threshold in lists.read(np.array([3.0, -2.0, 1.0])):
        seen += len(places)
        if threshold < np.sort(scores)[-1]:
            break
    assert seen < n / 2


def test_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0], "x", "y")]) == []
