"""Personal data: exact patterns, and a skip-chain conditional random field for what they miss.

The patterns (``base_spans``) are the certain part; quoted hexadecimal secrets are seeds beside them. The
field runs over a document's candidate tokens (those with a digit or an @). Neighbouring candidates share
a chain potential; distant candidates that are the same token, or have the same digits, share a skip
potential, so that what is a phone number in one place is one elsewhere, written without its plus sign.
Pattern and seed spans are clamped; loopy message passing gives the marginals of the rest.

The weights are fitted by pseudo-likelihood on a bounded sample. A token that has the form of a kind but
fails its pattern (a 16-digit number without a valid check digit) is of unknown label there, not a
negative: so form, context and repetition decide about it, and not the pattern once more.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.llm.common import hash_sample, slices

KINDS = ("email", "ip", "card", "phone")
#: The field's kinds; the last one has seeds, but no base spans.
FIELD_KINDS = (*KINDS, "secret")
N_LABELS = len(FIELD_KINDS) + 1  # 0: none of them
#: Documents (with candidates, of at most so many bytes) that the field is fitted on.
FIT_DOCUMENTS, FIT_BYTES = 2000, 1 << 16
#: Digits that a token without @ needs to be added; fewer name nobody.
MIN_DIGITS = 7
#: A token outside the patterns' spans needs this marginal to be added.
MIN_MARGINAL = 0.9
ROUNDS, DAMPING = 10, 0.5

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
_SECRET = re.compile(r'"([0-9A-Fa-f]{32,})"')
#: Forms of the kinds, whether or not their patterns' checks hold.
_FORMS = re.compile(r"[0-9]{13,19}|\+?[0-9()-]{8,}|[0-9]+(?:\.[0-9]+){3}|.+@.+\..+|[0-9A-Fa-f]{20,}")
_HEX = re.compile(r"[0-9A-Fa-f]{20,}")
_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_EDGE = ".,;:!?\"'<>[]{}|*#$%&"

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Left to right, without overlaps. Goes from each @ outwards, so a long run of letters
    without one costs nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start; code points, the end exclusive."""
    found = list(_emails(text))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def seed_spans(text: str) -> list[Span]:
    """Quoted hexadecimal strings with letters and digits."""
    if '"' not in text:
        return []
    return [
        ("secret", *m.span(1)) for m in _SECRET.finditer(text)
        if re.search("[0-9]", m[1]) and re.search("[A-Fa-f]", m[1])
    ]


class Graph:
    """A document's candidate tokens: features, labels from the known spans, and edges. ``unknown``:
    tokens outside these spans that have a kind's form."""

    def __init__(self, text: str, base: list[Span]) -> None:
        self.spans: list[tuple[int, int]] = []
        features: list[list[int]] = []
        keys: list[tuple[str, str]] = []
        chain: list[tuple[int, int]] = []
        last_token, before = -2, ""
        forms: list[bool] = []
        for number, m in enumerate(_TOKEN.finditer(text)):
            if not _CANDIDATE.search(m[0]):
                before = m[0]
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            token = m[0].strip(_EDGE)
            if not token:
                continue
            if number == last_token + 1 and self.spans:
                chain.append((len(self.spans) - 1, len(self.spans)))
            last_token = number
            self.spans.append((start, start + len(token)))
            digits = re.sub("[^0-9]", "", token)
            features.append(_features(token, digits, before))
            forms.append(_FORMS.fullmatch(token) is not None)
            before = ""
            keys.append((token.lower(), digits if len(digits) >= 7 else ""))
        self.features = np.array(features, np.int64).reshape(len(features), N_FEATURES)
        self.chain = np.array(chain, np.int64).reshape(len(chain), 2)
        self.skip = _skip_edges(keys)
        self.labels = np.zeros(len(features), np.int64)
        self.clamped = np.zeros(len(features), bool)
        starts, ends = (np.array([x[i] for x in self.spans], np.int64) for i in (0, 1))
        for kind, start, end in base:
            # Tokens don't overlap, so those that meet the span are neighbours.
            first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
            for i in range(first, last):
                if not self.clamped[i]:
                    self.labels[i], self.clamped[i] = FIELD_KINDS.index(kind) + 1, True
        self.unknown = np.array(forms, bool) & ~self.clamped


def _skip_edges(keys: list[tuple[str, str]]) -> np.ndarray:
    """Each token and the one before it with an equal spelling or equal digits: a chain of the
    occurrences, linear in their number."""
    last: dict[tuple[int, str], int] = {}
    edges: set[tuple[int, int]] = set()
    for i, key in enumerate(keys):
        for form, value in enumerate(key):
            if value:
                if (form, value) in last:
                    edges.add((last[form, value], i))
                last[form, value] = i
    return np.array(sorted(edges), np.int64).reshape(len(edges), 2)


#: Classes of the word before a candidate, by hash.
CONTEXTS = 16
#: Feature columns, each with its number of values.
_SIZES = (20, 5, 3, 4, 3, 3, 2, 2, CONTEXTS)
N_FEATURES = len(_SIZES)
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_WEIGHTS = sum(_SIZES)


def _features(token: str, digits: str, before: str) -> list[int]:
    letters = sum(c.isalpha() for c in token)
    values = (
        min(len(digits), 19),
        min(token.count("."), 4),
        min(token.count("@"), 2),
        min(token.count("-"), 3),
        min(letters, 2),
        min(token.count("(") + token.count(")") + token.count("+"), 2),
        int(len(digits) + letters == len(token)),
        int(_HEX.fullmatch(token) is not None),
        zlib.crc32(before.lower().encode()) % CONTEXTS if before else 0,
    )
    return [int(s + v) for s, v in zip(_STARTS, values, strict=True)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Field:
    """Weights: ``unary`` by feature and label, ``chain`` by the two labels, ``skip`` for equal
    labels along a skip edge."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    @staticmethod
    def fit(graphs: list[Graph], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Pseudo-likelihood: each token's label given its features and its neighbours' labels. Tokens
        of unknown label, and their edges, are left out.
        No graphs, or none with candidates, give weights of zero but for the skip bonus."""
        unary = np.zeros((N_WEIGHTS, N_LABELS))
        chain = np.zeros((N_LABELS, N_LABELS))
        skip = 1.0
        graphs = [g for g in graphs if len(g.labels)]
        if not graphs:
            return Field(unary, chain, skip)
        offsets = np.cumsum([0] + [len(g.labels) for g in graphs])
        features = np.concatenate([g.features for g in graphs])
        labels = np.concatenate([g.labels for g in graphs])
        chains = np.concatenate([g.chain + o for g, o in zip(graphs, offsets, strict=False)])
        skips = np.concatenate([g.skip + o for g, o in zip(graphs, offsets, strict=False)])
        known = ~np.concatenate([g.unknown for g in graphs])
        chains = chains[known[chains].all(1)]
        skips = skips[known[skips].all(1)]
        n, truth = max(int(known.sum()), 1), np.eye(N_LABELS)[labels]
        agree = np.zeros((len(labels), N_LABELS))
        for a, b in (skips.T, skips.T[::-1]):
            np.add.at(agree, a, truth[b])
        for _ in range(steps):
            score = unary[features].sum(1) + skip * agree
            np.add.at(score, chains[:, 0], chain[:, labels[chains[:, 1]]].T)
            np.add.at(score, chains[:, 1], chain[labels[chains[:, 0]]])
            error = (truth - _softmax(score)) * known[:, None] / n
            step = np.zeros_like(unary)
            for column in features.T:
                np.add.at(step, column, error)
            turn = np.zeros_like(chain)
            np.add.at(turn.T, labels[chains[:, 1]], error[chains[:, 0]])
            np.add.at(turn, labels[chains[:, 0]], error[chains[:, 1]])
            unary += rate * N_FEATURES * (step - decay * unary)
            chain += rate * N_FEATURES * (turn - decay * chain)
            skip = max(0.5, skip + rate * N_FEATURES * float((error * agree).sum()))
        return Field(unary, chain, skip)

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product; messages along an edge and against it, all at once."""
        node = self.unary[graph.features].sum(1)
        node[graph.clamped] = np.where(
            np.eye(N_LABELS, dtype=bool)[graph.labels[graph.clamped]], 0.0, -50.0
        )
        same = self.skip * np.eye(N_LABELS)
        source = np.concatenate([graph.chain[:, 0], graph.chain[:, 1], graph.skip[:, 0], graph.skip[:, 1]])
        target = np.concatenate([graph.chain[:, 1], graph.chain[:, 0], graph.skip[:, 1], graph.skip[:, 0]])
        n, m = len(graph.chain), len(graph.skip)
        if n + m == 0:
            return _softmax(node)
        # Edges by the table of their potentials; no edge has a table of its own.
        runs = ((slice(0, n), self.chain), (slice(n, 2 * n), self.chain.T), (slice(2 * n, None), same))
        back = np.concatenate([np.arange(n) + n, np.arange(n), 2 * n + m + np.arange(m), 2 * n + np.arange(m)])
        message = np.zeros((len(source), N_LABELS))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = np.empty_like(out)
            for run, pair in runs:
                for label in range(N_LABELS):
                    new[run, label] = np.logaddexp.reduce(out[run] + pair[:, label], axis=1)
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = node.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def added_spans(field: Field, text: str, known: list[Span]) -> list[Span]:
    """Tokens outside the known spans that the field gives a kind by their marginals."""
    graph = Graph(text, known)
    if graph.clamped.all():
        return []
    marginals = field.marginals(graph)
    added = []
    for i in np.flatnonzero(~graph.clamped):
        label = int(marginals[i].argmax())
        start, end = graph.spans[i]
        if label and marginals[i, label] >= MIN_MARGINAL:
            token = text[start:end]
            if "@" in token or len(re.sub("[^0-9]", "", token)) >= MIN_DIGITS:
                added.append((FIELD_KINDS[label - 1], start, end))
    return added


def fit_field(df: DataFrame, id_col: str, text_col: str, n_documents: int = FIT_DOCUMENTS) -> Field:
    """Fit on the first ``n_documents`` of the different documents with candidates and at most
    ``FIT_BYTES`` bytes, in an order by hash: a sample of documented size, the same on every
    cluster. Hashes alone are sorted; the texts are then fetched by them."""
    rows = df.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = rows.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= FIT_BYTES))
    sample = hash_sample(rows, n_documents).select("text")
    graphs = [Graph(row.text, base_spans(row.text) + seed_spans(row.text)) for row in sample.orderBy(F.md5("text")).collect()]
    return Field.fit(graphs)


def find_personal_data(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    field: Field | None = None,
    base_col: str = "base",
    spans_col: str = "spans",
) -> DataFrame:
    """One row per row of ``df``: all its columns, ``base_col`` and ``spans_col``, arrays of
    (kind, start, end) by kind and start; the latter holds the base spans, the seeds and the field's.

    Null and empty texts have no spans. Each row stands for itself, whatever its id. An empty
    table gives an empty result. Columns of these two names are replaced. No shuffle.
    """
    fitted = field or fit_field(df, id_col, text_col)
    span = T.ArrayType(
        T.StructType(
            [
                T.StructField("kind", T.StringType()),
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
            ]
        )
    )
    rows = df.drop(*[c for c in df.columns if c.lower() in (base_col, spans_col)])
    schema = T.StructType([*rows.schema.fields, T.StructField(base_col, span), T.StructField(spans_col, span)])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {kind: i for i, kind in enumerate(FIELD_KINDS)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                base_rows, all_rows = [], []
                for data in texts:
                    text = data.decode()
                    base, more = [], []
                    if _CANDIDATE.search(text):
                        base, seeds = base_spans(text), seed_spans(text)
                        more = seeds + added_spans(fitted, text, base + seeds)
                    spans = sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2]))
                    for rows_, values in ((base_rows, base), (all_rows, spans)):
                        rows_.append([{"kind": k, "start": a, "end": b} for k, a, b in values])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(base_rows, arrow_span), pa.array(all_rows, arrow_span)],
                    names=[*part.schema.names, base_col, spans_col],
                )

    return rows.mapInArrow(found, schema)


def redact(
    df: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans"
) -> DataFrame:
    """Replace the spans of :func:`find_personal_data` by ``[KIND]``; overlapping spans become one
    mark, of the first. Adds no column and drops the two of spans."""
    merged = F.aggregate(
        F.array_sort(
            F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        ),
        F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("done")),
        lambda acc, s: F.when(s["start"] < acc["done"], F.struct(
            acc["text"].alias("text"), F.greatest(acc["done"], s["end"]).alias("done"))
        ).otherwise(
            F.struct(
                F.concat(
                    acc["text"],
                    F.substring(F.col(text_col), (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")),
                    F.lit("["), F.upper(s["kind"]), F.lit("]"),
                ).alias("text"),
                s["end"].alias("done"),
            )
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), (acc["done"] + 1).cast("int"), F.length(text_col))),
    )
    changed = F.when(F.size(spans_col) > 0, merged).otherwise(F.col(text_col))
    return df.withColumn(text_col, changed).drop(base_col, spans_col)
