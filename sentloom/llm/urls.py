"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

Spark sorts the rules by digest and writes the index in range parts: digests, offsets and the full
strings. A task maps the parts, hashes the candidate keys of a batch of URLs (host suffixes and
path prefixes of lengths that occur among the rules), finds all of them by one ``searchsorted`` and
confirms each hit against the stored string, so a digest collision never decides.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentloom.llm.common import free_name
from sentloom.session import checkpoint_root, materialize

SEED = 42  # of Spark's xxhash64
#: Rules in one part of the index.
PART_RULES = 4_000_000
DEFAULT_VERDICT = "allow"

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Index:
    """What tasks need to find the parts: a folder, part names, and the rules' shapes."""

    def __init__(self, folder: str, parts: list[str], labels: list[int], lengths: list[int]) -> None:
        self.folder, self.parts, self.labels, self.lengths = folder, parts, labels, lengths


def build_index(rules: DataFrame, part_rules: int = PART_RULES) -> Index:
    """Index of ``rules`` (host, path, verdict). Rules with a null host or path are none; of rules
    with equal host and path the least verdict counts. No rules give an index that fits nothing.

    The driver holds part names and the distinct label counts and path lengths only.
    """
    spark = rules.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/urls-{uuid.uuid4().hex}"
    whole = materialize(
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.concat("host", "path").alias("rule"))
        .withColumn("digest", F.xxhash64("rule"))
    )
    shapes = whole.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")
    ).distinct().collect()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, texts = [], []
        for batch in batches:
            digests.append(batch.column(0).to_numpy().view(np.uint64))
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                texts.append(f"{len(host)}\t{verdict}\t{host}{path}".encode())
        if not texts:
            return
        name = uuid.uuid4().hex  # an attempt that is run again leaves a part nobody names
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for kind, data in (("keys", np.concatenate(digests).tobytes()), ("ends", ends.tobytes()), ("text", b"".join(texts))):
            with target.open_output_stream(f"{root}/{name}.{kind}", compression=None) as out:
                out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    n_parts = max(1, -(-whole.count() // part_rules))
    # Unsigned order of the digests, as the probes compare them.
    order = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
    parts = materialize(
        whole.repartitionByRange(n_parts, order).sortWithinPartitions(order, "rule", F.length("host"))
        .select("digest", "host", "path", "verdict").mapInArrow(written, "name string")
    )
    return Index(
        folder,
        sorted(row.name for row in parts.collect()),
        sorted({row.labels for row in shapes}),
        sorted({row.length for row in shapes}),
    )


class _Part:
    def __init__(self, folder: str, name: str) -> None:
        source, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/{name}"
        if not isinstance(source, fs.LocalFileSystem):
            local = f"{tempfile.mkdtemp()}/{name}"  # a copy to map, this worker's own
            for kind in ("keys", "ends", "text"):
                fs.copy_files(f"{path}.{kind}", f"{local}.{kind}", source_filesystem=source, destination_filesystem=fs.LocalFileSystem())
            path = local
        self.keys = np.memmap(f"{path}.keys", np.uint64, "r")
        self.ends = np.memmap(f"{path}.ends", np.int64, "r")
        self.text = np.memmap(f"{path}.text", np.uint8, "r")

    def rule(self, i: int) -> tuple[int, str, str]:
        """Length of the host, verdict, and the full string."""
        start = int(self.ends[i - 1]) if i else 0
        length, verdict, rule = bytes(self.text[start : int(self.ends[i])]).decode().split("\t", 2)
        return int(length), verdict, rule


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _suffixes(host: str, labels: list[int]) -> Iterator[str]:
    """The host's endings of so many labels."""
    at, n = len(host), 0
    for wanted in labels:
        while n < wanted and at >= 0:
            at = host.rfind(".", 0, at) if at else -1
            n += 1
        if n == wanted:
            yield host[at + 1 :]
        if at < 0:
            return


_MAPPED: dict[str, list[_Part]] = {}


def judge_urls(df: DataFrame, index: Index, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``df`` without ``url_col``, with ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``.

    The longest fitting rule wins, of equally long ones that with the longer host. A null URL,
    or one without ``://``, has empty host and path. Equal rows are judged alike. No shuffle.
    """
    carry = [c for c in df.columns if c not in (url_col, "host", "path", "rule", "verdict")]
    names = ["host", "path", "rule", "verdict"]
    schema = df.select(*carry).schema
    for name in names:
        schema = schema.add(name, "string")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if index.folder not in _MAPPED:
            _MAPPED[index.folder] = [_Part(index.folder, name) for name in index.parts]
        for batch in batches:
            split = [split_url(url) for url in batch.column(batch.num_columns - 1).to_pylist()]
            best: list[tuple[int, int, str, str] | None] = [None] * len(split)
            keys: list[tuple[int, str, int]] = []
            for i, (host, path) in enumerate(split):
                for suffix in _suffixes(host, index.labels) if host else ():
                    keys += [(i, suffix + path[:n], len(suffix)) for n in index.lengths if n <= len(path)]
            digests = np.fromiter((xxh64_intdigest(k.encode(), SEED) for _, k, _ in keys), np.uint64, len(keys))
            for part in _MAPPED[index.folder]:
                places = np.searchsorted(part.keys, digests)
                inside = np.minimum(places, len(part.keys) - 1)
                for j in np.flatnonzero((places < len(part.keys)) & (part.keys[inside] == digests)):
                    i, key, n_host = keys[j]
                    at = int(places[j])
                    while at < len(part.keys) and part.keys[at] == digests[j]:
                        length, verdict, rule = part.rule(at)
                        found = (len(rule), length, rule, verdict)
                        if rule == key and length == n_host and (best[i] is None or found[:2] > best[i][:2]):
                            best[i] = found
                        at += 1
            columns = [
                [h for h, _ in split],
                [p for _, p in split],
                [b and b[2] for b in best],
                [b[3] if b else default for b in best],
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c, pa.string()) for c in columns]],
                names=[*carry, *names],
            )

    return df.select(*carry, F.col(url_col).alias(free_name(df, "url"))).mapInArrow(judged, schema)
