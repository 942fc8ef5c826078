"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the archives to tasks. A
task scans its range for gzip's magic bytes, decodes the start of each candidate to see whether a
WARC record begins there, and owns the records whose member starts inside its range, reading past
its end where the last one goes on. So every record is read once, wherever the borders fall.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentloom.llm.common import lookup_join
from sentloom.session import checkpoint_root, materialize

#: Smaller payloads are stored again instead of revisited.
MIN_REVISIT = 1000
#: Bytes of an archive per reading task.
SPLIT_BYTES = 16 << 20
#: Reading tasks; more splits share them.
MAX_TASKS = 50_000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``digest`` (hex SHA-1), and ``refers_to``: null for a
    response, else the largest id among the rows of an equal payload.

    Null bodies are empty payloads. Rows that share the largest id are all responses; where all
    ids are null, so are all rows. Only digests are grouped; a hot payload is not gathered.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= MIN_REVISIT
    keyed = rows.withColumn("_key", F.when(large, F.col("digest")))
    groups = materialize(
        keyed.filter(F.col("_key").isNotNull()).groupBy(F.col("_key"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("_n")).filter("_n > 1")
    )
    found = lookup_join(keyed, groups, "_key", "_n", "page_id")
    return found.select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
    )


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{b32}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`with_references` as archives under ``folder``, one per task; the
    manifest (``path``, ``bytes``, ``records``) that comes back is stored and names the files of the
    attempts that succeeded. A lost executor's half file is in no manifest."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        path, out, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if out is None:
                    target.create_dir(root, recursive=True)
                    out = target.open_output_stream(path, compression=None)
                data = _record(*row)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            name = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    rows = records.select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(written, "path string, bytes long, records long"))


class _Bytes:
    """A file's bytes from any offset on, a chunk at a time; what was passed is let go."""

    def __init__(self, file, size: int, start: int) -> None:
        self.file, self.size, self.start, self.data = file, size, start, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            more = self.file.read_at(max(end - have, min(CHUNK, self.size - have)), have)
            if not more:
                raise ValueError(f"archive ends at byte {have}, {self.size} expected")
            self.data += more

    def drop(self, offset: int) -> None:
        if offset - self.start >= CHUNK:
            self.data, self.start = self.data[offset - self.start :], offset

    def find(self, what: bytes, offset: int, end: int) -> int:
        """The first place of ``what`` that starts in [offset, end), or -1."""
        while offset < end:
            self.drop(offset)
            self.upto(offset + CHUNK)
            at = self.data.find(what, offset - self.start)
            if at >= 0:
                return self.start + at if self.start + at < end else -1
            have = self.start + len(self.data)
            if have >= self.size:
                return -1
            offset = max(offset, have - len(what) + 1)
        return -1

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """The gzip member at ``offset`` and its end, if a WARC record begins there. Once its version line
        was seen, damage is an error: a record doesn't vanish."""
        self.upto(offset + 4096)
        try:
            first = zlib.decompressobj(31).decompress(self.data[offset - self.start : offset - self.start + 4096], len(_VERSION))
        except zlib.error:
            return None
        if first != _VERSION:
            return None
        unpacker, out, at = zlib.decompressobj(31), [], offset
        while not unpacker.eof:
            self.upto(at + CHUNK)
            chunk = self.data[at - self.start : at - self.start + CHUNK]
            if not chunk:
                raise ValueError(f"the record at byte {offset} is cut off")
            try:
                out.append(unpacker.decompress(chunk))
            except zlib.error as damage:
                raise ValueError(f"the record at byte {offset} is damaged") from damage
            at += len(chunk)
        return b"".join(out), at - len(unpacker.unused_data)


def scan_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose member starts in [start, end)."""
    data, at = _Bytes(file, size, start), start
    while (at := data.find(_MAGIC, at, end)) >= 0:
        found = data.member(at)
        if found:
            record, at = found
            yield record
        else:
            at += 1


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.lower()] = value.strip()
    return found


def _page(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] or None if value else None


def parse_record(record: bytes) -> tuple:
    """(page_id, url, type, payload_bytes, hex digest, refers_to, payload); ids as text."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = int(_fields(http)["content-length"])
    kind = warc["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {warc['warc-record-id']} does not match its digest")
    return (
        _page(warc["warc-record-id"]), warc["warc-target-uri"], kind, length, digest,
        _page(warc.get("warc-refers-to")), payload if kind == "response" else None,
    )


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named in ``manifest`` (``path``, ``bytes``): ``page_id``
    (string), ``url``, ``record_type``, ``payload_bytes``, ``payload_digest`` (hex), ``refers_to`` (string)
    and, unless left out, ``payload``. Payloads of responses are checked against their digests.
    Archives of any size spread over tasks; no archives give no rows."""
    n_splits = F.ceil(F.col("bytes") / split_bytes).cast("long")
    splits = manifest.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n_splits - 1)).alias("split")
    ).filter("bytes > 0")
    fields = [("page_id", "string"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "string"), ("payload", "binary")]
    fields = fields if payloads else fields[:-1]
    schema = T.StructType()
    for name, kind in fields:
        schema = schema.add(name, kind)
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with source.open_input_file(name) as file:
                    for record in scan_range(file, size, split * split_bytes, min(size, (split + 1) * split_bytes)):
                        rows.append(parse_record(record)[: len(fields)])
                        held += len(record)
                        if held >= 8 << 20 or len(rows) >= 2000:
                            yield _batch(rows, fields, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, fields, kinds)

    tasks = max(1, min(splits.count(), MAX_TASKS))
    return splits.repartition(tasks, "path", "split").mapInArrow(read, schema)


def _batch(rows: list[tuple], fields, kinds) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def archive_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
