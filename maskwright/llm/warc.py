"""WARC archives: written with a gzip member per record, read back by byte ranges.

A task of the reader looks for gzip magic in its range, takes a candidate as a member only if it
decodes to a WARC header, and owns the records that start inside the range; the last of them may end
beyond it. So a large archive is read by many tasks, without an index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
#: Most tasks of one read; beyond it a task has several ranges.
TASKS = 20_000
_CHUNK = 1 << 16
_ID = "urn:page:"

MANIFEST = "path string, bytes bigint, records bigint"
RECORD = (
    "path string, at bigint, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def plan(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): which record each page becomes.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is a response,
    others refer to it; rows that repeat the smallest id are responses too. A null id is larger than
    any other; payloads of null ids only are all responses. A null payload is empty.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    first = (
        rows.where(f"octet_length(html) >= {REVISIT_BYTES}")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.expr("CASE WHEN page_id > first OR page_id IS NULL THEN first END AS refers_to")
    )


def _member(page_id, url: str | None, html: str, digest: str, refers_to) -> bytes:
    payload = html.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <{_ID}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    record = "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def write(planned: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``plan`` below ``folder`` and return the manifest (path, bytes, records).

    The names hold the attempt of the task, and only files in the manifest count, so a task that is
    run again leaves no record twice. The manifest is itself written below ``folder``. An empty
    table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, path, size, records, k = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            row = [pa.array([f"{folder}/{path}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())]
            return pa.RecordBatch.from_arrays(row, names=["path", "bytes", "records"])

        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, records = f"{name}-{k}.warc.gz", 0, 0
                    out, k = store.open_output_stream(f"{root}/{path}", compression=None), k + 1
                data = _member(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"])
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    manifest = f"{folder}/manifest"
    planned.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, MANIFEST).write.parquet(manifest)
    return planned.sparkSession.read.schema(MANIFEST).parquet(manifest)


class _Range:
    """Bytes of an open file from an offset on, fetched in chunks as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, bytearray()
        file.seek(at)

    def upto(self, end: int) -> bool:
        """Whether the byte before ``end`` exists; fetches what is missing."""
        while self.base + len(self.data) < end:
            more = self.file.read(max(_CHUNK, end - self.base - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def drop(self, at: int) -> None:
        if at - self.base > 4 * _CHUNK:
            del self.data[: at - self.base]
            self.base = at


def _inflate(source: _Range, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """The decoded member at an offset and where it ends; with ``limit`` at least so many bytes of it, if
    it has them. None if there is no whole member."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    got = 0
    try:
        while not unpack.eof:
            if not source.upto(pos + 1):
                return None
            part = bytes(source.data[pos - source.base : pos - source.base + _CHUNK])
            pos += len(part)
            out.append(unpack.decompress(part))
            got += len(out[-1])
            if limit is not None and got >= limit:
                return b"".join(out), pos
    except zlib.error:
        return None
    return b"".join(out), pos - len(unpack.unused_data)


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def _records(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records whose member starts in [start, end)."""
    source, at = _Range(file, start), start
    while at < end:
        source.drop(at)
        source.upto(end + len(MAGIC) - 1)
        k = source.data.find(MAGIC, at - source.base, end - source.base + len(MAGIC) - 1)
        if k < 0:
            return
        at = source.base + k
        probe = _inflate(source, at, 1 << 14)
        if probe is None or _headers(probe[0]) is None:
            at += 1
            continue
        whole = _inflate(source, at)
        head = _headers(whole[0]) if whole else None
        if head is None or len(whole[0]) < head[1] + int(head[0]["content-length"]):
            at += 1
            continue
        yield at, head[0], whole[0][head[1] : head[1] + int(head[0]["content-length"])]
        at = whole[1]


def _named(value: str | None) -> str | None:
    return value.strip("<>").removeprefix(_ID) if value else None


def read(spark: SparkSession, manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, bytes), see ``RECORD``; ids without their prefix.

    For a revisit, payload is null, and digest and length are those of the full payload, from its
    header. Without ``payloads`` they are digested in the task and not returned. Bytes that form no
    record are skipped. A member inside the payload of another is a record of its own only to a task
    whose range starts between the two.
    """
    ranges = manifest.where("bytes > 0").select(
        "path", F.expr(f"explode(sequence(0L, bytes - 1, {split_bytes}L)) AS start"), "bytes"
    )
    ranges = ranges.select("path", "start", F.expr(f"least(start + {split_bytes}, bytes) AS end"))
    # the rows are few and small but stand for much data: a given number of tasks is not merged
    ranges = ranges.repartition(min(TASKS, max(1, ranges.count())), "path", "start")
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.int64() if n in ("at", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names]
        )
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for at, fields, block in _records(file, row["start"], row["end"]):
                        http = block.find(b"\r\n\r\n") + 4 if "http" in fields.get("content-type", "") else 0
                        kind = fields.get("warc-type")
                        digest, payload, length = fields.get("warc-payload-digest", "").removeprefix("sha256:"), None, None
                        if kind == "revisit":
                            for line in block[:http].lower().split(b"\r\n"):
                                if line.startswith(b"content-length:"):
                                    length = int(line.partition(b":")[2])
                        else:
                            payload = block[http:]
                            digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                        held.append(
                            {
                                "path": row["path"],
                                "at": at,
                                "record_id": _named(fields.get("warc-record-id")),
                                "record_type": kind,
                                "target_uri": fields.get("warc-target-uri"),
                                "refers_to": _named(fields.get("warc-refers-to")),
                                "payload_digest": digest or None,
                                "payload_bytes": length,
                                "payload": payload if payloads else None,
                            }
                        )
                        size += len(block)
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.mapInArrow(run, RECORD)
