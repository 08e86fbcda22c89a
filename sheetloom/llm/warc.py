"""WARC archives as a chunked record table.

An archive's bytes lie in rows (record, chunk, last, bytes, digest): a record's chunks, joined in order, are
one WARC/1.1 record, and the records of a table one after another are a WARC file. ``digest`` is the SHA-1 of the
record's bytes up to the chunk's end. Writer and reader pass payloads on chunk by chunk with
running digests, so neither copies a whole record. Payloads that equal another's become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

CHUNK_BYTES = 1 << 20
SCHEMA = "record long, chunk long, last boolean, bytes binary, digest binary"
RECORDS = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, intact boolean"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sheetloom:warc")
_PIECE = 1 << 14
_END = b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_IDS, str(page_id))}"


def _line(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def head(page_id: int | None, url: str | None, refers_to: int | None, n: int, digest: str, date: str) -> tuple[bytes, bytes]:
    """WARC header, and the HTTP header that begins the record's block."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return "\r\n".join(lines).encode() + _END, http


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """sha1, n_bytes and the smallest page_id of each payload of at least ``min_bytes`` that more rows than one have."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    counted = sums.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1 AND first_id IS NOT NULL").select("sha1", "n_bytes", "first_id")


def write_records(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record per row of ``pages`` (columns page_id, url and html are used, others ignored) in the table at ``path``.

    The payload is the html's UTF-8; null counts as empty. Of rows with equal payloads of at least
    ``min_bytes`` bytes, those with the smallest page_id are responses, the others revisit it. A null page_id
    is never the smallest; rows that repeat a page_id share its record id. A null url leaves its header out.
    No rows give a table without rows.
    """
    first = materialize(first_copies(pages, min_bytes), "first-copies")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    lean = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    told = lean.join(first, ["sha1", "n_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        record = (task.partitionId() if task else 0) << 32
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            ids, urls, payloads, sums, refer = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                refers_to, whole = refer[i].as_py(), memoryview(payloads[i].as_buffer())
                digest = base64.b32encode(bytes.fromhex(sums[i].as_py())).decode()
                warc, http = head(ids[i].as_py(), urls[i].as_py(), refers_to, len(whole), digest, date)
                body = whole if refers_to is None else whole[:0]
                cuts = range(0, max(len(body), 1), chunk_bytes)
                running = hashlib.sha1()
                for k, at in enumerate(cuts):
                    part = [body[at : at + chunk_bytes]]
                    if k == 0:
                        part = [warc, http, *part]
                    last = k == len(cuts) - 1
                    if last:
                        part.append(_END)
                    data = b"".join(part)
                    running.update(data)
                    rows.append((record, k, last, data, running.digest()))
                    size += len(data)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                record += 1
        if rows:
            yield _batch(rows)

    chunks = told.select("page_id", "url", "payload", "sha1", refers.alias("refers_to")).mapInArrow(run, SCHEMA)
    chunks.write.option("compression", "zstd").parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record", "chunk", "last", "bytes", "digest"])


class Reader:
    """Takes a record's bytes piece by piece and keeps its headers, a count and a running digest."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.warc: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.left = 0
        self.n = 0
        self.sha1 = hashlib.sha1()
        self.after = b""

    def _headers(self, data: memoryview) -> tuple[dict[str, str] | None, memoryview]:
        """The headers once their end has come, and what follows it. Only a header is held, of whatever length."""
        for at in range(0, len(data), _PIECE):
            before = len(self.held)
            self.held += data[at : at + _PIECE]
            end = self.held.find(_END, max(0, before - 3))
            if end >= 0:
                lines = self.held[:end].decode().split("\r\n")
                self.held = bytearray()
                found = {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                return found, data[at + end + 4 - before :]
        return None, data[:0]

    def feed(self, data: bytes) -> None:
        rest = memoryview(data)
        if self.warc is None:
            self.warc, rest = self._headers(rest)
            if self.warc is None:
                return
            if not self.warc[""].startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {self.warc['']!r}")
            self.left = int(self.warc["content-length"])
        if self.http is None and self.left:
            size = len(rest)
            self.http, rest = self._headers(rest)
            self.left -= size - len(rest) if self.http is not None else size
            if self.http is None:
                return
        body = rest[: self.left]
        self.sha1.update(body)
        self.n += len(body)
        self.left -= len(body)
        self.after += bytes(rest[len(body) : len(body) + 5])

    def row(self, sound: bool) -> tuple:
        """The record's row of RECORDS; ``sound``: the chunks' own digests agreed."""
        w = self.warc or {}
        revisit = w.get("warc-type") == "revisit"
        said = w.get("warc-payload-digest", "").removeprefix("sha1:")
        found = base64.b32encode(self.sha1.digest()).decode()
        whole = sound and not self.left and self.after == _END and (revisit or found == said)
        number = lambda k: int(w[k]) if k in w else None
        n = int((self.http or {}).get("content-length", 0)) if revisit else self.n
        return (w.get("warc-record-id", "")[1:-1], w.get("warc-type"), w.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), n, said if revisit else found, whole)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the table, from its bytes: record_id, record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest and intact.

    Sizes and digests of responses are computed from what is read, those of revisits come from their headers. ``intact``
    is false where a digest differs or bytes are missing. Records of one chunk are read where they
    lie; only longer ones are brought together, a row of at most a chunk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        here, reader, running, following, sound, done = None, None, None, 0, True, True

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            records, chunks, lasts = (batch.column(i).to_pylist() for i in range(3))
            for record, chunk, last, data, digest in zip(records, chunks, lasts, batch.column(3), batch.column(4), strict=True):
                if record != here:
                    if not done:
                        rows.append(reader.row(False))
                    here, reader, running, following, sound = record, Reader(), hashlib.sha1(), 0, True
                part = data.as_buffer()
                running.update(part)
                sound &= chunk == following and running.digest() == digest.as_py()
                following += 1
                reader.feed(part)
                done = last
                if last:
                    rows.append(reader.row(sound))
            if rows:
                yield out(rows)
        if not done:
            yield out([reader.row(False)])

    table = spark.read.schema(SCHEMA).parquet(path)
    alone = F.col("last") & (F.col("chunk") == 0)
    long = table.where(~alone).repartition("record").sortWithinPartitions("record", "chunk")
    return table.where(alone).mapInArrow(run, RECORDS).unionByName(long.mapInArrow(run, RECORDS))
