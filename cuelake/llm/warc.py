"""Web archives: one gzip member per record, written by Spark tasks and read back record by record.

Writing: every task appends its rows to archives of its own in the shared folder and reports their paths, so a
task that runs again leaves files nobody lists. Of rows with one payload, that with the largest id is stored as
``response``; the others become ``revisit`` records, whose HTTP head still tells the payload's length and whose
WARC head tells its digest.

Reading: a stream is inflated in small steps, a record's block is framed by its Content-Length, the member has to
end with the record, and block and payload digests are recomputed on the way.

Defined cases: a null payload is empty; a null url gives a record without a target; control characters in a url are
percent-encoded. A null id sorts below all others and comes back null. Rows with the same id and payload that is
the largest of its group are all responses. Other columns are ignored. A payload may be as long as a row can be;
archives are listed in any order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import cut, new_folder, payload

STEP = 1 << 16
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "payload binary"
)


class BrokenArchive(ValueError):
    """The stream isn't a sequence of whole records with right digests."""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's digest


@dataclass
class Record:
    head: dict[str, str]
    http_head: dict[str, str]
    payload: bytes


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def member(page_id: int | None, url: str | None, data: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    block = http if revisit else http + data
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join(pack.compress(x) for x in ("\r\n".join(lines).encode(), block, b"\r\n\r\n")) + pack.flush()


class _Member:
    """The inflated bytes of one gzip member, pulled step by step."""

    def __init__(self, stream: BinaryIO, rest: bytes) -> None:
        self.stream, self.rest, self.inflate, self.held = stream, rest, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate a further step; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.stream.read(STEP)
        if not self.inflate.unconsumed_tail:
            self.rest = b""
        if not data:
            raise BrokenArchive("the archive ends within a member")
        self.held += self.inflate.decompress(data, STEP)
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                raise BrokenArchive("a record head without an end")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.held and not self.more():
                raise BrokenArchive("a record shorter than its Content-Length")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(stream: BinaryIO) -> Iterator[Record]:
    """The records of one archive in order; BrokenArchive at the first that doesn't hold together."""
    rest = stream.read(STEP)
    while rest:
        source = _Member(stream, rest)
        head = source.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise BrokenArchive("a member that doesn't begin with a record")
        fields = _fields(head)
        whole, body, http_head, data = hashlib.sha1(), hashlib.sha1(), bytearray(), bytearray()  # noqa: S324
        inside = False
        for part in source.take(int(fields["content-length"])):
            whole.update(part)
            if not inside:
                http_head += part
                at = http_head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                inside, part = True, bytes(http_head[at + 4 :])
                del http_head[at:]
            body.update(part)
            data += part
        if b"".join(source.take(4)) != b"\r\n\r\n":
            raise BrokenArchive("a record without its closing line ends")
        while source.more():
            pass
        if source.held:
            raise BrokenArchive("more than one record in a member")
        for name, seen in (("warc-block-digest", whole), ("warc-payload-digest", body)):
            told = fields.get(name, "").removeprefix("sha1:")
            if name == "warc-payload-digest" and fields["warc-type"] == "revisit":
                continue  # its payload is in the record that it refers to
            if told and told != base64.b32encode(seen.digest()).decode():
                raise BrokenArchive(f"{name} of {fields.get('warc-record-id')} doesn't match")
        yield Record(fields, _fields(bytes(http_head)), bytes(data))
        rest = source.rest or stream.read(STEP)


def _archives(rows: Iterable[tuple], folder: str, limit: int) -> Iterator[tuple[str, int, int]]:
    """Write the rows; (path, records, bytes) of each archive once it is closed."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    out, name, n, size, k = None, "", 0, 0, 0
    for row in rows:
        if out is None:
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
            out, n, size, k = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, k + 1
        data = member(*row)
        out.write(data)
        n, size = n + 1, size + len(data)
        if size >= limit:
            out.close()
            out = None
            yield f"{folder}/{name}", n, size
    if out is not None:
        out.close()
        yield f"{folder}/{name}", n, size


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes).

    Payloads of at least ``least_bytes`` that occur more than once are stored once.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # one row a repeated payload, kept so that the join may split a payload that many pages share
    first = cut(
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    )
    marked = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", "first_id",
        (F.col("copies").isNotNull() & (F.octet_length("payload") >= least_bytes)
         & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    told = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    yield r["page_id"], r["url"], r["payload"], told, r["first_id"], r["revisit"]

        for done in _archives(each(), folder, archive_bytes):
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), done, strict=True))])

    return cut(marked.mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path); payload is null for revisits or if not wanted.

    payload_bytes and payload_digest are those of the full payload also for revisits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    yield from _batches(records(stream), payloads)

    return manifest.select("path").mapInArrow(read, RECORDS)


def _batches(found: Iterator[Record], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])
    rows, size = [], 0
    for r in found:
        revisit = r.head["warc-type"] == "revisit"
        rows.append({
            "page_id": _id_of(r.head["warc-record-id"]), "url": r.head.get("warc-target-uri"),
            "record_type": r.head["warc-type"], "refers_to": _id_of(r.head["warc-refers-to"]) if revisit else None,
            "payload_digest": r.head["warc-payload-digest"].removeprefix("sha1:"),
            "payload_bytes": int(r.http_head["content-length"]) if revisit else len(r.payload),
            "payload": r.payload if payloads and not revisit else None,
        })
        size += len(r.payload)
        if len(rows) >= 4096 or size >= 1 << 23:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
