"""WARC archives: a writer that revisits equal payloads, and a splittable reader.

The writer makes gzip members, one for each record, in files of the shared folder. A task writes a file under a name of its
own and reports it; only reported files belong to the archive, so a task that runs twice leaves no record twice.

The reader cuts files into byte ranges. A task looks for the gzip magic in its range, takes a place for a member's start
only if its first bytes inflate to a WARC header, reads each record that starts inside its range to its end, also beyond
the range, and no other. It holds one block of the file and one record's inflated block at a time in small pieces.

Defined cases: a null payload is empty. Of records with equal payloads the one with the largest page_id is the response
and all others revisit it; rows that share the largest page_id are all responses. A null page_id sorts first; its record
names no page. A null url is left out of its record and read back as null. Payloads under ``least`` bytes are never
revisited. A very long page is one record; writing it takes its size in memory, reading it a block at a time. Other columns
are not read. A member whose header is sound and whose rest is not (cut off, damaged, a length that is no number) gives a
row of the type ``damaged`` without counts, and the search goes on one byte after its start. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.stage import materialize, new_path

#: Bytes of a file that one task reads; bytes read and inflated at once.
SPLIT, BLOCK, PIECE = 16 << 20, 1 << 20, 1 << 14
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A time for all records, so that reruns give equal files.
DATE = "2024-01-01T00:00:00Z"


def open_folder(path: str):
    """(file system, path) of a folder's address, for any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of the full response, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    body = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode()) + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the response that a page's record revisits, or null.

    Payloads are equal if length and SHA-256 are. Only groups of two rows or more are joined to, in a join of two shuffles,
    so that Spark splits a group of any size over as many tasks as it needs.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    known = p.select("page_id", "sha", F.octet_length("html").alias("n")).filter(F.col("n") >= least)
    groups = known.groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 AND first IS NOT NULL")
    groups = materialize(groups.select("sha", "first"), "payload-groups")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return p.join(groups, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as WARC files; gives file and size of each, read from a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        name, out, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i) for i in range(4)], strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                member = record(page_id.as_py(), url.as_py(), payload, digest32(payload), refers_to.as_py())
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                size += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["file", "size"])

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, size long"), "warc-files")


class Window:
    """A file read in blocks, of which the last one is kept, so that near places cost no second read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.block = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place; fewer at the end of a block or of the file."""
        if not self.start <= at < self.start + len(self.block):
            self.file.seek(at)
            self.start, self.block = at, self.file.read(min(BLOCK, self.size - at))
        return self.block[at - self.start : at - self.start + n]


class _Member:
    """Inflates one gzip member that starts at a place of a file, piece by piece."""

    def __init__(self, window: Window, start: int):
        self.window, self.at = window, start
        self.inflate = zlib.decompressobj(31)
        self.ready, self.pending = b"", b""

    def more(self) -> bool:
        """Adds inflated bytes to ready; false at the member's end."""
        if self.inflate.eof:
            return False
        data = self.pending
        if not data:
            if self.at >= self.window.size:
                raise zlib.error("the file ends inside a member")
            data = self.window.read(self.at, PIECE)
            self.at += len(data)
        self.ready += self.inflate.decompress(data, 4 * PIECE)
        self.pending = self.inflate.unconsumed_tail
        return True

    @property
    def end(self) -> int:
        return self.at - len(self.inflate.unused_data)

    def head(self) -> dict[str, str] | None:
        """The fields of the header up to the empty line, however long, or None if this is no record."""
        seen = 0
        while (end := self.ready.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.ready)
            if not b"WARC/1.".startswith(self.ready[:7]) and not self.ready.startswith(b"WARC/1.") or not self.more():
                return None
        head, self.ready = self.ready[:end], self.ready[end + 4 :]
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            return None
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n inflated bytes."""
        while n:
            if not self.ready and not self.more():
                raise zlib.error("the member ends inside a block")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            if part:
                yield part

    def finish(self) -> None:
        self.ready = b""
        while self.more():
            self.ready = b""


def read_range(file, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], "_Member"]]:
    """The records that start in [start, end): header fields and the member, placed at the block."""
    window, at = Window(file, size), start
    while at < min(end, size):
        seen = window.read(at, BLOCK)
        place = seen.find(MAGIC)
        if place < 0:
            # The magic may lie across the end of what was seen; one byte on is enough where nothing more is kept.
            at += max(1, len(seen) - len(MAGIC) + 1)
            if len(seen) < len(MAGIC):
                window.block = b""
            continue
        at += place
        if at >= end:
            return
        member = _Member(window, at)
        try:
            head = member.head()
        except zlib.error:
            head = None
        if head is None:
            at += 1
            continue
        yield head, member
        try:
            member.finish()
            at = member.end
        except zlib.error:
            at += 1


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_archive(spark, files: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """files: file and size. One row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest
    (computed from the payload of a response, declared by a revisit) and, if asked, the payload."""
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.lit(split)))
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).select("file", "size", (F.col("i") * split).alias("start"))
    # Each range to its own place: a range is a task's work, the row that names it is a few bytes.
    n = max(1, int(ranges.count()))
    ranges = ranges.repartition(min(n, 100_000), "file", "start")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                folder, _, name = row["file"].rpartition("/")
                store, root = open_folder(folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    rows: list = []
                    for head, member in read_range(f, row["start"], row["start"] + split, row["size"]):
                        try:
                            rows.append(_record_row(head, member, payloads))
                        except (zlib.error, ValueError):
                            rows.append((_number(head.get("warc-record-id")), head.get("warc-target-uri"), "damaged", None, None, None, None))
                        if len(rows) >= (64 if payloads else 4096):
                            yield _batch(rows, payloads)
                            rows = []
                    if rows:
                        yield _batch(rows, payloads)

    return ranges.mapInArrow(run, schema)


def _record_row(head: dict[str, str], member: _Member, payloads: bool) -> tuple:
    n, kind = int(head.get("content-length", "0")), head.get("warc-type", "")
    http, sha, size, kept, seen = b"", hashlib.sha1(), 0, [], False
    if n < 0:
        raise ValueError("a negative length")
    for part in member.pieces(n):
        if not seen:
            http += part
            if b"\r\n\r\n" not in http:
                continue
            http, part = http.split(b"\r\n\r\n", 1)
            seen = True
        sha.update(part)
        size += len(part)
        if payloads:
            kept.append(part)
    digest = base64.b32encode(sha.digest()).decode()
    if kind == "revisit":
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields.get("content-length", "0"))
    return (_number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, _number(head.get("warc-refers-to")), size, digest, *([b"".join(kept)] if payloads else []))


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    n = 7 if payloads else 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names=names[:n])


def op4(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archive(with_originals(pages), new_path(spark, "warc"))
    return read_archive(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 writes five bits a letter, so five hexadecimal digits of SHA-1 are four letters.
SQL4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hex FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
