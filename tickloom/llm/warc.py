"""WARC archives: a de-duplicating writer and a splittable reader.

Every record is a gzip member of its own.  The reader gives tasks byte ranges; a task scans its range for the gzip magic, takes a
candidate for a record if its header decodes as WARC, and owns the records that start inside its range, however far they go on.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
EMPTY_DIGEST_PREFIX = "sha1:"
READ_BYTES = 1 << 20


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A gzip member with one response or revisit record.  A revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    one_line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", one_line), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _header(raw: bytes) -> tuple[dict, int, bytes] | None:
    """Header fields (names in lower case) of what begins a record, the length of its block, and what follows the header."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower().decode(errors="replace"): v.strip().decode(errors="replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = fields.get("content-length", "")
    return (fields, int(length), rest) if length.isdigit() else None


def parse_record(raw: bytes) -> dict | None:
    """Header fields and block of a decoded member; None if it is no WARC record."""
    found = _header(raw)
    if found is None or len(found[2]) < found[1]:
        return None
    return found[0] | {"block": found[2][: found[1]]}


class LongRecord:
    """A record whose payload no cell could hold: its header, and its payload's digest and length, made while it is inflated."""

    def __init__(self, begun: bytes) -> None:
        """begun: the record's first bytes, its headers among them."""
        fields, length, rest = _header(begun) or ({}, 0, b"")
        body, self.stated = http_payload(rest[:length])
        self.fields, self.left, self.sha, self.length = fields, length - len(rest[:length]), hashlib.sha1(body), len(body)

    def add(self, part: bytes) -> None:
        part = part[: self.left]
        self.left -= len(part)
        self.length += len(part)
        self.sha.update(part)

    def record(self) -> dict | None:
        return self.fields if self.fields and not self.left else None

    def digest(self) -> str:
        return base64.b32encode(self.sha.digest()).decode()


def http_payload(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP response block and the length its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), len(body))
    return body, stated


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC files in a new folder of shared storage; gives the manifest (path, n_bytes, records).

    Of records with equal payloads of at least min_bytes, that with the smallest id is a response and the others revisit it;
    rows that repeat that id and payload are responses too.  Null payloads are empty.  A null id is the largest of ids, so
    such a row is a response only if no other has its payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("digest").alias("f_digest")).agg(F.min("id").alias("first"))
    # equal payloads may be many: an equi-join that Spark splits where one digest holds much of the table
    ready = rows.join(first, F.col("digest") == F.col("f_digest"), "left").select("id", "url", "payload", "first")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, n = f"{base}/part-{part:06d}.warc.gz", 0
        draft = f"{base}/.draft-{part:06d}-{uuid.uuid4().hex}"  # a repeated attempt replaces the file as a whole
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for i, url, text, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = text.encode()
                    revisit = first_id is not None and i != first_id
                    key = "" if i is None else str(i)
                    out.write(record_bytes("revisit" if revisit else "response", key, url, payload, payload_digest(payload), str(first_id) if revisit else None))
                    n += 1
            size = out.tell()
        fs.move(draft, name) if n else fs.delete_file(draft)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["path", "n_bytes", "records"])

    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return cut(ready.sortWithinPartitions("id", "url").mapInArrow(each, "path string, n_bytes long, records long"))


class _Archive:
    """An open file of size bytes, of which members are decoded."""

    def __init__(self, file: pa.NativeFile, size: int, most: int) -> None:
        self.file, self.size, self.most = file, size, most

    def member(self, at: int, whole: bool = True) -> tuple[bytes | LongRecord, int] | None:
        """The member that begins at a place, and the place after it; None if what stands there is no gzip member with a WARC header.
        If not whole, its first bytes do.  A member that inflates to more than `most` bytes is a LongRecord."""
        z, parts, head, held, place, checked = zlib.decompressobj(31), [], b"", 0, at, False
        long: LongRecord | None = None
        try:
            while not z.eof:
                raw = self.file.read_at(min(READ_BYTES if checked else 1 << 14, self.size - place), place)
                if not raw:
                    return None
                place += len(raw)
                while raw and not z.eof:
                    part = z.decompress(raw, READ_BYTES)
                    raw, held = z.unconsumed_tail, held + len(part)
                    if long is not None:
                        long.add(part)
                    else:
                        parts.append(part)
                        if held > self.most:
                            long, parts = LongRecord(b"".join(parts)), []
                    head += part[: max(0, 5 - len(head))]
                    if not checked and held >= 5:
                        checked = True
                        if head != b"WARC/":
                            return None
                        if not whole:
                            return b"", place
        except zlib.error:
            return None
        return (long or b"".join(parts), place - len(z.unused_data)) if checked else None

    def candidates(self, start: int, end: int) -> Iterator[int]:
        """Places of the gzip magic in [start, end)."""
        at = start
        while at < end:
            window = self.file.read_at(min(READ_BYTES + len(MAGIC) - 1, self.size - at), at)
            k = window.find(MAGIC)
            if k < 0:
                at += READ_BYTES
            elif at + k >= end:
                return
            else:
                yield at + k
                at += k + 1

    def walk(self, start: int, end: int) -> Iterator[tuple[int, bytes | LongRecord]]:
        """Members one after the other from a place where one begins or where there is none around; what does not decode is passed over."""
        at = start
        while at < end:
            begin = next((x for x in self.candidates(at, end)), None)
            if begin is None:
                return
            found = self.member(begin)
            if found is not None:
                yield begin, found[0]
            at = begin + 1 if found is None else found[1]

    def synchronised(self, start: int, end: int) -> int:
        """Where the first member that starts in [start, end) begins (end if none does).  The bytes of a member may hold a whole archive
        member, so a candidate counts if the next member, or the file's end, follows it; if something else does, the file is walked
        from its start, which settles it."""
        for at in self.candidates(start, end):
            if (found := self.member(at)) is None:
                continue
            if found[1] == self.size or self.member(found[1], whole=False) is not None:
                return at
            return next((x for x, _ in self.walk(0, end) if x >= start), end)
        return end


def _members(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int, size: int, most: int) -> Iterator[bytes | LongRecord]:
    """Decoded members of a file that start in [start, end) and whose header is WARC."""
    with fs.open_input_file(path) as f:
        archive = _Archive(f, size, most)
        for _, raw in archive.walk(archive.synchronised(start, end) if start else 0, end):
            if raw:
                yield raw


RECORD = "warc_type string, record_id string, url string, refers_to string, payload_digest string, payload_length long, payload binary, payload_kept boolean"


def read_archives(manifest: DataFrame, folder: str, *, split_bytes: int = 8 << 20, max_cell_bytes: int = 1 << 30) -> DataFrame:
    """The response and revisit records of the files in a manifest (path, n_bytes), in ranges of split_bytes, or of a 50,000th of all
    bytes if that is more, so that the tasks of a stage stay countable.  Each range is a task of its own.

    payload is null for revisits; payload_digest is computed from a response's payload and read from a revisit's header, as is
    payload_length.  Members that do not decode or are of other types are passed over.  Of a record that inflates to more than
    max_cell_bytes, which a cell of a table could not hold, digest and length are made while it is inflated; its payload is null and
    payload_kept false.  An empty manifest gives no rows.
    """
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    split_bytes = max(split_bytes, -(-total // 50_000))
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
        names = [x.split()[0] for x in RECORD.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for raw in _members(fs, path, start, min(start + split_bytes, size), size, max_cell_bytes):
                    long = isinstance(raw, LongRecord)
                    r = raw.record() if long else parse_record(raw)
                    if r is None or r.get("warc-type") not in ("response", "revisit"):
                        continue
                    body, stated = (None, raw.stated) if long else http_payload(r["block"])
                    revisit = r["warc-type"] == "revisit"
                    made = (raw.digest(), raw.length) if long else (payload_digest(body), len(body))
                    digest, length = (r.get("warc-payload-digest", "").removeprefix(EMPTY_DIGEST_PREFIX), stated) if revisit else made
                    rows.append((r["warc-type"], r.get("warc-record-id"), r.get("warc-target-uri"), r.get("warc-refers-to"), digest, length, None if revisit else body, revisit or not long))
                    held += 0 if long else len(raw)
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    # a number of partitions, as Spark would else put all these small rows, and so all reading, into one task
    tasks = max(1, -(-total // split_bytes))
    return ranges.select("path", "n_bytes", "start").repartition(tasks, "path", "start").mapInArrow(each, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in shared storage."""
    return os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
