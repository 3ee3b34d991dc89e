"""WARC archives: a distributed writer and a sequential reader.

The writer turns page rows into ``response`` and ``revisit`` records, one gzip member each,
in one archive per task (more when an archive grows past a limit).  An archive is written
under a temporary name in the shared folder and renamed when complete, each attempt of a
task to a name of its own; the manifest, which Spark commits once a task, says which
attempt's archives count, so lost, repeated and speculative tasks do no harm.  The reader streams: 64 KiB of compressed bytes
at a time, members inflated incrementally, blocks framed by Content-Length, payload and
block digests verified as the bytes pass.

Equal payloads of at least ``min_bytes`` are recorded once: the record with the smallest
page_id is the response, the others are revisits that name it.  Defined cases: a null html
is an empty payload; a null url becomes ``urn:page:<page_id>``; rows that repeat the first
page_id are all responses; a url of any length is written and read back whole; a row without page_id can revisit but is never revisited; an
empty table gives no archive and no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, lookup, stored, utf8, workspace

MIN_BYTES = 100
CHUNK = 1 << 16
#: Longest header block that is read: three bytes for each of the 2^31 bytes that a url may have at most, and the other fields.
HEADER_BYTES = 3 * (1 << 31) + CHUNK
#: Longest HTTP head of a block.
HTTP_HEAD_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
MANIFEST_FILES = 4
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format or fails a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None
    http: dict[str, str] = field(default_factory=dict)


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, uncompressed: a revisit's block is the HTTP head alone, with the full payload's length and digest."""
    head = _http_head(len(payload))
    block = head if revisit else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Members:
    """The bytes of each gzip member of a stream, inflated piece by piece."""

    def __init__(self, stream):
        self.stream, self.pending, self.z = stream, b"", None
        self.buffer = b""

    def next_member(self) -> bool:
        """Starts the next member; False at the end of the archive."""
        if not self.pending:
            self.pending = self.stream.read(CHUNK)
        if not self.pending:
            return False
        self.z, self.buffer = zlib.decompressobj(31), b""
        return True

    def piece(self) -> bytes:
        """Some more inflated bytes; empty at the member's end."""
        if self.buffer:
            out, self.buffer = self.buffer, b""
            return out
        while not self.z.eof:
            if not self.pending:
                self.pending = self.stream.read(CHUNK)
                if not self.pending:
                    raise WarcError("the archive ends inside a member")
            try:
                out = self.z.decompress(self.pending, CHUNK)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.pending = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int = HEADER_BYTES) -> bytes:
        """Bytes up to and with ``mark``; what follows stays buffered."""
        held, seen = bytearray(), 0
        while (at := held.find(mark, max(seen - len(mark) + 1, 0))) < 0:
            seen = len(held)
            if seen > most:
                raise WarcError("a header is too long")
            more = self.piece()
            if not more:
                raise WarcError("the record ends inside a header")
            held += more
        at += len(mark)
        self.buffer = bytes(held[at:]) + self.buffer
        return bytes(held[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            more = self.piece()
            if not more:
                raise WarcError("the record is shorter than its Content-Length")
            if len(more) > n:
                more, self.buffer = more[:n], more[n:]
            n -= len(more)
            yield more


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines[1:]) if found}


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order, each verified; WarcError where one is broken."""
    members = _Members(stream)
    while members.next_member():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("a member does not start with a WARC version")
        headers = _fields(head)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record has no Content-Length")
        block, payload, kept = hashlib.sha256(), hashlib.sha256(), []
        length, size, http_head, inside = int(headers["content-length"]), 0, bytearray(), False
        for piece in members.exactly(length):
            block.update(piece)
            if not inside:
                at = max(len(http_head) - 3, 0)
                http_head += piece
                at = http_head.find(b"\r\n\r\n", at)
                if at < 0:
                    if len(http_head) > HTTP_HEAD_BYTES:
                        raise WarcError("a block's HTTP head is too long")
                    continue
                piece, http_head, inside = bytes(http_head[at + 4 :]), http_head[: at + 4], True
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        rest = b""
        while more := members.piece():
            rest += more
        if rest != b"\r\n\r\n":
            raise WarcError("a record does not end after its block")
        http = _fields(bytes(http_head))
        if headers.get("warc-block-digest", "") not in ("", f"sha256:{block.hexdigest()}"):
            raise WarcError("a block does not have its digest")
        named = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if headers.get("warc-type") == "revisit":
            yield Record(headers, int(http.get("content-length", 0)), named, None, http)
            continue
        if named not in ("", payload.hexdigest()):
            raise WarcError("a payload does not have its digest")
        yield Record(headers, size, payload.hexdigest(), b"".join(kept) if keep_payload else None, http)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/+", r"\1:///", uri))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the page that this one revisits, else null.

    The smallest page_id of each payload comes from a partial aggregation over digests; it
    is broadcast for payloads of very many pages, so no payload's pages meet in one task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))))
    firsts = (
        rows.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
    )
    firsts = stored(firsts, workspace(pages.sparkSession, "payloads"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    joined = lookup(rows, firsts, ["digest"], total, F.xxhash64("page_id", "url"))
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(plan: DataFrame, folder: str, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the planned records under ``folder``; returns (archive, records, bytes) of each archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        done, out, number = [], None, 0

        def close():
            nonlocal out, number
            out[0].close()
            final = f"{root}/part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
            files.move(out[1], final)
            done.append((f"{folder}/{final.rpartition('/')[2]}", out[2], out[3]))
            out, number = None, number + 1

        for batch in batches:
            for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if out is None:
                    name = f"{root}/.part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.tmp"
                    out = [files.open_output_stream(name, compression=None), name, 0, 0]
                member = gzip_member(format_record(page, url, html, first, first is not None), level)
                out[0].write(member)
                out[2] += 1
                out[3] += len(member)
                if out[3] >= archive_bytes:
                    close()
        if out:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["archive", "records", "bytes"])

    # one short row for each archive: a few files hold them all
    return stored(in_small_batches(plan, run, "archive string, records long, bytes long", 256).repartition(MANIFEST_FILES), f"{folder}/manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record in the listed archives."""

    def page(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _open(archive)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        h = r.headers
                        rows.append((page(h.get("warc-record-id")), h.get("warc-target-uri"), r.payload_bytes, r.payload_digest, h.get("warc-type"), page(h.get("warc-refers-to")), r.payload))
                        held += len(r.payload or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    tasks = max(1, min(manifest.count(), 100_000))
    return in_small_batches(manifest.select("archive").repartition(tasks, "archive"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def unfounded_revisits(records: DataFrame) -> DataFrame:
    """The revisits among read records whose named page is no response with the same payload digest and length."""
    said = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.filter("record_type = 'revisit'").join(said, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes every page's record to archives in the shared folder, then reads all archives back."""
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(planned(pages, **columns), folder))
