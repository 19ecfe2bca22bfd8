"""WARC archives: a writer and a splittable reader (operator 10).

Archives are files of gzip members, one WARC record each. The reader's tasks get byte ranges of files.
A task looks for the gzip magic in its range, takes a place for a member only if what it inflates to begins with a WARC
header, and owns the records that start inside the range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.llm._shared import new_path, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_CHUNK, _BLOCK = 1 << 16, 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: A header beyond this is an error, never passed over.
_HEAD_LIMIT = 256 << 20
#: record_type of what began as a record and cannot be read whole.
DAMAGED = "damaged"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes an archive for each task's rows into ``folder``; returns the list (path, bytes, records).

    Of rows with equal payloads (UTF-8 of ``html``, null: empty) of ``least_bytes`` or more, that with the largest key
    is the response and the others revisit it; equal rows with that key, rows without a key and smaller payloads are responses.
    Which is which is known from digests alone; texts are shuffled once, to meet that answer. Only files
    of tasks that ended well are listed.
    """
    p = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    slim = p.filter(F.octet_length("html") >= least_bytes).select("page", "digest")
    again = slim.groupBy("digest").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    revisits = slim.join(again, "digest").filter("page <> response").select("page", "digest", F.col("response").alias("refers")).distinct()
    # By page as well: many pages of one payload are dealt to many tasks.
    p = p.join(revisits, ["page", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at, size, n = TaskContext.get(), None, "", 0, 0
        for b in batches:
            for page, link, text, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    at = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    where, path = _open(at)
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(path, compression=None)
                data = record("" if page is None else str(page), link, text.encode("utf-8", "surrogatepass"), None if refers is None else str(refers))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return written(p.select("page", "url", "html", "refers").mapInArrow(run, "path string, bytes long, records long"), "archives")


class _Blocks:
    """A file read in blocks of a megabyte, the last one kept: small reads side by side cost one request."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``; none only at the end of the file."""
        if not self.at <= at < self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(min(_BLOCK, max(self.size - at, 0)), at)
        return self.block[at - self.at : at - self.at + n]


class _Member:
    """Inflates the gzip member at ``at`` of a file, piece by piece; ``end`` is where the next one starts."""

    def __init__(self, file: _Blocks, at: int) -> None:
        self.file, self.at, self.end = file, at, -1

    def __iter__(self) -> Iterator[bytes]:
        inflate, at = zlib.decompressobj(31), self.at
        while not inflate.eof:
            data = self.file.read(at, _CHUNK)
            if not data:
                raise zlib.error("the file ends inside a member")
            at += len(data)
            while data and not inflate.eof:
                yield inflate.decompress(data, 1 << 20)
                data = inflate.unconsumed_tail
        self.end = at - len(inflate.unused_data)


def _read(member: _Member, with_payload: bool) -> tuple | None:
    """(page, type, refers, payload bytes, digest, payload) of a member that is a WARC record, else None."""
    chunks, ours = iter(member), False
    try:
        head, stop = bytearray(), -1
        while stop < 0:
            seen = len(head)
            head += next(chunks)
            if len(head) >= 5 and not head.startswith(b"WARC/"):
                return None
            ours = len(head) >= 5
            stop = head.find(b"\r\n\r\n", max(seen - 3, 0))
            if (len(head) if stop < 0 else stop) > _HEAD_LIMIT:
                raise RuntimeError(f"the header of the WARC record at byte {member.at} is over {_HEAD_LIMIT} bytes")
        lines, rest = bytes(head[:stop]), bytes(head[stop + 4 :])
        fields = dict(x.split(": ", 1) for x in lines.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        left = int(fields["Content-Length"])
        while b"\r\n\r\n" not in rest[:left] and len(rest) < left:
            rest += next(chunks)
        http, _, rest = rest.partition(b"\r\n\r\n")
        left -= len(http) + 4
        sha, size, kept, kind = hashlib.sha1(), 0, [], fields.get("WARC-Type", "")
        while True:
            part = rest[: left - size]
            sha.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
            rest = next(chunks, None)
            if rest is None:
                break
        if kind != "revisit" and size < left:
            raise ValueError("the payload is cut short")
    except (zlib.error, StopIteration, KeyError, ValueError):
        return (None, DAMAGED, None, None, None, None) if ours else None
    page = re.search(r"<urn:page:(-?\d*)>", fields.get("WARC-Record-ID", ""))
    refers = re.search(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    digest, named = base64.b32encode(sha.digest()).decode(), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "revisit":
        digest = named
        length = re.search(rb"(?i)content-length: *(\d+)", http)
        size = int(length[1]) if length else 0
    elif named and named != digest:
        kind = DAMAGED
    return int(page[1]) if page and page[1] else None, kind, int(refers[1]) if refers else None, size, digest, b"".join(kept) if with_payload else None


def scan(uri: str, start: int, end: int, with_payload: bool = False) -> Iterator[tuple]:
    """Records that start in bytes [start, end) of an archive."""
    where, path = _open(uri)
    with where.open_input_file(path) as raw:
        file, at = _Blocks(raw), start
        while at < end:
            window = file.read(at, _CHUNK)
            if len(window) < len(MAGIC):  # the end of a block; the magic may lie across it
                window = raw.read_at(min(_CHUNK, max(file.size - at, 0)), at)
            hit = window.find(MAGIC)
            if hit < 0:
                at += max(len(window) - len(MAGIC) + 1, 1)
                continue
            at += hit
            if at >= end:
                return
            member = _Member(file, at)
            found = _read(member, with_payload)
            if found is not None:
                yield found
            at = member.end if found is not None and member.end >= 0 else at + 1


def read_archives(listed: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archives in (path, bytes): page_id, record_type, refers_to, payload_bytes, payload_digest[, payload].

    Ranges of ``split_bytes`` are dealt out evenly, whatever files they are from. Bytes that do not inflate to a WARC
    header are passed over. A record that does but is cut short, whose fields cannot be read or whose payload has not the digest its
    header names is a row of record_type ``damaged``, never left out. Empty archives give no rows. Sizes and digests of responses are of the payload read; of
    revisits, which carry none, those in their headers.
    """
    splits = listed.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(split_bytes)}L)")).alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows, weight = [], 0
            for split in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for found in scan(*split, with_payload):
                    rows.append(found)
                    weight += len(found[5] or b"") + 200
                    if weight > 4 << 20:
                        yield batch(rows)
                        rows, weight = [], 0
            if rows:
                yield batch(rows)

    # One range a task, however many: executors take them as they come.
    dealt = splits.repartition(max(1, int(splits.count())))
    out = dealt.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
    return out if with_payload else out.drop("payload")


def archive_and_read(pages: DataFrame, *, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives (into a new shared folder, unless one is named) and reads them back."""
    listed = write_archives(pages, folder or new_path(pages.sparkSession, "warc"), least_bytes=least_bytes)
    return read_archives(listed)
