"""WARC archives: writing with revisit records, and reading that salvages damaged files.

Each record is a gzip member of its own, followed by an empty member (the line end of Spark's
text writer, which writes the files wherever Spark can write). The reader takes compressed and
plain archives. Where a record fails a check it searches for the next member or version line
that starts a sound record, goes on from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm.common import batch

DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 50_000
MAX_RECORD = 256 << 20
#: over what any Spark value can hold: nothing that write_warc wrote is refused
OWN_RECORD = 1 << 32
HEADER_STEP = 1 << 16
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEPARATOR = gzip.compress(b"", mtime=0).decode("latin-1")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
_MEMBER = pa.schema([("value", pa.binary())])
_READ_SCHEMA = pa.schema([
    ("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("payload_digest", pa.string())])
_READ_DDL = ("kind string, file string, offset long, length long, reason string, "
             "headers map<string,string>, payload binary, payload_digest string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes | None, digest: str, refers_to, date: str) -> bytes:
    """One record; without a payload it is a revisit."""
    lines = [("WARC-Type", "revisit" if payload is None else "response"),
             ("WARC-Record-ID", page_uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(
            r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", page_uri(refers_to))]
        block += b"\r\n"
    else:
        block += b"Content-Length: %d\r\n\r\n%b" % (len(payload), payload)
    lines += [("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
              ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    return b"WARC/1.1\r\n%b\r\n%b\r\n\r\n" % (head, block)


def write_warc(pages: DataFrame, folder: str, date: str = DATE, level: int = 1,
               records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of (page_id, url, html): a response, or a revisit of an equal payload.

    Of rows with equal payloads those with the largest page_id are responses, the others revisit
    it. A null html is an empty payload, a null page_id is smaller than any other, a null url is
    left out. Repeated rows are records each. Other columns are ignored.
    """
    def run(batches):
        for rows in batches:
            out = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in rows.columns)):
                found = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(gzip.compress(_record(
                    page_id, url, html, found, first, date), level, mtime=0))
            yield batch(_MEMBER, value=out)

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        payload.alias("html"), F.sha1(payload).alias("digest"))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("first"))
    own = F.col("page_id").eqNullSafe(F.col("first"))
    rows.join(first, "digest").select(
        "page_id", "url", F.when(own, F.col("html")).alias("html"), "digest", "first").mapInArrow(
            run, "value binary").select(F.col("value").cast("string")).write.option(
                "encoding", "ISO-8859-1").option("lineSep", _SEPARATOR).option(
                    "maxRecordsPerFile", records_per_file).text(folder)


class _Unsound(Exception):
    """A record fails a check; the message says which."""


class _Window:
    """The part of a stream that is being looked at."""

    def __init__(self, stream):
        self._stream, self._data, self._base, self._ended = stream, bytearray(), 0, False

    def fill(self, stop: int) -> int:
        """Read up to ``stop``; the end of what is there."""
        while not self._ended and self._base + len(self._data) < stop:
            more = self._stream.read(max(_READ, stop - self._base - len(self._data)))
            self._data += more
            self._ended = not more
        return min(stop, self._base + len(self._data))

    def get(self, start: int, stop: int) -> bytes:
        stop = self.fill(stop)
        return bytes(memoryview(self._data)[start - self._base:stop - self._base])

    def search(self, start: int) -> int | None:
        """The next place from ``start`` on that may begin a member or record."""
        while True:
            end = self.fill(start + _READ)
            found = _START.search(self._data, start - self._base)
            if found:
                return found.start() + self._base
            if self._ended:
                return None
            start = max(start, end - 8)
            self.drop(start)

    def drop(self, start: int) -> None:
        """Forget what lies before ``start``."""
        if start - self._base > 4 * _READ:
            del self._data[:start - self._base]
            self._base = start


def _parse(get, start: int, limit: int) -> tuple[dict, bytes, bytes | None, str | None, int]:
    """Headers, block, payload, its digest and the end of the record that begins at ``start``."""
    head = get(start, start + HEADER_STEP)
    if not _VERSION.match(head):
        raise _Unsound("no version line")
    step = HEADER_STEP
    while (end := head.find(b"\r\n\r\n")) < 0:
        if len(head) < step or step >= limit:
            raise _Unsound("headers do not end")
        step *= 2
        head = get(start, start + step)
    headers = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and headers:
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise _Unsound("a header line without a colon")
        name = name.strip().lower()
        headers[name] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise _Unsound("no content length")
    if int(size) > limit:
        raise _Unsound("content length over the limit")
    start += end + 4
    block = get(start, start + int(size))
    if get(start + int(size), start + int(size) + 4) != b"\r\n\r\n":
        raise _Unsound("no record end after the content length")
    payload, digest = None, None
    if headers.get("warc-type") in ("response", "resource"):
        http = headers.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        digest = sha1_base32(payload)
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        kind, _, value = headers.get(name, "").partition(":")
        if data is not None and kind.lower() == "sha1" and len(value) == 32 \
                and value != (digest if data is payload else sha1_base32(data)):
            raise _Unsound(f"{name} differs")
    if payload is None:
        digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
    return headers, block, payload, digest, start + int(size) + 4


def _member(window: _Window, start: int, limit: int) -> tuple[bytes, int]:
    """What the gzip member at ``start`` holds and where it ends."""
    inflate, parts, held, at = zlib.decompressobj(31), [], 0, start
    most = limit + max(2 * limit, HEADER_STEP)  # content and headers
    while not inflate.eof:
        data = inflate.unconsumed_tail or window.get(at, at + (_READ >> 4))
        if not data:
            raise _Unsound("the member does not end")
        at += 0 if inflate.unconsumed_tail else len(data)
        try:
            parts.append(inflate.decompress(data, most))
        except zlib.error as e:
            raise _Unsound("the member does not inflate") from e
        held += len(parts[-1])
        if held > most:
            raise _Unsound("the member is over the limit")
    return b"".join(parts), at - len(inflate.unused_data)


def salvage(stream, limit: int = MAX_RECORD) -> Iterator[tuple]:
    """("record", offset, length, None, headers, payload, digest) and ("gap", offset, length, reason).

    Every byte of the stream belongs to a record, an empty member or a gap. Memory holds one
    record at a time; one with content over ``limit`` counts as damaged. Headers may be of any
    length up to that.
    """
    window, at, gap, reason = _Window(stream), 0, None, None
    while window.get(at, at + 1):
        found, end = [], at
        try:
            if window.get(at, at + 2) == b"\x1f\x8b":
                data, end = _member(window, at, limit)
                inside = 0
                while inside < len(data):
                    *record, inside = _parse(lambda a, b: data[a:b], inside, limit)
                    found.append(record)
            else:
                *record, end = _parse(window.get, at, limit)
                found.append(record)
        except _Unsound as e:
            if gap is None:
                gap, reason = at, str(e)
            at = window.search(at + 1)
            if at is None:
                break
            continue
        if gap is not None and (found or end > at):
            yield "gap", gap, at - gap, reason, None, None, None
            gap = None
        for headers, _, payload, digest in found:
            yield "record", at, end - at, None, headers, payload, digest
        at = end
        window.drop(at)
    if gap is not None:
        stop = gap
        while (more := window.fill(stop + _READ)) > stop:
            stop = more
        yield "gap", gap, stop - gap, reason, None, None, None


def read_warc(spark: SparkSession, folder: str, limit: int = MAX_RECORD) -> DataFrame:
    """Records and gaps of all files of a folder, which Spark deals to tasks by their sizes.

    kind (record or gap), file, offset and length (of the record's member or plain bytes, or of
    the gap), reason (of a gap), headers (names in lower case), payload (the HTTP body; null for
    records without one) and payload_digest (base-32 SHA-1; as stated where there is no payload).
    """
    def run(batches):
        for rows in batches:
            for file in rows.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for kind, offset, length, reason, headers, payload, digest in salvage(stream, limit):
                        held.append((kind, file, offset, length, reason,
                                     headers and list(headers.items()), payload, digest))
                        size += 1024 + len(payload or b"")
                        if size > 4 * _READ:
                            yield batch(_READ_SCHEMA, **dict(zip(_READ_SCHEMA.names, zip(*held))))
                            held, size = [], 0
                if held:
                    yield batch(_READ_SCHEMA, **dict(zip(_READ_SCHEMA.names, zip(*held))))

    return spark.read.format("binaryFile").load(folder).select("path").mapInArrow(run, _READ_DDL)
