"""WARC archives with a two-level capture index.

Every capture is a gzip member of its own.  The index sorts captures by reversed-host URL key into
compressed blocks; behind its blocks each index file has a sparse directory (first key, offset and
length of each block), and a small table has each file's first key.  A lookup searches the table, then
the directory, by bisection, and reads only the blocks and records it needs by range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Output, batches, open_fs, scratch, stored, width

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CAPTURES = "key string, page_id long, uri string, offset long, length long, record_type string"
_FIELDS = [x.split()[0] for x in _CAPTURES.split(", ")]


def url_key(url: str | None) -> str:
    """http://www.Example.com:81/a?b -> com,example,www:81)/a?b; controls and spaces are escaped, null is empty."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = f":{port}" if port and (parts.scheme, port) not in {("http", 80), ("https", 443)} else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One capture as a gzip member; a revisit has the response's headers but no payload."""
    block = _HTTP % len(payload) + (b"" if refers_to is not None else payload)
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """What a capture says: headers, payload (None for a revisit), payload_bytes, digest; damage raises ValueError."""
    raw = zlib.decompress(member, 31)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if not sep or lines[0] != "WARC/1.1" or len(rest) != size + 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest_of(payload) != said):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    ident = lambda x: int(x) if (x := x[len("<urn:x-page:") : -1]) else None
    return {"page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": ident(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": said}


def write(pages: DataFrame, out_dir: str | None = None, file_bytes: int = 64 << 20, revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row of pages as a WARC record; returns the captures (key, page_id, uri, offset, length, record_type).

    Of rows with equal payloads of at least revisit_from bytes, that with the smallest page_id (and any
    repeated row of that page_id) is a response, the others revisit it.  Null html: empty payload; null
    url: empty; null page_id: always a response, which no row revisits unless it has no other.
    """
    spark, out = pages.sparkSession, out_dir or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sums = rows.select("page_id", F.sha1(F.col("html")).alias("sha"), F.octet_length("html").alias("n"))
    # copies meet as narrow rows; only who revisits whom travels on to the payloads
    # firsts are written, so that both sides of the join are plain shuffles, whose hot keys are split
    firsts = stored(sums.where(F.col("n") >= revisit_from).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND first IS NOT NULL"), "firsts")
    later = sums.join(firsts, ["sha", "n"]).where("page_id > first").select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "first").distinct()
    full = rows.join(later, (F.col("page_id") == F.col("of")) & (F.sha1(F.col("html")) == F.col("of_sha")), "left").select("page_id", "url", "html", "first")

    def archive(it):
        part, k, file, got = TaskContext.get().partitionId(), 0, None, []

        def rowset():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=_FIELDS)

        for b in batches(it, 500):
            for page, url, html, first in zip(*(b.column(x).to_pylist() for x in ("page_id", "url", "html", "first")), strict=True):
                if file is None:
                    uri = f"{out}/part-{part:06d}-{k:05d}.warc.gz"
                    file, k = Output(uri), k + 1
                member = record(page, url, html.encode(), first, date)
                got.append((url_key(url), page, uri, file.write(member), len(member), "response" if first is None else "revisit"))
                if file.size >= file_bytes:
                    file.close()
                    file = None
                    yield rowset()
                    got = []
        if file:
            file.close()
            yield rowset()

    return stored(full.mapInArrow(archive, _CAPTURES), "captures")


def index(captures: DataFrame, out_dir: str | None = None, block_rows: int = 2000) -> DataFrame:
    """Write the capture index; returns its files (first_key, last_key, uri, n), one row for each, in key order."""
    out = out_dir or scratch(captures.sparkSession, "cdx")

    def write_part(it):
        uri, file, directory, lines, n, first, last = f"{out}/part-{TaskContext.get().partitionId():06d}.cdx", None, [], [], 0, "", ""

        def flush():
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([lines[0].split("\t", 1)[0], file.write(data), len(data)])
            lines.clear()

        for b in batches(it):
            file = file or Output(uri)
            for row in zip(*(b.column(x).to_pylist() for x in _FIELDS), strict=True):
                first, last, n = (row[0] if n == 0 else first), row[0], n + 1
                lines.append("\t".join("" if x is None else str(x) for x in row))
                if len(lines) >= block_rows:
                    flush()
        if file:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            file.write(data + len(data).to_bytes(8, "little"))
            file.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "last_key": [last], "uri": [uri], "n": [n]}, schema=pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("uri", pa.string()), ("n", pa.int64())]))

    ordered = captures.repartitionByRange("key", "page_id", "uri", "offset").sortWithinPartitions("key", "page_id", "uri", "offset")
    return stored(ordered.mapInArrow(write_part, "first_key string, last_key string, uri string, n long"), "cdx-files")


class IndexFile:
    """Reads one index file: the directory at its end, then blocks by range."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._file = fs.open_input_file(path)
        end = self._file.size()
        size = int.from_bytes(self._file.read_at(8, end - 8), "little")
        self.directory = json.loads(zlib.decompress(self._file.read_at(size, end - 8 - size)))
        self.reads = 0

    def block(self, k: int) -> list[list]:
        _, offset, length = self.directory[k]
        self.reads += 1
        lines = zlib.decompress(self._file.read_at(length, offset)).decode().split("\n")
        return [[key, int(page) if page else None, uri, int(at), int(size), kind] for key, page, uri, at, size, kind in (x.split("\t") for x in lines)]

    def find(self, key: str) -> list[list]:
        """The captures of a key: bisection in the directory, then the blocks that can hold it."""
        k, got = max(0, bisect_left([x[0] for x in self.directory], key) - 1), []
        while k < len(self.directory) and self.directory[k][0] <= key:
            got += [x for x in self.block(k) if x[0] == key]
            k += 1
        return got

    def close(self) -> None:
        self._file.close()


def lookup(files: DataFrame, url: str) -> list[dict]:
    """The records of a URL.  The table of index files, one row for each written task, is searched where it lies."""
    key, found = url_key(url), []
    for r in files.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("uri").toLocalIterator():
        part = IndexFile(r.uri)
        for _, _, uri, offset, length, _ in part.find(key):
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                found.append(parse(f.read_at(length, offset)))
        part.close()
    return found


def read(files: DataFrame, span: int = 8 << 20) -> DataFrame:
    """Read all archives back through the index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Index blocks give the captures; dealt by place, so that each task reads neighbouring ranges at once,
    at most span bytes.  Payloads are checked against their digests.
    """
    spark = files.sparkSession

    def entries(it):
        for b in it:
            for uri in b.column("uri").to_pylist():
                part = IndexFile(uri)
                for k in range(len(part.directory)):
                    rows = part.block(k)
                    yield pa.RecordBatch.from_pydict({"uri": [r[2] for r in rows], "offset": [r[3] for r in rows], "length": [r[4] for r in rows]}, schema=pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
                part.close()

    def records(it):
        names, fs_uri, file = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), None, None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches(it, 500):
            got, rows = [], list(zip(*(b.column(x).to_pylist() for x in ("uri", "offset", "length")), strict=True))
            i = 0
            while i < len(rows):
                uri, start, end = rows[i][0], rows[i][1], rows[i][1] + rows[i][2]
                j = i + 1
                while j < len(rows) and rows[j][0] == uri and rows[j][1] == end and rows[j][1] + rows[j][2] - start <= span:
                    end, j = rows[j][1] + rows[j][2], j + 1
                if uri != fs_uri:
                    if file:
                        file.close()
                    fs, path = open_fs(uri)
                    file, fs_uri = fs.open_input_file(path), uri
                raw = file.read_at(end - start, start)
                for _, at, size in rows[i:j]:
                    x = parse(raw[at - start : at - start + size])
                    got.append([x[n] for n in names])
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], names=list(names))
        if file:
            file.close()

    spread = files.select("uri").repartition(width(spark)).mapInArrow(entries, "uri string, offset long, length long")
    return spread.repartitionByRange(width(spark), "uri", "offset").sortWithinPartitions("uri", "offset").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
