"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC 1.1 files in the shared folder; of equal payloads only one is
stored, the others are revisit records. The index sorts reversed-host URL keys over all captures into
shards; a shard is a file of gzip blocks of lines and a sparse directory with each block's first key. A
lookup finds the shard and the block by binary search, reads that block's range and then the record's.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lines of an index block; bytes after which a task begins another archive; zlib level.
BLOCK_LINES, ARCHIVE_BYTES, LEVEL = 3000, 1 << 30, 3
#: Shorter payloads are always stored.
LEAST_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
# Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The sort key of a URL: host reversed, scheme, user and fragment dropped."""
    if not url:
        return "-"
    text = "".join(c if c > " " else f"%{ord(c):02X}" for c in url.strip())
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return text.replace("\t", "%09")
    host = host if ":" in host else ",".join(reversed(host.split(".")))
    return host + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def key_of(url: str | None, page: int) -> str:
    return f"{surt(url)} {page + 2**63:020d}"


def _name(page: int | None) -> str:
    return "null" if page is None or page == common.NULL_ID else str(page)


def record(page: int, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_name(page)}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{_name(refers_to)}>"]
    body = head if refers_to is not None else head + html
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    raw = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> dict:
    """A record's fields, and its payload (None for a revisit). Raises ValueError on a broken record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/1.") or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")

    def page(x: str | None) -> int | None:
        found = x and x.removeprefix("<urn:page:").removesuffix(">")
        return None if found in (None, "null") else int(found)

    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "type": fields["WARC-Type"],
        "digest": digest,
        "bytes": size,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Store:
    """Files of the shared folder, wherever that is; open ones are kept, the oldest closed first."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)
        self.open: OrderedDict = OrderedDict()

    def write(self, name: str):
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def read(self, name: str, offset: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(size, offset)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read()


CAPTURE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SHARD = pa.schema([("first", pa.string()), ("file", pa.string()), ("blocks", pa.int64())])


def _writer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at, n = Store(base), None, "", 0, 0
        task = TaskContext.get()
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html, hexed, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    # a repeated attempt writes another file; only what a finished one returns is indexed
                    name, at, n = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.gz", 0, n + 1
                    out = store.write(name)
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                member = record(page, url, payload, digest, first if page != first and len(payload) >= LEAST_REVISIT else None)
                out.write(member)
                rows.append((key_of(url, page), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, CAPTURE.types, strict=True)], schema=CAPTURE)
        if out is not None:
            out.close()

    return run


def _indexer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"captures-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, out, directory, held, at = Store(base), None, [], [], 0

        def end_block() -> None:
            nonlocal out, at
            if out is None:
                out = store.write(name + ".cdx.gz")
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress("\n".join(held).encode()) + z.flush()
            directory.append(f"{held[0].split(chr(9), 1)[0]}\t{at}\t{len(member)}")
            out.write(member)
            at += len(member)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append("\t".join(map(str, row)))
                if len(held) >= BLOCK_LINES:
                    end_block()
        if held:
            end_block()
        if out is not None:
            out.close()
            with store.write(name + ".idx") as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t", 1)[0]]), pa.array([name]), pa.array([len(directory)], pa.int64())], schema=SHARD)

    return run


class Index:
    """Captures by key: shards and a shard's directory are searched, then one block is read."""

    def __init__(self, base: str, shards: list[tuple[str, str]]):
        self.store = Store(base)
        self.firsts, self.names = [s[0] for s in shards], [s[1] for s in shards]
        self.directories: OrderedDict = OrderedDict()
        self.block: tuple = (None, None, None)

    def directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        if name not in self.directories:
            if len(self.directories) >= 8:
                self.directories.popitem(last=False)
            rows = [x.split("\t") for x in self.store.whole(name + ".idx").decode().split("\n")]
            self.directories[name] = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        return self.directories[name]

    def lines(self, name: str, k: int) -> tuple[list[str], list[list[str]]]:
        if self.block[0] != (name, k):
            offset, size = self.directory(name)[1][k]
            rows = [x.split("\t") for x in zlib.decompress(self.store.read(name + ".cdx.gz", offset, size), 31).decode().split("\n")]
            self.block = (name, k), [r[0] for r in rows], rows
        return self.block[1], self.block[2]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """file, offset and length of every capture with this key."""
        out = []
        # equal keys may reach over the ends of blocks and shards
        s = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while s < len(self.names) and (self.firsts[s] <= key):
            firsts, _ = self.directory(self.names[s])
            k = max(0, bisect.bisect_left(firsts, key) - 1)
            while k < len(firsts) and firsts[k] <= key:
                keys, rows = self.lines(self.names[s], k)
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    out.append((rows[i][1], int(rows[i][2]), int(rows[i][3])))
                k += 1
            s += 1
        return out


class Archive:
    """Archives and their index in one folder of the shared storage."""

    def __init__(self, spark: SparkSession, base: str, shards: list[tuple[str, str]]):
        self.spark, self.base, self.shards = spark, base, shards

    def find(self, keys: DataFrame) -> DataFrame:
        """key, file, offset, length of the captures of keys; sorted ranges of keys share blocks."""
        base, shards = self.base, self.spark.sparkContext.broadcast(self.shards)  # a row for each shard

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(base, shards.value)
            for batch in batches:
                rows = [(k, *found) for k in batch.column(0).to_pylist() for found in index.find(k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, CAPTURE.types, strict=True)], schema=CAPTURE)

        n = common.parts(self.spark)
        ordered = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
        return ordered.mapInArrow(run, "key string, file string, offset long, length long")

    def read(self, captures: DataFrame, payloads: bool = False) -> DataFrame:
        """The records at captures, each archive in order of offsets."""
        base = self.base
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = Store(base)
            for batch in batches:
                got = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    r = parse(store.read(file, offset, length))
                    got.append((r["page_id"], r["url"], r["bytes"], r["digest"], r["type"], r["refers_to"], r["payload"] if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 7, schema.types, strict=True)], schema=schema)

        n = common.parts(self.spark)
        ordered = captures.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(common.NULL_ID)).alias("page_id"), F.col("url").cast("string").alias("url"), "html")


def write(pages: DataFrame, base: str | None = None) -> Archive:
    """Writes a record for every page (page_id, url, html; null html is empty) and the index over them.

    Of pages with equal payloads of at least LEAST_REVISIT bytes that with the least page_id is stored (a
    null id is the least), the others refer to it; rows that share that id as well are all stored. Null
    and broken urls are kept and have keys of their own. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    common.ship(spark)
    base = base or common.fresh_path(spark, "warc")
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    hashed = _pages(pages).withColumn("digest", digest)
    firsts = hashed.groupBy("digest").agg(F.min("page_id").alias("first"))
    captures = common.settled(hashed.join(firsts, "digest").select("page_id", "url", "html", "digest", "first").mapInArrow(_writer(base), "key string, file string, offset long, length long"))
    n = common.parts(spark)
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    shards = ordered.mapInArrow(_indexer(base), "first string, file string, blocks long").collect()  # at most a row a task
    return Archive(spark, base, sorted((s["first"], s["file"]) for s in shards))


def keys(pages: DataFrame) -> DataFrame:
    common.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [key_of(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])

    return _pages(pages).select("page_id", "url").mapInArrow(run, "key string")


def op4(pages: DataFrame) -> DataFrame:
    archive = write(pages)
    return archive.read(archive.find(keys(pages))).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
q AS (SELECT page_id, first, strlen(h) AS n, sha1(h) AS x FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
