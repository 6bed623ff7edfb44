"""WARC archives: writing records, and reading them by verified boundary chains.

An uncompressed archive has no index, and a payload may hold the very bytes that
start a record.  Reading a file in ranges therefore takes three steps:

1. Each range is scanned for the magic.  Every candidate header gives the offset of
   its successor, and within the range chains are followed to the first offset
   beyond it: one row (file, entry, exit) for a candidate that another candidate's
   chain may reach.
2. Pointer jumping from the start of every file, with both the reached entries and
   the jumps doubled in each round, retains what is reachable.
3. Each range is parsed from its reached entry on.  Magic inside payloads is never
   reached, so it is never taken for a record.

Defined results: a null html is an empty payload; of rows with equal payloads of at
least ``least`` bytes the one with the smallest page_id is a response and the others
revisit it; rows with the same page_id and payload are all responses of that payload
(none refers to itself); a row without page_id is always a response; urls of any length
come back whole, empty ones, null ones and those with control signs too (a null one is
written as about:blank, and one of these words carries a mark); payloads of any length
are written in one piece; an empty table gives no rows.  Only page_id, url and html are read,
whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import move_into_place, new_path, one_task_each, remove, shuffle_partitions, spread_join, written

VERSION = b"WARC/1.1\r\n"
RANGE_BYTES = 8 << 20
#: Bytes of ranges for each task, where there are more than one for each shuffle partition.
TASK_BYTES = 1 << 30
_NO_URL = "about:blank"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)
#: Header blocks beyond this are fetched on while all their lines are header lines.
MOST_HEADER = 64 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m[0]), url or "") or _NO_URL
    head = [
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")).encode(),
        b"WARC-Date: 2024-01-01T00:00:00Z",
        b"WARC-Target-URI: " + uri.encode(),
        b"WARC-Payload-Digest: sha1:" + sha1.encode(),
        b"X-Page-Id: " + (b"" if page_id is None else b"%d" % page_id),
    ]
    if url is not None and (uri != url or url == _NO_URL):
        # White space and control signs have no place in a URI: the url as it was goes along.
        head.append(b"X-Page-Url: " + quote(url).encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + _PROFILE, b"X-Refers-To-Page-Id: %d" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (binary), refers_to."""
    rows = pages.selectExpr("page_id", "url", "coalesce(cast(html as binary), X'') as html").withColumn("sha1", F.sha1("html"))
    sums, _ = written(rows.filter(F.octet_length("html") >= least).select("page_id", "sha1"), "warc-sums")
    # Payloads that occur once need no further thought: only repeated digests are kept.
    first, _ = written(sums.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1"), "warc-firsts")
    repeated, _ = written(spread_join(sums, first, "sha1").filter("page_id > first").select("page_id", "sha1", "first").distinct(), "warc-revisits")
    # A table in the shared folder has a known size: Spark broadcasts it while it is
    # small and shuffles by page_id where it is not.
    return rows.join(repeated, ["page_id", "sha1"], "left").withColumnRenamed("first", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> list[tuple[str, int]]:
    """Writes a record for every page; returns the files and their sizes."""

    def write(batches):
        store, top = fs.FileSystem.from_uri(folder)
        name, own = f"pages-{TaskContext.get().partitionId():06d}.warc", f".{uuid.uuid4().hex}"
        size = 0
        out = store.open_output_stream(f"{top}/{own}")
        with out:
            for b in batches:
                for page, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    size += out.write(record(page, url, html, digest(html), ref))
        if size:
            move_into_place(store, f"{top}/{own}", f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64())})
        else:
            store.delete_file(f"{top}/{own}")

    where, top = fs.FileSystem.from_uri(folder)
    where.create_dir(top)
    files = with_revisits(pages, least).mapInArrow(write, "file string, bytes bigint").collect()  # one row for each file
    return sorted((r["file"], r["bytes"]) for r in files)


class _Window:
    """Bytes of a file; one range of it is read at once, the rest as it is asked for."""

    def __init__(self, folder: str, name: str, start: int, stop: int):
        store, top = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{top}/{name}")
        self.size = self.file.size()
        self.start, self.data = start, b""
        self.data = self.at(start, stop - start)

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, max(0, self.size - offset))
        a = offset - self.start
        if 0 <= a and a + n <= len(self.data):
            return self.data[a : a + n]
        return self.file.read_at(n, offset)

    def header(self, offset: int, head: bytes | None = None) -> tuple[bytes, int, int] | None:
        """Header, offset of the block and of the successor, if a record may start here."""
        head = head if head is not None else self.at(offset, 4096)
        if not head.startswith(VERSION):
            return None
        while (end := head.find(b"\r\n\r\n")) < 0:
            if offset + len(head) >= self.size:
                return None
            if len(head) >= MOST_HEADER and any(b":" not in line for line in head[len(VERSION) :].split(b"\r\n")[:-1]):
                return None
            head = self.at(offset, 4 * len(head))
        length = _LENGTH.search(head, 0, end)
        if not length:
            return None
        block = offset + end + 4
        after = block + int(length[1]) + 4
        return (head[:end], block, after) if after <= self.size else None


def _candidates(folder: str, name: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(candidate, first offset at or beyond stop on its chain) in one range."""
    w = _Window(folder, name, start, stop + len(VERSION) - 1)
    data = w.data
    found: dict[int, int] = {}
    at = data.find(VERSION)
    while 0 <= at < stop - start:
        local = data[at : at + 4096]
        got = w.header(start + at, local if b"\r\n\r\n" in local else None)
        if got:
            found[start + at] = got[2]
        at = data.find(VERSION, at + 1)
    # Right to left, a successor inside the range is already resolved; a chain that
    # runs into a place without a candidate ends there, as a dead end.
    exits: dict[int, int] = {}
    for offset in sorted(found, reverse=True):
        after = found[offset]
        exits[offset] = exits.get(after, -1) if after < stop else after
    return sorted(exits.items())


def _tasks(spark: SparkSession, files: list[tuple[str, int]], step: int) -> int:
    """Ranges go, one after another, to so many tasks: no more than there are, and one for each TASK_BYTES or shuffle partition."""
    return min(sum(-(-n // step) for _, n in files), max(shuffle_partitions(spark), -(-sum(n for _, n in files) // TASK_BYTES)))


def _ranges(spark: SparkSession, files: list[tuple[str, int]], step: int) -> DataFrame:
    """One row for each byte range.  The driver knows the files only."""
    sizes = spark.createDataFrame(files, "file string, size bigint")
    rows = sizes.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(step).cast("bigint"))))
    rows = rows.select("file", "start", F.least("size", F.col("start") + step).alias("stop"))
    return one_task_each(rows, _tasks(spark, files, step), "file", "start")


def reached_entries(spark: SparkSession, folder: str, files: list[tuple[str, int]], step: int = RANGE_BYTES) -> DataFrame:
    """(file, entry): where the chain from each file's start enters each range."""

    def scan(batches):
        for b in batches:
            for name, a, z in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                for k in range(0, len(got := _candidates(folder, name, a, z)), 10_000):
                    part = got[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(part), "entry": pa.array([o for o, _ in part], pa.int64()), "exit": pa.array([e for _, e in part], pa.int64())})

    jumps, path = written(_ranges(spark, files, step).mapInArrow(scan, "file string, entry bigint, exit bigint"), "warc-candidates")
    # Only places that some chain leads to, and starts of files, can be entries.
    live = jumps.select("file", F.col("exit").alias("entry")).distinct()
    jumps = jumps.filter("entry = 0").unionByName(jumps.filter("entry > 0").join(live, ["file", "entry"], "left_semi"))
    jumps, next_path = written(jumps, "warc-jumps")
    remove(spark, path)
    # Doubled jumps lose the entries that end before the jump does; these stay entries.
    known, path = jumps.select("file", "entry"), None
    reached, reached_path = written(jumps.filter("entry = 0").select("file", "entry"), "warc-reached")
    most = max(-(-n // step) for _, n in files)
    for _ in range(max(1, most).bit_length()):
        ahead = reached.join(jumps, ["file", "entry"]).select("file", F.col("exit").alias("entry"))
        reached, old = written(reached.union(ahead.join(known, ["file", "entry"], "left_semi")).distinct(), "warc-reached"), reached_path
        reached, reached_path = reached
        remove(spark, old)
        b = jumps.select("file", F.col("entry").alias("exit"), F.col("exit").alias("after"))
        jumps, old = written(jumps.join(b, ["file", "exit"]).select("file", "entry", F.col("after").alias("exit")), "warc-jumps"), path
        jumps, path = jumps
        if old:
            remove(spark, old)
    remove(spark, path)
    remove(spark, next_path)
    return reached


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]], step: int = RANGE_BYTES) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not files:
        return spark.createDataFrame([], schema)
    entries = reached_entries(spark, folder, files, step)

    def parse(batches):
        for b in batches:
            for name, at in zip(b.column("file").to_pylist(), b.column("entry").to_pylist(), strict=True):
                stop, rows, held = (at // step + 1) * step, [], 0
                w = _Window(folder, name, at, stop)
                while at < min(stop, w.size):
                    got = w.header(at)
                    if not got:
                        raise ValueError(f"{name}: no record at {at}, where the chain leads")
                    head, block, at = got
                    f, body = _fields(head), w.at(block, got[2] - 4 - block)
                    http, _, payload = body.partition(b"\r\n\r\n")
                    kind, page, ref = f[b"warc-type"].decode(), f[b"x-page-id"], f.get(b"x-refers-to-page-id")
                    sha1 = f[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha1:
                        raise ValueError(f"{name}: the payload before {at} differs from its digest")
                    n = len(payload) if kind == "response" else int(_LENGTH.search(b"\r\n" + http)[1])
                    uri = unquote(f[b"x-page-url"].decode()) if b"x-page-url" in f else f[b"warc-target-uri"].decode()
                    if uri == _NO_URL and b"x-page-url" not in f:
                        uri = None
                    rows.append((int(page) if page else None, uri, payload if kind == "response" else None, n, sha1, kind, int(ref) if ref else None))
                    held += len(body)
                    if held > RANGE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return one_task_each(entries, _tasks(spark, files, step), "file", "entry").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, step: int = RANGE_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads every record back."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder, least), step)
