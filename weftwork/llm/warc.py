"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, one member per record, and returns where each
record lies. Payloads that occur before (that of the smallest page_id counts as first) are written
as revisit records without their payload.

Index: capture lines, keyed by reversed host (``com,example,blog)/path?query``) and page_id, are
range-sorted; each task writes its range as gzip blocks of ``block_lines`` lines and, beside it, a sparse
directory with the first key of each block. The first and last key of each file are all that a
lookup sends to its tasks; a task then binary-searches the directory of its file, reads the one
block by its byte range and binary-searches the lines.

Files go to the folder that all executors share, through Arrow's file systems, under names of their
own for each attempt, so a task that runs again disturbs nothing: rows refer to files of finished
attempts alone.

Edge cases: a null payload is empty; a null url has the key ``-`` and no target field; a null page_id
is written as ``-`` and read as null, and is never the smallest; rows that share the smallest
page_id of a payload are all responses; page ids are whole numbers, or text that is one (other ids are an
error); a very long payload is one record, held whole while it is written or read; captures with the same
key are in the order of their page_id; a payload that very many pages have is joined where its rows lie; an
empty table makes no archive and gives an empty one; columns beside the three that are named are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import file_system, join_split, shared_path, tidy

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 3000
GZIP_LEVEL = 4
#: Smallest payload that a revisit record may stand for.
MIN_REVISIT_BYTES = 0
#: Gap between two ranges of a file up to which they are read at once, and the most that is read at once.
READ_GAP, READ_MOST = 64 << 10, 4 << 20
#: Bytes of archives that a task reads; a row of places is far smaller than what it names, so Spark can't size such tasks itself.
READ_TASK = 32 << 20


CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, scheme, user, fragment and default port left out."""
    if not url:
        return "-"
    url = re.sub(r"[\x00-\x20]+", lambda m: quote(m[0]), url.strip())
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return url
    if not host:
        return url
    labels = ",".join(reversed(host.rstrip(".").split(".")))
    shown = "" if port in (None, {"http": 80, "https": 443}.get(u.scheme)) else f":{port}"
    return f"{labels}{shown}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    show = lambda x: "-" if x is None else str(x)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(show(page_id))}", f"WARC-Date: {DATE}", f"WARC-Page-ID: {show(page_id)}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]+", lambda m: quote(m[0]), url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(show(refers_to))}", f"WARC-Refers-To-Page-ID: {show(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(GZIP_LEVEL, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """The fields of a record's member: type, ids, payload (None for a revisit), the full payload's size and digest."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    back = lambda x: None if x in (None, "-") else int(x)
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(body) != size or digest(body) != said):
        raise ValueError(f"record of page {fields['WARC-Page-ID']} does not hold the payload that it names")
    return {"page_id": back(fields["WARC-Page-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": body if fields["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": said, "refers_to": back(fields.get("WARC-Refers-To-Page-ID"))}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives under ``folder``; capture rows (key, page_id, url, file, offset, length).

    Beside each archive lies a Parquet file with its captures. The names of finished archives come to
    the driver, one for each task.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sums = p.select("page_id", F.sha1("html").alias("sum"), F.octet_length("html").alias("size")).where(f"size >= {int(min_revisit_bytes)}")
    first = sums.groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = join_split(sums, first, "sum", "n").where("NOT page_id <=> first").select(F.col("page_id").alias("id"), F.col("sum").alias("id_sum"), "first").distinct()
    marked = p.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.sha1("html") == F.col("id_sum")), "left").select("page_id", "url", "html", "first", F.col("id_sum").isNotNull().alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs, root = file_system(folder)
        for b in batches:
            rows = []
            for page_id, url, html, low, revisit in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                raw = record(page_id, url, html.encode(), low, revisit)
                rows.append((surt(url), page_id, url, f"{name}.warc.gz", at, len(raw)))
                at += len(raw)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, listed = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None), pq.ParquetWriter(f"{root}/{name}.captures.parquet", CAPTURES, filesystem=fs)
                out.write(raw)
            if rows:
                listed.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CAPTURES, strict=True)], schema=CAPTURES))
        if out is not None:
            out.close()
            listed.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    done = [r["name"] for r in marked.mapInArrow(tidy(write), "name string").collect()]
    ddl = "key string, page_id long, url string, file string, offset long, length long"
    if not done:
        return pages.sparkSession.createDataFrame([], ddl)
    return pages.sparkSession.read.schema(ddl).parquet(*(f"{folder}/{n}.captures.parquet" for n in done))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, str]]:
    """Writes blocks and directories under ``folder``; (first key, last key, file) of each index file, in order. There is one for each task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, directory, lines, first, last, at = None, [], [], None, None, 0

        def flush():
            nonlocal lines, at
            z = zlib.compressobj(6, wbits=31)
            raw = z.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode()) + z.flush()
            out.write(raw)
            directory.append((lines[0][0], at, len(raw)))
            at += len(raw)
            lines = []

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, first = fs.open_output_stream(f"{root}/{name}.blocks", compression=None), row[0]
                lines.append(row)
                last = row[0]
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
            d.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, name)], names=["first", "last", "file"])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return sorted((r["first"], r["last"], r["file"]) for r in ordered.mapInArrow(tidy(write), "first string, last string, file string").collect())


class IndexFile:
    """An index file open for lookups: its directory, and the block that was read last."""

    def __init__(self, fs: pa.fs.FileSystem, root: str, name: str) -> None:
        with fs.open_input_stream(f"{root}/{name}.directory", compression=None) as f:
            self.directory = [json.loads(x) for x in f.read().decode().splitlines()]
        self.firsts = [x[0] for x in self.directory]
        self.blocks, self.held, self.lines = fs.open_input_file(f"{root}/{name}.blocks"), None, []

    def block(self, k: int) -> list:
        if self.held != k:
            _, at, size = self.directory[k]
            self.lines = [json.loads(x) for x in zlib.decompress(self.blocks.read_at(size, at), wbits=31).decode().split("\n") if x]
            self.held = k
        return self.lines

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key. The last block that begins before the key may hold its first captures."""
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.firsts)):
            if self.firsts[k] > key:
                return
            lines = self.block(k)
            for i in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                if lines[i][0] != key:
                    return
                yield lines[i]


def lookup(keys: DataFrame, tops: list[tuple[str, str, str]], folder: str, key_col: str = "key") -> DataFrame:
    """Captures (key, page_id, file, offset, length) of the distinct keys; ``tops`` is what ``write_index`` gives."""

    def route(batches):
        firsts = [t[0] for t in tops]
        for b in batches:
            key, file = [], []
            for x in b.column(0).to_pylist():
                k = bisect.bisect_right(firsts, x) - 1
                while k >= 0 and tops[k][1] >= x:  # a key may go on over several files
                    key.append(x)
                    file.append(tops[k][2])
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(file, pa.string())], names=["key", "index_file"])

    def search(batches):
        fs, root = file_system(folder)
        name, at = None, None
        for b in batches:
            rows = []
            for key, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != name:
                    name, at = file, IndexFile(fs, root, file)
                rows += at.find(key)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])

    routed = keys.select(F.col(key_col).alias("key")).where("key IS NOT NULL").distinct().mapInArrow(tidy(route), "key string, index_file string")
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, len(tops))
    return routed.repartitionByRange(parts, "index_file", "key").sortWithinPartitions("index_file", "key").mapInArrow(tidy(search), "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, payloads: bool = True, total: int | None = None) -> DataFrame:
    """The records of captures, read by byte ranges; ranges that lie near each other are read at once.

    total: bytes of the records, if known; else they are summed first.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    fields = [f for f in fields if payloads or f[0] != "payload"]

    def runs(rows):
        """(file, from, ranges) of ranges to be read at once."""
        run = None
        for file, offset, length in rows:
            if run and run[0] == file and 0 <= offset - run[2] <= READ_GAP and offset + length - run[1] <= READ_MOST:
                run[3].append((offset, length))
                run[2] = max(run[2], offset + length)
            else:
                if run:
                    yield run
                run = [file, offset, offset + length, [(offset, length)]]
        if run:
            yield run

    def read(batches):
        fs, root = file_system(folder)
        name, f = None, None
        for b in batches:
            for file, begin, end, ranges in runs(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)):
                if file != name:
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                raw = memoryview(f.read_at(end - begin, begin))
                rows = [parse(raw[o - begin : o - begin + n]) for o, n in ranges]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in fields], names=[c for c, _ in fields])

    ddl = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    spark = captures.sparkSession
    if total is None:
        total = captures.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // READ_TASK))
    ordered = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(tidy(read), ", ".join(f"{c} {ddl[t]}" for c, t in fields))


def archive(spark: SparkSession, pages: DataFrame, **columns) -> tuple[DataFrame, list, str]:
    """Writes pages and their index; captures, keys of the index files, and the folder."""
    folder = shared_path(spark, "warc")
    captures = write_archives(pages, folder, **columns)
    return captures, write_index(captures, folder), folder


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Each page's record, found through the index and read from the archives again."""
    spark = pages.sparkSession
    captures, index, folder = archive(spark, pages, **columns)
    found = lookup(captures, index, folder)
    return read_records(found, folder, payloads=False, total=captures.agg(F.sum("length")).first()[0] or 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
