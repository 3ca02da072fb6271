"""Video containers (MP4, MOV): boxes as rows, and what a file says of itself, with marks of damage.

A file is a tree of boxes: a length, a kind and a payload. The walk over it is a small helper that seeks from
head to head and reads the few payloads that matter, so a file's pictures are never read. All that follows from
them, durations, tracks, sizes, codecs and damage, is native.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOXES = "path string, size long, track int, kind string, payload binary, samples long"
#: Boxes that hold boxes, and those whose payload is read; one that is larger than MOST_PAYLOAD is damage.
_INSIDE = {b"moov": (b"trak", b"mvhd"), b"trak": (b"tkhd", b"mdia"), b"mdia": (b"hdlr", b"minf"), b"minf": (b"stbl",), b"stbl": (b"stsd", b"stts")}
_READ = (b"ftyp", b"mvhd", b"tkhd", b"hdlr", b"stsd", b"stts")
MOST_PAYLOAD = 64 << 20


def _heads(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, payload's begin, its end) of the boxes from a place on; a box that does not fit ends the walk."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        size, kind, begin = struct.unpack_from(">I", head)[0], head[4:8], 8
        if size == 1 and at + 16 <= end:
            size, begin = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = end - at
        if size < begin or at + size > end:
            return
        yield kind, at + begin, at + size
        at += size


def _walk(f: BinaryIO, kind: bytes, at: int, end: int, track: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(kind, track, payload) below a box; of what may stand once the first counts."""
    seen, tracks = set(), 0
    for child, lo, hi in _heads(f, at, end):
        if child not in _INSIDE.get(kind, ()) or child in seen:
            continue
        if child == b"trak":
            yield child, tracks, b""
            yield from _walk(f, child, lo, hi, tracks)
            tracks += 1
            continue
        seen.add(child)
        if child in _READ and hi - lo <= MOST_PAYLOAD:
            f.seek(lo)
            yield child, track, f.read(hi - lo)
        yield from _walk(f, child, lo, hi, track)


def _rows(path: str, f: BinaryIO, size: int) -> Iterator[tuple]:
    """A row for the file itself, and one for each box that matters."""
    yield path, size, None, "file", None, None
    seen = set()
    for kind, lo, hi in _heads(f, 0, size):
        if not seen:
            yield path, size, None, "box", None, None
        if kind in seen:
            continue
        seen.add(kind)
        if kind == b"ftyp":
            f.seek(lo)
            yield path, size, None, "ftyp", f.read(min(hi - lo, 4096)), None
        elif kind == b"moov":
            yield path, size, None, "moov", None, None
            for child, track, payload in _walk(f, kind, lo, hi, 0):
                counts = None
                if child == b"stts" and len(payload) >= 8:
                    n = struct.unpack_from(">I", payload, 4)[0]
                    counts = int(np.frombuffer(payload[8 : 8 + min(n, (len(payload) - 8) // 8) * 8], ">u4")[::2].sum(dtype=np.int64))
                yield path, size, None if child == b"mvhd" else track, child.decode(), None if child == b"stts" else payload, counts


def _batches(batches: Iterator[pa.RecordBatch], opened) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("track", pa.int32()), ("kind", pa.string()), ("payload", pa.binary()), ("samples", pa.int64())])
    for b in batches:
        for k in range(b.num_rows):
            with opened(b, k) as f:
                rows = list(_rows(b.column(0)[k].as_py(), f, f.seek(0, io.SEEK_END)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def boxes(files: DataFrame) -> DataFrame:
    """Rows of boxes of files whose content is at hand: (path, content)."""
    return files.select("path", "content").mapInArrow(lambda it: _batches(it, lambda b, k: io.BytesIO(b.column(1)[k].as_py() or b"")), BOXES)


def read_boxes(spark: SparkSession, folder: str, names: str = "*.{mp4,mov,m4v,m4a}") -> DataFrame:
    """Rows of boxes of the files below a folder, of which heads and a few payloads alone are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder).select("path")

    def opened(b: pa.RecordBatch, k: int) -> BinaryIO:
        path = b.column(0)[k].as_py()
        fs, at = (pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("file:", "/")) else pa.fs.FileSystem.from_uri(path)
        return fs.open_input_file(at)

    return listed.mapInArrow(lambda it: _batches(it, opened), BOXES)


def _number(payload: Column, at: int, size: int = 4) -> Column:
    """The unsigned number of ``size`` bytes at a place of a payload."""
    return F.conv(F.hex(F.substring(payload, at + 1, size)), 16, 10).cast("long")


def _name(payload: Column, at: int) -> Column:
    """Four characters of a payload; what can't be printed is a dot."""
    return F.regexp_replace(F.decode(F.substring(payload, at + 1, 4), "ISO-8859-1"), r"[^\x21-\x7E]", ".")


def tracks(found: DataFrame) -> DataFrame:
    """(path, track, id, kind, width, height, codec, samples) of each track, from rows of boxes."""
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    p = F.col("payload")
    long_form = F.substring(p, 1, 1) == F.lit(b"\x01")
    ids = F.when(long_form & (F.length(p) >= 24), _number(p, 20)).when(~long_form & (F.length(p) >= 16), _number(p, 12))
    end = lambda n: F.when(F.length(p) >= 12, F.shiftright(F.conv(F.hex(F.substring(p, -n, 4)), 16, 10).cast("long"), 16))
    first = F.when((F.length(p) >= 16) & ((_number(p, 8) == 0) | (_number(p, 8) >= 8) & (_number(p, 8) + 8 <= F.length(p))), _name(p, 12))
    t = found.where("track IS NOT NULL").groupBy("path", "track").agg(
        F.coalesce(of("tkhd", ids), F.lit(0)).alias("id"), F.coalesce(of("hdlr", F.when(F.length(p) >= 12, _name(p, 8))), F.lit("")).alias("kind"), F.coalesce(of("tkhd", end(8)), F.lit(0)).alias("width"),
        F.coalesce(of("tkhd", end(4)), F.lit(0)).alias("height"), F.coalesce(of("stsd", first), F.lit("")).alias("codec"), F.coalesce(F.max("samples"), F.lit(0)).alias("samples"),
    )
    return t


def media_info(found: DataFrame) -> DataFrame:
    """One row a file: brand, duration, its first video track's size, codec and frames a second, what it has, and whether and how it is damaged."""
    p = F.col("payload")
    has = lambda kind: F.count_if(F.col("kind") == kind) > 0
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    long_form = (F.substring(p, 1, 1) == F.lit(b"\x01")) & (F.length(p) >= 32)
    scale = F.when(long_form, _number(p, 20)).when(F.length(p) >= 20, _number(p, 12))
    length = F.when(long_form, _number(p, 24, 8)).when(F.length(p) >= 20, _number(p, 16))
    files = found.groupBy("path").agg(
        F.max("size").alias("size"), has("box").alias("has_box"), has("moov").alias("has_moov"), of("ftyp", F.when(F.length(p) >= 8, _name(p, 0))).alias("brand"),
        F.coalesce(of("mvhd", scale), F.lit(0)).alias("timescale"), F.coalesce(of("mvhd", length), F.lit(0)).alias("duration"),
    )
    own = F.struct("track", "width", "height", "codec", "samples")
    t = tracks(found).groupBy("path").agg(F.count("*").alias("n_tracks"), F.min(F.when(F.col("kind") == "vide", own)).alias("video"), (F.count_if(F.col("kind") == "soun") > 0).alias("has_audio"))
    seconds = F.when(F.col("timescale") > 0, F.col("duration") / F.col("timescale")).otherwise(0.0)
    reason = (
        F.when(F.col("size") < 12, "too short").when(~F.col("has_box"), "no box").when(~F.col("has_moov"), "no moov")
        .when(F.coalesce("n_tracks", F.lit(0)) == 0, "no tracks").when(F.col("duration") == 0, "no duration")
    )
    j = files.join(t, "path", "left")
    return j.select(
        "path", "size", "brand", "timescale", "duration", F.round(seconds, 3).alias("seconds"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), F.col("video.width").alias("width"), F.col("video.height").alias("height"), F.col("video.codec").alias("codec"),
        F.when((seconds > 0) & (F.col("video.samples") > 0), F.round(F.col("video.samples") / seconds, 2)).alias("fps"), F.col("video").isNotNull().alias("has_video"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"), reason.isNotNull().alias("damaged"), reason.alias("reason"),
    )
