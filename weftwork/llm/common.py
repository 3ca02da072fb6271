"""What the operators share: Arrow text buffers, word spans in numpy, folds, shared storage."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.operators.relations import join_split  # noqa: F401  the other modules take it from here

#: Bytes of text that one numpy step works on; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20
#: And texts, where they are short.
CHUNK_ROWS = 4096

#: Word bytes. All non-word characters of both word patterns are ASCII, so words can be found on UTF-8 bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def text_chunks(col: pa.Array, most: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts, of about ``most`` bytes and ``most_rows`` texts at most."""
    data, off = text_buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, lo + most_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end)."""
    m = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def fold(df_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod ``parts``; a null id is in no fold."""
    return F.crc32(df_id.cast("string")) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table does not have."""
    has, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in has:
            n = "_" + n
        has.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where Spark runs in one process (tests) may it be unset; it is then a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths in the shared folder that this process made: of each open scratch, and (first) of none.
_MADE: list[list[str]] = [[]]


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what lies there goes when the scratch that is open ends, or else with the session's process."""
    if not _MADE[0] and len(_MADE) == 1:
        atexit.register(_at_end, spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE[-1].append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes what nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for made in _MADE:
            if path in made:
                made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored inside goes at the end; results must be written or collected by then."""
    _MADE.append([])
    try:
        yield
    finally:
        discard(spark, *_MADE[-1][:])
        _MADE.pop()


def _at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark, *(p for made in _MADE for p in made[:]))
    except Exception:  # noqa: BLE001 - the session is gone already, and with it the way to delete
        pass


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and later steps do not run it again."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(at: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder named as Spark names it, and the folder's path in it."""
    if re.match(r"^(file:|/)", at):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", at)
    return pa.fs.FileSystem.from_uri(at)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of batches; at its end, free memory goes back to the system, since a worker lives on and other stages need it."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return run


def schema_of(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def arrow_rows(columns: dict[str, object], schema: T.StructType) -> pa.RecordBatch:
    """A batch with the schema's names and Arrow types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([a if isinstance(a := columns[f.name], pa.Array) and a.type == f.type else (a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type)) for f in want], schema=want)
