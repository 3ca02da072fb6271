"""Removal of long repeated strings by prefix-free parsing.

A rolling hash over ``TRIGGER_BYTES`` marks triggers, and each text is parsed into phrases that run from
one trigger to the end of the next. As a trigger depends on nothing but its own bytes, equal strings are
parsed alike wherever they stand. From the phrases the order of all suffixes follows in parts, and only
as far as ``LENGTH`` bytes, since all that is asked is which suffixes agree that far:

1. Dictionary. Phrases are named and counted over the corpus. A suffix whose first ``LENGTH`` bytes hold
   a phrase that occurs once agrees with no other and is out.
2. Parse. All suffixes that begin between two triggers share their way through the parse; the string
   that covers them is sorted among all such strings. Where two are equal, all suffixes in them
   agree with one another.
3. Where both meet. A string of step 2 that occurs as often as one of its phrases is done with, as every
   place of the phrase is a place of the string. For the others, which stand where repeats begin, end or
   branch, the suffixes themselves are sorted by their first ``LENGTH`` bytes (one place of each
   repeated string stands for all of them).

Sorting is by 128-bit digests (XXH3, not made against texts built to collide), range by range of the
digests, and neighbours are compared; equality is all that counts. Names of phrases are 64-bit; two that
collide only leave more to sort. Texts are never shuffled: they are stored once in the shared folder
with the number of their bucket, ``BUCKET_BYTES`` of text each, whatever the split of the files; a bucket
sends each name about once, however often it holds it, and reads back the counts of its own names as
sorted arrays. So a passage in a third of all texts costs a row for each bucket, and what a task holds
depends on the size of a bucket and of its longest text alone.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that repeat a text
repeat its strings, whatever their ids (so both lose them, and of equal texts none is left whole); texts
without triggers (such as a short pattern over and over) go through step 3 as a whole; a very long text
is a bucket of its own, parsed at once and sorted ``BLOCK`` suffixes at a time; an empty table gives an
empty one; extra columns may have any name, that of the bucket too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftwork.llm.common import arrow_rows, file_system, fresh, schema_of, shared_path, stored, text_buffers, text_chunks, tidy
from weftwork.llm.decontaminate import WordTable

LENGTH = 400
TRIGGER_BYTES = 16
#: A place is a trigger with a chance of one in so many.
TRIGGER_ODDS = 48
ABSENT = 2**62
#: Text of a bucket, and of one step of numpy.
BUCKET_BYTES, STEP_BYTES = 32 << 20, 512 << 10
#: Strings that are digested at a time, and digests that a task gathers before it hands them on.
BLOCK, MOST_HELD = 1 << 15, 1 << 19

_TABLE = WordTable()


class Parse:
    """Triggers and phrases of a run of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off = data, off
        w, n = TRIGGER_BYTES, len(data)
        if n >= w:
            at = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))  # eight bytes from each place
            h = at[: n - w + 1] * np.uint64(0x9E3779B97F4A7C15)
            h += at[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            place = np.flatnonzero(h < np.uint64(2**64 // TRIGGER_ODDS))
        else:
            place = np.zeros(0, np.int64)
        doc = np.searchsorted(off, place, "right") - 1
        inside = place + w <= off[doc + 1]
        self.triggers, self.doc = place[inside], doc[inside]
        same = self.doc[:-1] == self.doc[1:]
        #: A phrase is numbered as its first trigger; only those with both triggers in one text are phrases.
        self.is_phrase = np.append(same, False) if len(self.doc) else same
        self.ends = np.append(self.triggers[1:], 0) + w if len(self.doc) else self.triggers
        names = np.zeros(len(self.doc), np.uint64)
        p = self.is_phrase
        if p.any():
            names[p] = _TABLE.of(data, self.triggers[p], self.ends[p])
        self.names = names.view(np.int64)


def runs(parse: Parse, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of suffixes that may be repeated: first and last start, start of the string over them, and the count of their rarest common phrase.

    counts: of each phrase in the corpus.
    """
    data, off, t = parse.data, parse.off, parse.triggers
    n = len(data)
    depth = np.zeros(n + 1, np.int32)
    # starts too near to the end of their text
    size = np.diff(off)
    close = np.maximum(off[1:] - LENGTH + 1, off[:-1])
    np.add.at(depth, close[size > 0], 1)
    np.add.at(depth, off[1:][size > 0], -1)
    # starts whose string holds a phrase that occurs once
    lone = parse.is_phrase & (counts < 2) & (parse.ends - t <= LENGTH)
    np.add.at(depth, np.maximum(parse.ends[lone] - LENGTH, off[parse.doc[lone]]), 1)
    np.add.at(depth, t[lone] + 1, -1)
    may = np.zeros(n + 1, bool)
    may[:-1] = np.cumsum(depth[:-1]) == 0
    trigger = np.zeros(n + 1, bool)
    trigger[t] = True
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    before, trigger_before = np.append(False, may[:-1]), np.append(False, trigger[:-1])
    first = np.flatnonzero(may & (~before | trigger_before | begins))
    last = np.flatnonzero(may & (~np.append(may[1:], False) | trigger | np.append(begins[1:], True)))
    wider = first - (trigger_before[first] & ~begins[first])
    # phrases within every one of the run's strings: from the last start to the first string's end
    rarest = np.full(len(first), ABSENT, np.int64)
    if len(t) and len(first):
        lo = np.searchsorted(t, last)
        hi = np.searchsorted(t + TRIGGER_BYTES, first + LENGTH, "right") - 1  # the last trigger that ends within
        held = np.where(parse.is_phrase, counts, ABSENT)
        some = np.flatnonzero(hi > lo)
        if len(some):
            cut = np.column_stack([lo[some], hi[some]]).ravel()
            rarest[some] = np.minimum.reduceat(np.append(held, ABSENT), cut)[::2]
    return first, last, wider, rarest


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys another key begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def repeated(rows: DataFrame, key: list[str], parts: int) -> DataFrame:
    """(key, bucket, count, first) of keys that occur twice or more in all; ``first`` marks one bucket of each key.

    A bucket may send a key in several rows and gets one row back. Rows are dealt and sorted by key and
    bucket and neighbours compared, a batch at a time. Of the key that is open at the end of a batch, a
    task holds one row for each bucket.
    """
    names = [*key, "bucket", "count", "first"]
    out = ", ".join(f"{k} long" for k in key) + ", bucket long, count long, first boolean"

    def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
        *keys, bucket, n = cols
        start = np.flatnonzero(new := _new(*keys))
        run = np.cumsum(new) - 1
        keep = np.add.reduceat(n, start)[run] >= 2
        total = np.add.reduceat(n, start)[run][keep]
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (*keys, bucket)), pa.array(total), pa.array(new[keep])], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in (*key, "bucket", "n")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            start = np.flatnonzero(_new(*cols[:-1]))
            cols = [*(c[start] for c in cols[:-1]), np.add.reduceat(cols[-1], start)]
            cut = int(np.flatnonzero(_new(*cols[: len(key)]))[-1])
            if cut:
                yield settle([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield settle(held)

    return rows.repartition(parts, *key).sortWithinPartitions(*key, "bucket").mapInArrow(tidy(compare), out)


class Names:
    """Counts of a bucket's names, read from the shared folder for the bucket that is at hand."""

    def __init__(self, folder: str, columns: list[str]) -> None:
        self.fs, self.root = file_system(folder)
        self.columns, self.bucket, self.table = columns, None, None

    def of(self, bucket: int) -> list[np.ndarray]:
        if bucket != self.bucket:
            at = pa.fs.FileSelector(f"{self.root}/bucket={bucket}", allow_not_found=True)
            parts = [pq.read_table(self.fs.open_input_file(f.path), columns=self.columns) for f in self.fs.get_file_info(at) if f.path.endswith(".parquet")]
            self.table = [np.concatenate([p.column(c).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in self.columns]
            self.bucket = bucket
        return self.table


def _put(rows: DataFrame, what: str, parts: int) -> str:
    """Written by bucket to the shared folder; the place."""
    path = shared_path(rows.sparkSession, what)
    rows.repartition(parts, "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def _by_bucket(b: pa.RecordBatch, bucket_col: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch that are of one bucket each."""
    bucket = b.column(bucket_col).to_numpy()
    cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi > lo:
            yield int(bucket[lo]), b.slice(lo, hi - lo)


def _lookup(names: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of names, 1 for those not among the known (sorted)."""
    if not len(known):
        return np.ones(len(names), np.int64)
    i = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[i] == names, counts[i], 1)


class Phrases(Names):
    def __init__(self, folder: str) -> None:
        super().__init__(folder, ["h", "count"])

    def counts(self, bucket: int, parse: Parse) -> np.ndarray:
        if bucket != self.bucket:
            h, c = self.of(bucket)
            order = np.argsort(h, kind="stable")
            self.table = [h[order], c[order]]
        return _lookup(parse.names, *self.table)


class Digests(Names):
    """Digests of a bucket that occur twice or more, with their counts and whether this bucket stands for them."""

    def __init__(self, folder: str) -> None:
        super().__init__(folder, ["d1", "d2", "count", "first"])

    def find(self, bucket: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of digests, 1 for those that occur once, and whether this bucket stands for them (for such it does)."""
        if bucket != self.bucket:
            cols = self.of(bucket)
            order = np.lexsort((cols[1], cols[0]))
            self.table = [c[order] for c in cols]
        d1, d2, c, first = self.table
        count, stands = np.ones(len(d), np.int64), np.ones(len(d), bool)
        at, open_ = np.searchsorted(d1, d[:, 0]), np.arange(len(d))
        while len(open_):  # one step but where first halves are equal
            here = at < len(d1)
            at, open_ = at[here], open_[here]
            here = d1[at] == d[open_, 0]
            at, open_ = at[here], open_[here]
            hit = d2[at] == d[open_, 1]
            count[open_[hit]], stands[open_[hit]] = c[at[hit]], first[at[hit]].astype(bool)
            at, open_ = at[~hit] + 1, open_[~hit]
        return count, stands


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of strings, as rows of two longs."""
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(starts), BLOCK):
        some = zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)
        found.append(np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in some]), np.int64).reshape(-1, 2))
    return np.concatenate(found)


class Tally:
    """Names of a bucket with the number of their places, summed as they come; rows are handed on once they are many, or when the bucket ends."""

    def __init__(self, columns: list[str]) -> None:
        self.columns, self.held, self.size = columns, [], 0

    def add(self, bucket: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append([*keys, np.ones(len(keys[0]), np.int64)])
        self.size += len(keys[0])
        if self.size > MOST_HELD:
            self.sum()
            if self.size > MOST_HELD // 2:
                yield from self.rows(bucket)

    def sum(self) -> None:
        *keys, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        keys = [k[order] for k in keys]
        start = np.flatnonzero(_new(*keys))
        self.held = [[*(k[start] for k in keys), np.add.reduceat(n[order], start) if len(start) else n]]
        self.size = len(start)

    def rows(self, bucket: int) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.sum()
            *keys, n = self.held[0]
            for k in range(0, self.size, BLOCK):
                part = slice(k, k + BLOCK)
                size = len(n[part])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in keys), pa.array(np.full(size, bucket)), pa.array(n[part])], names=[*self.columns, "bucket", "n"])
        self.held, self.size = [], 0


def tallied(columns: list[str], batches: Iterator[pa.RecordBatch], keys: Callable[[int, pa.Array], Iterator[list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Rows (names, bucket, n) of batches (text, bucket)."""
    tally, last = Tally(columns), None
    for batch in batches:
        for bucket, b in _by_bucket(batch, 1):
            if bucket != last and last is not None:
                yield from tally.rows(last)
            last = bucket
            for k in keys(bucket, b.column(0)):
                yield from tally.add(bucket, k)
    if last is not None:
        yield from tally.rows(last)


def _spread(first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """All places from each first to its last, ``BLOCK`` at a time."""
    ends = np.cumsum(last - first + 1)
    for a in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
        k = np.arange(a, min(a + BLOCK, int(ends[-1])))
        run = np.searchsorted(ends, k, "right")
        yield last[run] - (ends[run] - 1 - k)


def bucketed(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """The documents, stored, with the number of their bucket as the last column, and how many buckets there are."""
    (name,) = fresh(docs, "bucket")
    columns = [*docs.columns, name]
    out, k = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]), columns.index(text_col)

    def number(batches):
        first, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ends = size + np.cumsum(np.diff(text_buffers(b.column(k))[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + np.append(size, ends[:-1])[: b.num_rows] // BUCKET_BYTES)], names=columns)
            size = int(ends[-1]) if len(ends) else size

    x = stored(docs.mapInArrow(tidy(number), out), "texts")
    return x, x.select(name).distinct().count()


def repeats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Callable]:
    """The stored documents with their bucket (last column), and a function that gives for a batch of one bucket its chunks with a mask of the bytes to be removed."""
    x, n_buckets = bucketed(docs, text_col)
    texts = x.select(text_col, x.columns[-1])
    parts = max(n_buckets, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name, pair = "h long, bucket long, n long", "d1 long, d2 long, bucket long, n long"

    def name_phrases(batches):
        def keys(bucket, col):
            for _, _, data, off in text_chunks(col, STEP_BYTES):
                p = Parse(data, off)
                yield [p.names[p.is_phrase]]

        yield from tallied(["h"], batches, keys)

    phrases_at = _put(repeated(texts.mapInArrow(tidy(name_phrases), name), ["h"], parts), "phrases", parts)

    def name_strings(batches):
        phrases = Phrases(phrases_at)

        def keys(bucket, col):
            for _, _, data, off in text_chunks(col, STEP_BYTES):
                p = Parse(data, off)
                _, last, wider, _ = runs(p, phrases.counts(bucket, p))
                d = digests(data.tobytes(), wider, last + LENGTH)
                yield [d[:, 0], d[:, 1]]

        yield from tallied(["d1", "d2"], batches, keys)

    strings_at = _put(repeated(texts.mapInArrow(tidy(name_strings), pair), ["d1", "d2"], parts), "strings", parts)

    def judged(col: pa.Array, bucket: int, phrases: Phrases, strings: Digests):
        """Chunks with their runs, whether each run is repeated as a whole, and whether its suffixes are to be sorted."""
        for lo, hi, data, off in text_chunks(col, STEP_BYTES):
            p, raw = Parse(data, off), data.tobytes()
            first, last, wider, rarest = runs(p, phrases.counts(bucket, p))
            count, stands = strings.find(bucket, digests(raw, wider, last + LENGTH))
            yield lo, hi, data, raw, off, first, last, wider, count >= 2, (count < rarest) & stands

    def name_suffixes(batches):
        phrases, strings = Phrases(phrases_at), Digests(strings_at)

        def keys(bucket, col):
            for _, _, _, raw, _, first, last, _, _, sort in judged(col, bucket, phrases, strings):
                for starts in _spread(first[sort], last[sort]):
                    d = digests(raw, starts, starts + LENGTH)
                    yield [d[:, 0], d[:, 1]]

        yield from tallied(["d1", "d2"], batches, keys)

    suffixes_at = _put(repeated(texts.mapInArrow(tidy(name_suffixes), pair), ["d1", "d2"], parts), "suffixes", parts)

    def marked(b: pa.RecordBatch, k: int, bucket: int, held: list):
        if not held:
            held += [Phrases(phrases_at), Digests(strings_at), Digests(suffixes_at)]
        phrases, strings, suffixes = held
        for lo, hi, data, raw, off, first, last, wider, whole, sort in judged(b.column(k), bucket, phrases, strings):
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, wider[whole], 1)
            np.add.at(cover, last[whole] + LENGTH, -1)
            own = sort & ~whole
            for starts in _spread(first[own], last[own]):
                hit = starts[suffixes.find(bucket, digests(raw, starts, starts + LENGTH))[0] >= 2]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + LENGTH, -1)
            yield lo, hi, data, off, np.cumsum(cover[:-1]) > 0

    return x, marked


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and SHA-256 of what is left."""
    x, marked = repeats(docs.select(id_col, text_col), text_col)
    out = T.StructType([*schema_of(docs, id_col), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def measure(batches):
        held: list = []
        for batch in batches:
            for bucket, b in _by_bucket(batch, 2):
                for lo, hi, data, off, gone in marked(b, 1, bucket, held):
                    sums = np.append(0, np.cumsum(gone))
                    begin = gone & ~np.append(False, gone[:-1])
                    begin[off[:-1][off[:-1] < len(gone)]] = gone[off[:-1][off[:-1] < len(gone)]]
                    spans = np.append(0, np.cumsum(begin))
                    kept = data[~gone].tobytes()
                    at = off - sums[off]
                    yield arrow_rows({id_col: b.column(0).slice(lo, hi - lo), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(sums[off])), "n_spans": pa.array(np.diff(spans[off])), "kept_sha256": [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}, out)

    return x.mapInArrow(tidy(measure), out)


def without(docs: DataFrame, x: DataFrame, marked: Callable, text_col: str, chars_col: str | None) -> DataFrame:
    """The documents without the bytes that are marked in ``x``, which has their columns and maybe others, and the bucket as the last one; ``chars_col`` is set to the new length where a text changed."""
    k, out, names = docs.columns.index(text_col), docs.schema, docs.columns
    chars, bucket_col = chars_col if chars_col in names else None, len(x.columns) - 1

    def cut(batches):
        held: list = []
        for batch in batches:
            for bucket, b in _by_bucket(batch, bucket_col):
                for lo, hi, data, off, gone in marked(b, k, bucket, held):
                    own = {c: b.column(i).slice(lo, hi - lo) for i, c in enumerate(names)}
                    sums = np.append(0, np.cumsum(gone))
                    if sums[-1]:
                        kept, at = data[~gone].tobytes(), off - sums[off]
                        texts = own[text_col].to_pylist()
                        sizes = own[chars].to_pylist() if chars else []
                        for d in np.flatnonzero(np.diff(sums[off])).tolist():
                            texts[d] = kept[at[d] : at[d + 1]].decode("utf-8", "ignore")
                            if chars:
                                sizes[d] = len(texts[d])
                        own[text_col] = texts
                        if chars:
                            own[chars] = sizes
                    yield arrow_rows(own, out)

    return x.mapInArrow(tidy(cut), out)


def remove_repeats(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated strings cut out of their texts; ``chars_col`` is set to the new length where a text changed.

    A cut may fall inside a character; what is left of that character goes too. A null text stays null.
    """
    x, marked = repeats(docs, text_col)
    return without(docs, x, marked, text_col, chars_col)
