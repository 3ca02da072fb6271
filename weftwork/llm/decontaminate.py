"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards of about ``CHUNK_BYTES`` and builds the word-level suffix array
of each: all words of the shard become numbers, documents are set apart by a number that no word has,
and all suffixes are put in order by repeated doubling, as deep as a window or deeper. Every suffix of
every benchmark item is then looked up by binary search: the suffixes of the shard that begin with its
first ``window`` words lie side by side, and their words are hit. ``find_matches`` follows each of them
word by word to its full length; ``summary`` and ``decontaminate`` mark the words alone, which are the
same. Windows that stand several times in a block of the benchmark are looked up once, and what is found stays
an interval of the array: words are marked by a difference array over its ranks, so repeats on both sides
cost their sum and never their product. Word numbers come from 64-bit hashes; where a shard's words are
numbered, each is compared byte by byte with the first of its number, and the benchmark's words with that one, so equal
numbers are equal words.

Documents never leave their task, so there is no shuffle, and a document in which a passage is common
costs no other task anything. The benchmark is stored once in the shared folder; tasks read it from there
in blocks of ``block_bytes`` of text and look each block up in all shards that they hold, so neither a
broadcast nor a task grows with the benchmark. A worker keeps the block that it met last.

Edge cases: a null or empty text has no words; an item without words, or with a null id, is never
found; an item of fewer words than a window is looked up as a whole; rows with the same doc_id are
judged one by one; items that share an id count once; a very long text is a shard of its own; an empty
table gives an empty one, and without items nothing is hit; extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import ALNUM, LOWER, arrow_rows, file_system, fresh, schema_of, shared_path, text_chunks, tidy, word_spans

WINDOW = 10
#: Text of one block of the benchmark, and the shards that a task holds against a block.
BLOCK_BYTES, MOST_SHARDS = 4 << 20, 8
#: Bytes of words that are compared with the first of their number at a time.
CHECK_BYTES = 1 << 20


class WordTable:
    """64-bit fingerprints of words, from running sums of powers, for whole buffers at once."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.inverse = pow(self.BASE, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            full = np.full(n - 1, 1, np.uint64)
            full[:] = self.BASE
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(full, dtype=np.uint64)])
            full[:] = self.inverse
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(full, dtype=np.uint64)])

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return h ^ (h >> np.uint64(31)) ^ ((ends - starts).astype(np.uint64) << np.uint64(1))


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at``, ordered by the numbers (0 or more) that follow in ``seq``, ``depth`` of them at least.

    Each round doubles the depth and orders only those that are still equal; a rank is the number of the
    first of its equals.
    """
    n = len(seq)
    reach = 2
    rank = np.zeros(n + 2 * depth + 2, np.int64)
    rank[:n] = seq
    key = rank[at] * (int(seq.max(initial=0)) + 1) + rank[at + 1]
    order = np.argsort(key, kind="stable")
    array, key = at[order], key[order]
    while len(array):
        new = np.ones(len(array), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        rank[:] = 0
        rank[array] = first
        open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
        if reach >= depth or not len(open_):
            break
        places = array[open_]
        after = rank[np.minimum(places + reach, len(rank) - 1)]
        order = np.lexsort((after, first[open_]))
        array[open_] = places[order]
        key = first * (len(array) + 2)
        key[open_] += after[order]
        reach *= 2
    return array


class Shard:
    """A run of documents with its suffix array."""

    def __init__(self, data: np.ndarray, off: np.ndarray, depth: int) -> None:
        self.data = LOWER[data]
        self.starts, self.ends, self.first = word_spans(self.data, off, ALNUM)
        h = _TABLE.of(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.words, self.example, number = np.unique(h, return_index=True, return_inverse=True)
        self.raw = self.data.tobytes()
        #: Words whose hash is that of another one, by their text; they get numbers of their own.
        self.odd: dict[bytes, int] = {}
        for w in self._unlike(number).tolist():
            number[w] = self.odd.setdefault(self.text(w), len(self.words) + len(self.odd))
        doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        #: Word numbers from 1, with a 0 after each document, and at the end as many as a comparison may read.
        self.place = np.arange(len(h)) + doc
        self.seq = np.zeros(len(h) + len(off) + depth, np.int32)
        self.seq[self.place] = number + 1
        self.array = suffix_array(self.seq, self.place, depth)
        self.word = np.zeros(len(self.seq), np.int64)
        self.word[self.place] = np.arange(len(h))

    def text(self, word: int) -> bytes:
        return self.raw[self.starts[word] : self.ends[word]]

    def _unlike(self, number: np.ndarray) -> np.ndarray:
        """Words that differ from the first word of their number."""
        size, like = self.ends - self.starts, self.example[number]
        out = [np.flatnonzero(size != size[like])]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):  # about a megabyte of words at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHECK_BYTES, "right")))
            n, other = size[lo:hi], like[lo:hi]
            n = np.minimum(n, size[other])
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bad = self.data[np.repeat(self.starts[lo:hi], n) + inside] != self.data[np.repeat(self.starts[other], n) + inside]
            out.append(np.unique(np.repeat(np.arange(lo, hi), n)[bad]))
            lo = hi
        return np.unique(np.concatenate(out))

    def numbers(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Word numbers of words with these hashes, 0 for words that are not in the shard."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            for k in np.flatnonzero(self.words[i] == hashes).tolist():
                out[k] = i[k] + 1 if self.text(self.example[i[k]]) == words[k] else self.odd.get(words[k], -1) + 1
        return out

    def bound(self, wanted: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """For rows of word numbers: the first suffix that is not less than the row's first ``length`` words, or (``after``) that is greater."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.array))
        inside = np.arange(wanted.shape[1]) < length[:, None]
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            d = self.seq[self.array[mid][:, None] + np.arange(wanted.shape[1])] - wanted[live]
            d[~inside[live]] = 0
            d = d[np.arange(len(live)), np.argmax(d != 0, axis=1)]  # the first difference, or 0
            right = d <= 0 if after else d < 0
            lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]
        return lo


class Benchmark:
    """One block of the benchmark: its words and the first words of its suffixes."""

    def __init__(self, ids: list, texts: list[str], window: int) -> None:
        words: list[list[bytes]] = []
        for t in texts:
            data = LOWER[np.frombuffer(t.encode(), np.uint8)]
            s, e, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            raw = data.tobytes()
            words.append([raw[a:b] for a, b in zip(s, e, strict=True)])
        kept = [(i, w) for i, w in zip(ids, words, strict=True) if w and i is not None]
        self.ids, words = [i for i, _ in kept], [w for _, w in kept]
        number: dict[bytes, int] = {}
        flat = [number.setdefault(x, len(number)) for w in words for x in w]
        self.texts = list(number)
        ends = np.cumsum([len(x) for x in number], dtype=np.int64)
        self.hashes = _TABLE.of(np.frombuffer(b"".join(number), np.uint8), np.append(0, ends[:-1]), ends) if number else np.zeros(0, np.uint64)
        #: The items' words, one after the other, and where each item begins.
        self.flat, self.sizes = np.array(flat, np.int64), np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        size = np.minimum(window, self.sizes)
        per = self.sizes - size + 1
        item = np.repeat(np.arange(len(per)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        every = np.append(self.flat, np.full(window, -1))[(self.begin[item] + at)[:, None] + np.arange(window)]
        every[np.arange(window) >= size[item][:, None]] = -1
        #: Distinct windows, their lengths, and the (item, place) pairs of each, side by side.
        self.rows, which = _distinct(every)
        self.length = (self.rows >= 0).sum(axis=1)
        order = np.argsort(which, kind="stable")
        self.item, self.at = item[order], at[order]
        self.first = np.searchsorted(which[order], np.arange(len(self.rows) + 1))
        #: Sets of items: that of each item alone, then those of windows of several items. Windows with the same items have the same set.
        n = max(1, len(per))
        pair = np.unique(which * n + item)
        first = np.searchsorted(pair // n, np.arange(len(self.rows) + 1))
        self.sets: list[tuple] = [(i,) for i in range(len(per))]
        self.set_of = pair[first[:-1]] % n
        known: dict[tuple, int] = {}
        for k in np.flatnonzero(np.diff(first) > 1).tolist():
            items = tuple((pair[first[k] : first[k + 1]] % n).tolist())
            self.set_of[k] = known.setdefault(items, len(self.sets))
            if len(self.sets) == self.set_of[k]:
                self.sets.append(items)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, which of them each row is): by a 64-bit key, that is checked, else by the rows themselves."""
    key = (rows.astype(np.uint64) * (np.random.default_rng(11).integers(1, 2**63, rows.shape[1], dtype=np.uint64) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    if (rows[at[which]] == rows).all():
        return rows[at], which
    out, which = np.unique(rows, axis=0, return_inverse=True)
    return out, which.reshape(-1)


_TABLE = WordTable()


def shard_intervals(b: Benchmark, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first rank, rank after the last) of the windows that occur, and the shard's numbers of the block's words."""
    number = shard.numbers(b.hashes, b.texts)
    none = np.zeros(0, np.int64)
    if not len(b.rows) or not len(shard.array):
        return none, none, none, number
    inside = b.rows >= 0
    wanted = np.where(inside, number[b.rows], 0)
    # a window is looked up if the shard has all its words
    w = np.flatnonzero(((wanted > 0) | ~inside).all(axis=1))
    if not len(w):
        return none, none, none, number
    lo, hi = (shard.bound(wanted[w], b.length[w], after) for after in (False, True))
    some = hi > lo
    return w[some], lo[some], hi[some], number


def ranks(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, rank) of all ranks of intervals."""
    n = hi - lo
    return np.repeat(np.arange(len(lo)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def shard_hits(b: Benchmark, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit, and (document, set of items) pairs of what is found, each once."""
    w, lo, hi, _ = shard_intervals(b, shard)
    hit = np.zeros(len(shard.starts) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for size in np.unique(b.length[w]):  # intervals of windows of one length don't overlap
        own = b.length[w] == size
        which, rank = ranks(lo[own], hi[own])
        at = shard.word[shard.array[rank]]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        doc = np.searchsorted(shard.first, at, "right") - 1
        pairs.append(np.unique(doc * len(b.sets) + b.set_of[w[own]][which]))
    pair = np.unique(np.concatenate(pairs))
    return np.cumsum(hit) > 0, pair // max(1, len(b.sets)), pair % max(1, len(b.sets))


class Blocks:
    """The stored benchmark, block by block (an item alone may be longer than a block); the block read last is kept."""

    last: tuple = (None, None)

    def __init__(self, folder: str, window: int, block_bytes: int) -> None:
        self.folder, self.window, self.block_bytes = folder, window, block_bytes

    def rows(self) -> Iterator[tuple[list, list[str]]]:
        fs, root = file_system(self.folder)
        ids, texts, size = [], [], 0
        for f in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda f: f.path):
            if not f.path.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(fs.open_input_file(f.path)).iter_batches(256):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = len(t.encode())
                    if ids and size + n > self.block_bytes:
                        yield ids, texts
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += n
        if ids:
            yield ids, texts

    def __iter__(self) -> Iterator[Benchmark]:
        """A benchmark of one block is read once by a worker; of a larger one, each time anew."""
        if Blocks.last[0] == self.folder:
            yield Blocks.last[1]
            return
        n = 0
        for n, (ids, texts) in enumerate(self.rows(), 1):  # noqa: B007
            b = Benchmark(ids, texts, self.window)
            yield b
        if n == 1:
            Blocks.last = (self.folder, b)


def _kept(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Blocks:
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    path = shared_path(benchmark.sparkSession, "benchmark")
    items.write.parquet(path)
    return Blocks(path, window, block_bytes)


def shards(col: pa.Array, window: int) -> Iterator[list[tuple[int, int, Shard]]]:
    """Shards of a batch of texts, ``MOST_SHARDS`` at a time, so that a block is read once for them all."""
    held = []
    for lo, hi, data, off in text_chunks(col):
        held.append((lo, hi, Shard(data, off, window)))
        if len(held) == MOST_SHARDS:
            yield held
            held = []
    if held:
        yield held


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: (document, item, first word in either, words), one row for each match that can't be longer."""
    out = T.StructType([*schema_of(docs, id_col), T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("n_words", T.LongType())])
    blocks = _kept(benchmark, item_col, item_text_col, window, block_bytes)

    def search(batches):
        for batch in batches:
            for held in shards(batch.column(1), window):
                for b in blocks:
                    for lo, _, shard in held:
                        row = _longest(b, shard)
                        if row["doc"]:
                            yield arrow_rows({id_col: batch.column(0).take(pa.array([lo + d for d in row.pop("doc")])), **row}, out)

    def _longest(b: Benchmark, shard: Shard) -> dict[str, list]:
        """Only pairs of places that can't begin a word earlier are made, which are the matches themselves."""
        row = {k: [] for k in ("doc", "item", "doc_start", "item_start", "n_words")}
        w, lo, hi, number = shard_intervals(b, shard)
        words = np.append(number[b.flat], 0)
        for k, low, high in zip(w.tolist(), lo.tolist(), hi.tolist(), strict=True):
            places = shard.array[low:high]
            before = np.where(places > 0, shard.seq[places - 1], 0)
            pairs = slice(b.first[k], b.first[k + 1])
            starts = b.begin[b.item[pairs]] + b.at[pairs]
            earlier = np.where(b.at[pairs] > 0, words[starts - 1], 0)
            for v in np.unique(earlier):
                for place in places[(before != v) | (before == 0)].tolist():
                    for i, j in zip(b.item[pairs][earlier == v].tolist(), b.at[pairs][earlier == v].tolist(), strict=True):
                        there = shard.seq[place : place + b.sizes[i] - j]
                        rest = words[b.begin[i] + j : b.begin[i] + b.sizes[i]][: len(there)]
                        same = (rest == there) & (rest > 0)
                        p = int(shard.word[place])
                        d = int(np.searchsorted(shard.first, p, "right")) - 1
                        for name, x in zip(row, (d, b.ids[i], p - shard.first[d], j, len(rest) if same.all() else int(np.argmin(same))), strict=True):
                            row[name].append(x)
        return row

    return docs.select(id_col, text_col).mapInArrow(tidy(search), out)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The documents with all their columns, their number of words, the words hit and the items found; and these columns' names."""
    names = dict(zip(("n_words", "hit", "items"), fresh(docs, "n_words", "hit_words", "items"), strict=True))
    out = T.StructType([*docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["hit"], T.BinaryType()), T.StructField(names["items"], T.ArrayType(T.StringType()))])
    columns, k = docs.columns, docs.columns.index(text_col)
    blocks = _kept(benchmark, item_col, item_text_col, window, block_bytes)

    def search(batches):
        for batch in batches:
            for held in shards(batch.column(k), window):
                hit = [np.zeros(len(s.starts) + 1, bool) for _, _, s in held]
                items: list[dict[int, set]] = [{} for _ in held]
                for b in blocks:
                    for (_, _, s), h, found in zip(held, hit, items, strict=True):
                        words, doc, some = shard_hits(b, s)
                        h |= words
                        for d, one in zip(doc.tolist(), some.tolist(), strict=True):
                            found.setdefault(d, set()).update(str(b.ids[i]) for i in b.sets[one])
                for (lo, hi, s), h, found in zip(held, hit, items, strict=True):
                    own = {c: batch.column(i).slice(lo, hi - lo) for i, c in enumerate(columns)}
                    bits = [np.packbits(x).tobytes() if (x := h[s.first[d] : s.first[d + 1]]).any() else b"" for d in range(hi - lo)]
                    yield arrow_rows(own | {names["n_words"]: pa.array(np.diff(s.first)), names["hit"]: bits, names["items"]: [sorted(found.get(d, ())) for d in range(hi - lo)]}, out)

    return docs.mapInArrow(tidy(search), out), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    marked, names = mark(docs, benchmark, **kw)
    return marked.where(F.length(names["hit"]) == 0).select(*docs.columns)


def summary(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: words, words hit, items found, their digest, and whether anything was hit."""
    marked, names = mark(docs.select(id_col, text_col), benchmark, text_col=text_col, **kw)
    out = T.StructType([*schema_of(docs, id_col), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def digest(batches):
        for b in batches:
            items = b.column(names["items"]).to_pylist()
            n_hit = [int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in b.column(names["hit"]).to_pylist()]
            yield arrow_rows({id_col: b.column(id_col), "n_words": b.column(names["n_words"]), "n_hit": n_hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [n > 0 for n in n_hit]}, out)

    return marked.select(id_col, *names.values()).mapInArrow(tidy(digest), out)
