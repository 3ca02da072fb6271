"""Removal of passages of over ``WORDS`` - 1 words that several documents share.

Words are runs of other bytes than ASCII space; a window is ``WORDS`` words side by side in one text, the
white space between them aside. A window is shared if another row has it too; repeats inside one text
alone don't count. All words of shared windows go from every text that has them, each with the white
space after it. Windows are judged on the input, not on what is left.

1. Each window has an anchor: the least of the hashes of the runs of ``RUN`` words in it. Equal windows
   have equal anchors, and neighbours mostly have the same one, so a text has few. Anchors are counted by
   the number of texts that have them.
2. Only windows whose anchor several texts have are digested (128 bits, from running sums of the hashes of
   their words) and counted in the same way.

Texts are stored once in buckets and never shuffled; names are summed within a bucket, as in
``suffix_dedup``. So a passage in a third of all texts costs a row for each bucket, and a task holds what
one bucket names.

Edge cases: a null text stays null; texts of fewer words than a window stay as they are; rows that repeat
a text share its windows, whatever their ids; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from weftwork.llm.common import NOT_SPACE, text_chunks, tidy, word_spans
from weftwork.llm.decontaminate import WordTable
from weftwork.llm.suffix_dedup import STEP_BYTES, Digests, Phrases, _new, _put, bucketed, repeated, tallied, without

WORDS = 51
#: Words of the runs whose least hash is the anchor of a window.
RUN = 16
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)

_TABLE = WordTable()


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Hashes of runs of ``size`` hashes, from running sums of powers of ``base``."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, h: np.ndarray, size: int) -> np.ndarray:
        n = len(h)
        if len(self.up) < n + 1:
            for name, by in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n + 1, by, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], dtype=np.uint64, out=sums[1:])
        return _mixed((sums[size:] - sums[:-size]) * self.down[: n - size + 1], 0x9E3779B97F4A7C15)


_SUMS = [Sums(b) for b in BASES]


class Windows:
    """Windows of a run of texts: the word each begins with, its text and its anchor."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.off = off
        self.starts, ends, first = word_spans(data, off, NOT_SPACE)
        self.first = self.doc = np.zeros(0, np.int64)
        self.names = np.zeros(0, np.int64)
        if len(self.starts) < WORDS:
            return
        self.words = _mixed(_TABLE.of(data, self.starts, ends), 0xBF58476D1CE4E5B9)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        last = np.arange(WORDS - 1, len(doc))
        self.first = np.flatnonzero(doc[: len(last)] == doc[last])
        self.doc = doc[self.first]
        least, reach, runs = _SUMS[0].of(self.words, RUN), 1, WORDS - RUN + 1
        while reach < runs:
            step = min(reach, runs - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        self.names = least[self.first].view(np.int64)

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128-bit digests of some windows, as rows of two longs."""
        if not len(which):
            return np.zeros((0, 2), np.int64)
        at = self.first[which]
        one, two = _SUMS[0].of(self.words, WORDS), _SUMS[1].of(_mixed(self.words, 0x94D049BB133111EB), WORDS)
        return np.column_stack([one[at], two[at]]).view(np.int64)

    def bytes(self, which: np.ndarray, size: int) -> np.ndarray:
        """Mask of the bytes of some windows' words, each with the white space after it."""
        cover = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(cover, self.first[which], 1)
        np.add.at(cover, self.first[which] + WORDS, -1)
        word = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        text = np.searchsorted(self.off, self.starts[word], "right") - 1
        depth = np.zeros(size + 1, np.int64)
        np.add.at(depth, self.starts[word], 1)
        np.add.at(depth, np.minimum(np.append(self.starts, size)[word + 1], self.off[text + 1]), -1)
        return np.cumsum(depth[:-1]) > 0


def _once(doc: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """The keys, one of each for each text."""
    new = _new(doc, *keys)  # neighbours mostly have the same anchor
    doc, keys = doc[new], [k[new] for k in keys]
    order = np.lexsort((*keys[::-1], doc))
    doc, keys = doc[order], [k[order] for k in keys]
    new = _new(doc, *keys)
    return [k[new] for k in keys]


def shared(docs: DataFrame, text_col: str = "text", spare_col: str | None = None) -> tuple[DataFrame, Callable]:
    """The stored documents with their bucket (last column), and a function that gives for a batch of one bucket its chunks with a mask of the bytes to be removed.

    Texts for which ``spare_col`` is true lose nothing, but count where others are judged.
    """
    x, n_buckets = bucketed(docs, text_col)
    texts = x.select(text_col, x.columns[-1])
    parts = max(n_buckets, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spare = None if spare_col is None else x.columns.index(spare_col)

    def name_anchors(batches):
        def keys(bucket, col):
            for _, _, data, off in text_chunks(col, STEP_BYTES):
                w = Windows(data, off)
                if len(w.first):
                    yield _once(w.doc, w.names)

        yield from tallied(["h"], batches, keys)

    anchors_at = _put(repeated(texts.mapInArrow(tidy(name_anchors), "h long, bucket long, n long"), ["h"], parts), "anchors", parts)

    def name_windows(batches):
        anchors = Phrases(anchors_at)

        def keys(bucket, col):
            for _, _, data, off in text_chunks(col, STEP_BYTES):
                w = Windows(data, off)
                may = np.flatnonzero(anchors.counts(bucket, w) >= 2)
                if len(may):
                    d = w.digests(may)
                    yield _once(w.doc[may], d[:, 0], d[:, 1])

        yield from tallied(["d1", "d2"], batches, keys)

    windows_at = _put(repeated(texts.mapInArrow(tidy(name_windows), "d1 long, d2 long, bucket long, n long"), ["d1", "d2"], parts), "windows", parts)

    def marked(b, k: int, bucket: int, held: list):
        if not held:
            held += [Phrases(anchors_at), Digests(windows_at)]
        anchors, windows = held
        for lo, hi, data, off in text_chunks(b.column(k), STEP_BYTES):
            w = Windows(data, off)
            may = np.flatnonzero(anchors.counts(bucket, w) >= 2)
            if spare is not None and len(may):
                may = may[~b.column(spare).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)[w.doc[may]]]
            hit = may[windows.find(bucket, w.digests(may))[0] >= 2]
            yield lo, hi, data, off, w.bytes(hit, len(data))

    return x, marked


def remove_shared(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", spare_col: str | None = None) -> DataFrame:
    """The documents with shared passages cut out of their texts, without ``spare_col``; ``chars_col`` is set to the new length where a text changed."""
    x, marked = shared(docs, text_col, spare_col)
    return without(docs.drop(spare_col) if spare_col else docs, x, marked, text_col, chars_col)
