"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text. It is learned from preference pairs
(a labelled good document is preferred to a labelled bad one) by logistic loss on the difference of
their features, so no intercept is learned and only the order counts. Scores for use are the worths
on a logistic scale whose slope is fitted to the labels and whose point ``THRESHOLD`` lies at the
quantile of worth that parts the share of bad documents from the rest.

Every labelled row is learned from. Features are taken once, stored, and joined with the labels; labelled
rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash of their id, and in a block each good one is
held against each bad one. Blocks are packed into a row each, and means, the steps of Newton's method,
the quantile and the slope are sums over all blocks: a task hands on one vector. Where one label is
so rare that blocks would lack it, its rows are also put into further blocks, there for pairs alone.

Edge cases: a null or empty text has all-zero features and is scored like any other; labels or ids
that are null are never learned from; a document with several labels gives several rows to learn from;
with labels of one kind alone, or none, every score is the share of good labels (0.5 if none); worths that
tie at the quantile get just the threshold, which counts as good; rows that repeat are scored alike; a very
long text is a step of its own; an empty table gives an empty one; extra columns are not read, and a new
column gives way to one of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import NOT_SPACE, arrow_rows, fold, fresh, schema_of, stored, text_chunks, tidy, word_spans
from weftwork.llm.decontaminate import WordTable
from weftwork.llm.linear import newton, sigmoid

#: Labelled rows of a block, about, and rows of the rarer label that a block has at least, about.
BLOCK_ROWS, LEAST_RARER = 1024, 16
#: Weight of the squares of the weights against the mean loss, and bins of one look for the quantile.
L2, BINS = 1e-3, 4096
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"\n", b"|", b"\"'()[]{}=/\\@_-+~^`"), 1):
    _KINDS[list(_bytes)] = _k
_KINDS[0x80:] = 9
_N_KINDS = 10
FEATURES = 2 * (_N_KINDS - 1) + 9
_TABLE = WordTable()


def _shares(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes, of repeated words, word pairs and lines, and lengths of words, for each text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    kinds = np.bincount(doc * _N_KINDS + _KINDS[data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)[:, 1:]
    starts, ends, first = word_spans(data, off, NOT_SPACE)
    words = np.diff(first)
    h = _TABLE.of(data, starts, ends)
    of = np.repeat(np.arange(n, dtype=np.int64), words)

    def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the number of distinct keys and the count of the commonest."""
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((keys, docs))
        k, d = keys[order], docs[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
        runs = np.diff(np.append(new, len(k)))
        most = np.zeros(n)
        np.maximum.at(most, d[new], runs)
        return np.bincount(d[new], minlength=n).astype(float), most

    unique, most = distinct(h, of)
    pair_doc = of[:-1][of[:-1] == of[1:]] if len(of) else of
    pairs = (h[:-1] * np.uint64(3) + h[1:])[of[:-1] == of[1:]] if len(of) else h
    unique_pairs, most_pairs = distinct(pairs, pair_doc)
    length = (ends - starts).astype(float)
    total, square = np.bincount(of, length, n), np.bincount(of, length**2, n)
    mean = _shares(total, words)
    rates = _shares(kinds, size[:, None])
    return np.column_stack([
        rates, np.minimum(rates * 20, 1), np.log1p(words), _shares(unique, words), _shares(most, words), _shares(unique_pairs, words), _shares(most_pairs, words),
        np.minimum(mean, 30), np.sqrt(np.maximum(_shares(square, words) - mean**2, 0)).clip(0, 30), _shares(unique, np.sqrt(words)), words < 20,
    ]).astype(np.float32)


class Block:
    """Features of good and of bad rows; the first ``own`` of each are counted here, others are there for pairs alone."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, own: tuple[int, int] | None = None) -> None:
        self.good, self.bad = good, bad
        self.own = own or (len(good), len(bad))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Own rows and their labels."""
        g, b = self.own
        return np.concatenate([self.good[:g], self.bad[:b]]), np.repeat([1, 0], [g, b])


def moments(block: Block) -> np.ndarray:
    """Numbers of bad and good rows, sums of the features and of their squares."""
    x, label = block.rows()
    x = x.astype(np.float64)
    return np.concatenate([np.bincount(label, minlength=2), x.sum(axis=0), (x**2).sum(axis=0)])


def pair_sums(block: Block, standard: Callable[[np.ndarray], np.ndarray], w: np.ndarray) -> np.ndarray:
    """Pairs of the block, their loss, and its gradient and second derivatives; from row sums, so that no difference is made."""
    good, bad = standard(block.good), standard(block.bad)
    total = np.zeros(2 + len(w) + len(w) ** 2)
    step = max(1, (1 << 20) // max(1, len(bad)))  # numbers of pairs at a time
    for k in range(0, len(good) if len(bad) else 0, step):
        g = good[k : k + step]
        margin = (g @ w)[:, None] - bad @ w
        p = sigmoid(-margin)
        v = p * (1 - p)
        cross = g.T @ v @ bad
        second = g.T @ (v.sum(axis=1)[:, None] * g) + bad.T @ (v.sum(axis=0)[:, None] * bad) - cross - cross.T
        total += np.concatenate([[margin.size, np.logaddexp(0, -margin).sum()], bad.T @ p.sum(axis=0) - g.T @ p.sum(axis=1), second.ravel()])
    return total


class Ranking:
    """Worth of documents and its scale, from blocks: ``total`` sums a function over all of them."""

    def __init__(self, x: np.ndarray, label: np.ndarray) -> None:
        n = max(1, len(x) // BLOCK_ROWS)
        blocks = [Block(x[k::n][label[k::n] == 1], x[k::n][label[k::n] == 0]) for k in range(n)]
        self.learn(lambda f: sum(f(b) for b in blocks))

    @classmethod
    def of(cls, total: Callable[[Callable[[Block], np.ndarray]], np.ndarray]) -> Ranking:
        model = cls.__new__(cls)
        model.learn(total)
        if model.fitted:
            model._cut_at(lambda f: total(lambda b: f(b.rows()[0])))
            model._slope_of(lambda f: total(lambda b: f(*b.rows(), np.ones(sum(b.own)))))
        return model

    def learn(self, total: Callable[[Callable[[Block], np.ndarray]], np.ndarray]) -> None:
        sums = total(moments)
        self.bad, self.good = (int(v) for v in sums[:2])
        n = self.bad + self.good
        self.constant = self.good / n if n else 0.5
        self.fitted = bool(self.good and self.bad)
        if not self.fitted:
            return
        self.mean = sums[2 : 2 + FEATURES] / n
        self.scale = np.sqrt(np.maximum(sums[2 + FEATURES :] / n - self.mean**2, 0)) + 1e-3
        self.w = newton(lambda w: total(lambda b: pair_sums(b, self._standard, w)), FEATURES, L2)

    def _cut_at(self, total: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]) -> None:
        """The threshold between the worths whose ranks are the number of bad rows and one more, each looked for bin by bin down to one number."""
        most = 8 * float(np.abs(self.w).sum()) + 1.0  # no worth lies beyond
        ranks = [max(0, min(r, self.bad + self.good - 1)) for r in (self.bad - 1, self.bad)]
        spans, before = [(-most, most)] * 2, [0, 0]
        for _ in range(8):
            cuts = [np.linspace(lo, hi, BINS + 1) for lo, hi in spans]

            def look(x, cuts=cuts):
                worth = self.worth(x)
                return np.concatenate([np.bincount(k[(k >= 0) & (k < BINS)], minlength=BINS) for k in (np.searchsorted(c, worth, "right") - 1 for c in cuts)])

            counts = total(look).reshape(2, BINS)
            for k in range(2):
                reached = before[k] + np.cumsum(counts[k])
                at = int(min(np.searchsorted(reached, ranks[k], "right"), BINS - 1))
                before[k] = int(reached[at] - counts[k][at])
                spans[k] = (cuts[k][at], cuts[k][at + 1])
            if all(hi - lo <= 1e-12 * most for lo, hi in spans):
                break
        self.cut = float(spans[0][0] + spans[1][0]) / 2

    def _slope_of(self, total: Callable[[Callable[..., np.ndarray]], np.ndarray]) -> None:
        def sums(w):
            def of(x, label, weight):
                d = self.worth(x) - self.cut
                p = sigmoid(d * w[0])
                return np.array([weight.sum(), (weight * np.logaddexp(0, np.where(label == 1, -d, d) * w[0])).sum(), (weight * (p - label) * d).sum(), (weight * p * (1 - p) * d**2).sum()])

            return total(of)

        self.slope = float(max(newton(sums, 1, L2)[0], 1e-3))

    def calibrate(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Slope by the labels; the threshold at the worth below which the share of bad labels lies."""
        if not self.fitted:
            return
        worth = self.worth(x)
        order = np.argsort(worth, kind="stable")
        share = np.cumsum(weight[order]) / weight.sum()
        quantile = float((weight * (label == 0)).sum() / weight.sum())
        k = int(np.searchsorted(share, quantile))
        self.cut = float((worth[order[max(0, min(k, len(order) - 1))]] + worth[order[max(0, min(k + 1, len(order) - 1))]]) / 2)
        self._slope_of(lambda f: f(x, label, weight))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self._standard(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.constant)
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return sigmoid(self.slope * (self.worth(x) - self.cut) + at).astype(np.float64)


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the features of every document, as bytes."""
    out = T.StructType([*schema_of(docs, id_col), T.StructField("x", T.BinaryType())])

    def extract(batches):
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(1)):
                yield arrow_rows({id_col: b.column(0).slice(lo, hi - lo), "x": pa.array([r.tobytes() for r in features(data, off)], pa.binary())}, out)

    return docs.select(id_col, text_col).mapInArrow(tidy(extract), out)


def _rows_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32).reshape(-1, FEATURES)


def blocks_of(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Labelled rows (id, label, x) as packed blocks (good, bad, own_good, own_bad). The numbers of rows are for dealing alone."""
    n = max(1, (n_good + n_bad) // BLOCK_ROWS)
    times = {v: max(1, min(n, -(-LEAST_RARER * n // max(1, size)))) for v, size in ((1, n_good), (0, n_bad))}
    # a rare row's copies go to blocks that follow its own at even steps, so no two are in one
    copies = F.sequence(F.lit(0), F.when(F.col("label") == 1, times[1] - 1).otherwise(times[0] - 1))
    dealt = rows.select("id", "label", "x", F.explode(copies).alias("copy"))
    stride = F.when(F.col("label") == 1, n // times[1]).otherwise(n // times[0])
    dealt = dealt.select("label", "x", "copy", F.pmod(F.xxhash64(F.lit("block"), "id") + F.col("copy") * stride, F.lit(n)).alias("block"))

    def pack(t: pa.Table) -> pa.Table:
        label, copy = t.column("label").to_numpy(), t.column("copy").to_numpy()
        x = _rows_of(b"".join(t.column("x").to_pylist()))
        own, more = ([x[(label == v) & ((copy == 0) == first)] for v in (1, 0)] for first in (True, False))
        parts = max(1, -(-len(label) // (4 * BLOCK_ROWS)))  # an id that repeats very often makes a large block
        out = []
        for k in range(parts):
            mine = [x[k::parts] for x in own]
            held = [np.concatenate([m, e[:LEAST_RARER] if parts > 1 else e]) for m, e in zip(mine, more, strict=True)]
            held = [h if len(h) else o[:LEAST_RARER] for h, o in zip(held, own, strict=True)]
            out.append((held[0].tobytes(), held[1].tobytes(), len(mine[0]), len(mine[1])))
        return pa.table({c: pa.array(v, pa.binary() if c in ("good", "bad") else pa.int64()) for c, v in zip(("good", "bad", "own_good", "own_bad"), zip(*out, strict=True), strict=True)})

    return dealt.groupBy("block").applyInArrow(pack, "good binary, bad binary, own_good long, own_bad long")


def _learned(found: DataFrame, own: DataFrame) -> Ranking:
    """From features (id, x) and labels (id, label)."""
    size = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    blocks = stored(blocks_of(found.join(own, "id").select("id", "label", "x"), size.get(1, 0), size.get(0, 0)), "blocks")

    def total(f: Callable[[Block], np.ndarray]) -> np.ndarray:
        def run(batches):
            sums = None
            for b in batches:
                for good, bad, *counted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    part = f(Block(_rows_of(good), _rows_of(bad), tuple(counted)))
                    sums = part if sums is None else sums + part
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(sums, np.float64).tobytes()], pa.binary())], names=["sums"])

        parts = blocks.mapInArrow(tidy(run), "sums binary").toArrow().column(0).to_pylist()
        empty = f(Block(*[np.zeros((0, FEATURES), np.float32)] * 2))
        return sum((np.frombuffer(x, np.float64) for x in sorted(parts)), np.zeros(len(empty)))

    return Ranking.of(total)


def _own(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    return labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fits on all labelled rows; only sums come to the driver. ``learn`` is a condition on the id in labels."""
    own = _own(labels, learn, id_col, label_col)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(own.select("id").distinct(), "id", "left_semi")
    return _learned(extracted(some, "id", "text"), own)


def score(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The documents with a score added."""
    (name,) = fresh(docs, "score")
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        m = held.value
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(columns.index(text_col))):
                yield arrow_rows({c: b.column(i).slice(lo, hi - lo) for i, c in enumerate(columns)} | {name: pa.array(m.score(features(data, off)))}, out)

    return docs.mapInArrow(tidy(run), out)


def held_out_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the labels of all folds but one and scores every document; features are taken once, for both."""
    found = stored(extracted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"), "features")
    learn = F.coalesce(fold(F.col(id_col), folds) != held, F.lit(False))
    model = found.sparkSession.sparkContext.broadcast(_learned(found, _own(labels, learn, id_col, label_col)))
    out = T.StructType([found.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = _rows_of(b"".join(b.column(1).to_pylist()))
            yield arrow_rows({"id": b.column(0), "score": pa.array(model.value.score(x))}, out)

    is_out = F.coalesce(fold(F.col("id"), folds) == held, F.lit(False))
    scored = found.mapInArrow(tidy(run), out)
    return scored.select(F.col("id").alias(id_col), is_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
