"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over telling words and word beginnings;
each model also reads the probabilities of the categories before it. So that these inputs look in
training as they do in use, they are out-of-fold predictions: a document's probability comes from
models that did not see it, over features that were chosen without it.

Features are chosen on a bounded sample of labelled documents, once on all of it and once without each
fold, by how far their odds in toxic documents lie over those in others, in standard errors. A category
is a label and, where the table has but one, the label within a group of documents: ``toxic`` in each
language (the ``MOST_GROUPS`` that have most toxic labels), then toxic as a whole. A group says what a category
is and is never read in prediction.

Edge cases: a null or empty text has no feature and gets the model's base rate; null labels or ids
are not learned from, and a null group is no category; rows that repeat an id are judged one by one, and
learned from as often as text and label match; features whose odds tie are taken by key; a probability
of exactly ``THRESHOLD`` is toxic; without toxic and other labels to learn from, every probability is
the share of toxic labels (0 if there are none); very long texts are read ``CHUNK_BYTES`` at a time or
alone; an empty table gives an empty one; columns beside those that are named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import ALNUM, LOWER, arrow_rows, fold, fresh, stored, text_chunks, tidy, word_spans
from weftwork.llm.decontaminate import WordTable
from weftwork.llm.linear import Logistic, bounded_sample, sigmoid

#: Parameters of fitting: labelled documents of a label that are learned from, at most (in expectation), and features of a model at most.
SAMPLE_PER_LABEL, MOST_FEATURES = 3000, 512
#: A feature is a whole word (0) or a word's first so many bytes.
KINDS = (0, 4, 5, 6)
LEAST_DOCS, LEAST_Z = 2, 2.5
FOLDS = 5
THRESHOLD = 0.5
#: Groups that are categories of their own, at most, and documents that make one.
MOST_GROUPS, LEAST_TOXIC = 6, 5

_TABLE = WordTable()


def keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature key) of all words and word beginnings; the kind is in the key's lowest bits."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    out_doc, out_key = [], []
    for number, size in enumerate(KINDS):
        s, e, d = starts, ends, doc
        if size:
            long = ends - starts > size
            s, e, d = starts[long], starts[long] + size, doc[long]
        out_doc.append(d)
        out_key.append((_TABLE.of(data, s, e) & ~np.uint64(3)) | np.uint64(number))
    return np.concatenate(out_doc), np.concatenate(out_key)


def presence(data: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A row for each text with 1 for each chosen feature (sorted keys) that occurs."""
    x = np.zeros((len(off) - 1, len(chosen)), np.float32)
    if len(chosen):
        doc, key = keys(data, off)
        at = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = chosen[at] == key
        x[doc[hit], at[hit]] = 1
    return x


class Chain:
    """Linear models in order; each reads the features and the probabilities before it.

    x: a column for each candidate; ``of[0]`` are the columns of the models, ``of[1 + k]`` those chosen without fold k.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, of: list[np.ndarray]) -> None:
        self.models: list = []
        before = np.zeros((len(x), 0), np.float32)
        inputs = [x[:, c].astype(np.float32) for c in of]
        for j in range(y.shape[1]):
            read = [np.column_stack([i, before]) for i in inputs]
            self.models.append(self._fit(read[0], y[:, j], weight))
            unseen = np.zeros(len(x), np.float32)
            for k, own in enumerate(read[1:]):
                inside, outside = part != k, part == k
                unseen[outside] = self._predict(self._fit(own[inside], y[inside, j], weight[inside]), own[outside])
            before = np.column_stack([before, unseen])
        #: Out-of-fold probabilities of the documents learned from.
        self.unseen = before

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        if not len(y) or y.min() == y.max():
            return float(y[0]) if len(y) else 0.0
        return Logistic(x, y, l2=1e-4, steps=150, weight=weight, floor=0.05)

    @staticmethod
    def _predict(model, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), model) if isinstance(model, float) else sigmoid(model.logit(x)[:, 0].astype(np.float64))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.models)))
        for j, model in enumerate(self.models):
            out[:, j] = self._predict(model, np.column_stack([x, out[:, :j]]).astype(np.float32))
        return out


def _choose(sample: DataFrame, most: int) -> list[np.ndarray]:
    """Keys of the features that speak most for the label, from rows (text, label, part): over all rows, and without each part."""

    def count(batches):
        for b in batches:
            label, part = b.column(1).to_numpy(), b.column(2).to_numpy()
            for lo, _, data, off in text_chunks(b.column(0)):
                doc, key = keys(data, off)
                pairs = np.unique(np.rec.fromarrays([key, doc]))
                key, own = pairs["f0"], lo + pairs["f1"]
                for k in range(FOLDS):
                    here = part[own] == k
                    found, n = np.unique(key[here], return_inverse=True)
                    bad = np.bincount(n, label[own[here]] == 1, len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), k, np.int32)), pa.array(bad), pa.array(np.bincount(n, minlength=len(found)) - bad)], names=["key", "part", "bad", "good"])

    total = {r["part"]: (r.bad, r.good) for r in sample.groupBy("part").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")).collect()}
    without = [None, *range(FOLDS)]
    own = lambda c, k: F.sum(c) if k is None else F.sum(F.when(F.col("part") != k, F.col(c)).otherwise(0))
    counts = sample.mapInArrow(tidy(count), "key long, part int, bad long, good long").groupBy("key").agg(*(own(c, k).alias(f"{c}{i}") for i, k in enumerate(without) for c in ("bad", "good")))
    z = []
    for i, k in enumerate(without):
        n_bad, n_good = (sum(v[side] for p, v in total.items() if p != k) for side in (0, 1))
        bad, good = F.col(f"bad{i}"), F.col(f"good{i}")
        lift = F.log((bad + 0.5) / F.lit(n_bad + 1.0)) - F.log((good + 0.5) / F.lit(n_good + 1.0))
        z.append(F.when(bad >= LEAST_DOCS, lift / F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))).otherwise(-1.0).alias(f"z{i}"))
    telling = stored(counts.select("key", *z).where(F.greatest(*(f"z{i}" for i in range(len(z)))) >= LEAST_Z), "features")
    top = (telling.where(F.col(f"z{i}") >= LEAST_Z).orderBy(F.desc(f"z{i}"), "key").limit(most).select("key").collect() for i in range(len(z)))
    return [np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64)) for rows in top]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", group_col: str | None = "lang", per_label: int = SAMPLE_PER_LABEL, most: int = MOST_FEATURES) -> tuple[np.ndarray, Chain, list[str]]:
    """(feature keys, chain, its categories), fitted on a bounded sample of labelled rows."""
    own = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    share = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    chosen_rows = F.broadcast(bounded_sample(own, "id", F.col("label"), per_label))  # bounded by its parameter
    group = F.col(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), group.alias("kind"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id").cast("string")), F.lit(FOLDS)).cast("int")
    sample = stored(texts.join(chosen_rows, "id").select("text", "label", part.alias("part"), "kind"), "sample")
    groups = [r.kind for r in sample.where("label = 1 AND kind IS NOT NULL").groupBy("kind").count().where(F.col("count") >= LEAST_TOXIC).orderBy(F.desc("count"), "kind").limit(MOST_GROUPS).collect()]
    chosen = _choose(sample.select("text", "label", "part"), most)
    every = np.unique(np.concatenate(chosen))

    def extract(batches):
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(0)):
                x = np.packbits(presence(data, off, every).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in (1, 2, 3)), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "part", "kind", "x"])

    got = sample.mapInArrow(tidy(extract), "label int, part int, kind string, x binary").toArrow()
    n, label = got.num_rows, got.column("label").to_numpy()
    x = np.unpackbits(np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, : len(every)] if n else np.zeros((0, len(every)), np.uint8)
    taken = np.bincount(label, minlength=2) if n else np.ones(2)
    weight = np.array([share.get(int(v), 1) / taken[v] for v in label]) if n else np.zeros(0)
    kind = np.array(got.column("kind").to_pylist(), object)
    y = np.column_stack([*((label == 1) & (kind == g) for g in groups), label == 1]).astype(np.float32) if n else np.zeros((0, 1), np.float32)
    of = [np.searchsorted(every, c) for c in chosen]
    return chosen[0], Chain(x, y, weight, got.column("part").to_numpy() if n else np.zeros(0, np.int64), of), [*(f"{label_col}_{g}" for g in groups), label_col]


def score(docs: DataFrame, model: tuple[np.ndarray, Chain, list[str]], text_col: str = "text") -> DataFrame:
    """The documents with the probabilities of the chain's categories, in order, and of the last one."""
    names = fresh(docs, "chain", "score")
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        chosen, chain, _ = held.value
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(columns.index(text_col))):
                p = chain.probabilities(presence(data, off, chosen))
                own = {c: b.column(i).slice(lo, hi - lo) for i, c in enumerate(columns)}
                yield arrow_rows(own | {names[0]: p.tolist(), names[1]: pa.array(np.ascontiguousarray(p[:, -1]))}, out)

    return docs.mapInArrow(tidy(run), out)


def held_out_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the labels of all folds but one and judges every document."""
    out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    model = fit(docs, labels, ~out & F.col(id_col).isNotNull(), id_col, text_col)
    model[1].unseen = None  # of the documents learned from; not needed to predict
    p = score(docs.select(id_col, text_col), model, text_col)
    toxic = F.col("score") >= THRESHOLD
    return p.select(id_col, out.alias("held_out"), "chain", "score", toxic.cast("int").alias("predicted"), toxic.alias("toxic"))
