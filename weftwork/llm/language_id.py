"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a logistic classifier over hashed byte n-grams
tells the languages with a 1 from those with a 0. A text's bits are decoded by weighted losses: the
language whose codeword makes the classifiers' losses smallest, bits weighted by how well they were
learned. Classifiers are fitted on a bounded sample; every whole text is scored.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a null language or id is
never learned from; with no language learned all texts are ``und``, with one all others are that one;
languages whose losses tie give the first by name, flagged as ambiguous; rows that repeat are judged
alike, and learned from as often as they stand; a very long text is a step of its own; an empty table
gives an empty one; new columns give way to extra columns of the same name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import LOWER, arrow_rows, fold, fresh, text_chunks, tidy
from weftwork.llm.linear import Logistic, bounded_sample

#: Documents of a language that are learned from, at most (in expectation).
SAMPLE_PER_LANGUAGE = 600
BUCKETS = 4096
ORDERS = (1, 2, 3)
#: Texts whose feature rows (of BUCKETS numbers) are held at a time.
FEATURE_ROWS = 256
#: A decision with less than this lead of the best language over the second is flagged.
AMBIGUOUS = 0.2
UNDETERMINED = "und"

#: Bytes as classes: ASCII letters in lower case, bytes of other letters, and one blank for the rest.
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)
_CLASS = _CLASS[LOWER]


def features(data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """For each text, square roots of the shares of hashed n-grams, of each order by itself."""
    n = len(off) - 1
    out = np.zeros((n, buckets), np.float32)
    if not len(data):
        return out
    c = _CLASS[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    for k in ORDERS:
        if len(c) < k:
            continue
        h = np.full(len(c) - k + 1, 2166136261 + k, np.uint32)
        for j in range(k):
            h = (h ^ c[j : len(c) - k + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = doc[: len(h)] == doc[k - 1 :]
        cell = doc[: len(h)][inside] * buckets + (h[inside] % np.uint32(buckets))
        counts = np.bincount(cell, minlength=n * buckets).reshape(n, buckets)
        out += np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return out


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each language: all two-way splits for few languages, else the best of random codes."""
    if languages <= 6:
        rest = range(1, languages)
        splits = [s for r in range(1, languages) for s in combinations(rest, r)]
        return np.array([[1 if y in s else -1 for s in splits] for y in range(languages)], np.float32).reshape(languages, -1)
    bits, rng, best, least = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
        if apart > least and (np.abs(code.sum(axis=0)) < languages).all():
            best, least = code, apart
    return best


class LanguageModel:
    """Languages, codewords, bit weights and bit classifiers."""

    def __init__(self, x: np.ndarray, names: list[str]) -> None:
        self.languages = sorted(set(names))
        y = np.array([self.languages.index(n) for n in names], np.int64)
        self.code = codewords(len(self.languages)) if self.languages else np.zeros((0, 0), np.float32)
        self.bits = None
        if self.code.shape[1]:
            share = np.bincount(y, minlength=len(self.languages))
            m = self.code[y]
            self.bits = Logistic(x, m > 0, l2=1e-3, steps=150, weight=1.0 / share[y], floor=0.02)
            right = (np.sign(self.bits.logit(x)) == m).astype(np.float64)
            # of each language and bit, how often the bit comes out right; rows sum to 1
            rate = np.array([right[y == k].mean(axis=0) for k in range(len(self.languages))])
            self.weight = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-9)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, and lead over the second."""
        n = len(x)
        if self.bits is None:
            return np.zeros(n, np.int64), np.ones(n), np.ones(n)
        margin = self.bits.logit(x)[:, None, :] * self.code
        loss = (self.weight * np.log1p(np.exp(-np.clip(margin, -30, 30)))).sum(axis=2)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -1] - order[:, -2]


def _letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fits on a bounded sample of the rows where ``learn`` holds; only features come to the driver."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & _letters(text_col))

    def extract(batches):
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(0), most_rows=FEATURE_ROWS):
                x = features(data, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = bounded_sample(rows, id_col, F.col(lang_col), per_language).select(text_col, F.col(lang_col).cast("string")).mapInArrow(tidy(extract), "lang string, x binary").toArrow()
    blobs = got.column("x").to_pylist()
    x = np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), BUCKETS).astype(np.float32)
    return LanguageModel(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score and ambiguous added (under other names if taken)."""
    names = fresh(docs, "lang_pred", "score", "ambiguous")
    (flag,) = fresh(docs, "has_letter")
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        m = held.value
        for b in batches:
            text, letters = b.column(columns.index(text_col)), b.column(len(columns)).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(text, most_rows=FEATURE_ROWS):
                has = letters[lo:hi] & bool(m.languages)
                k, score, lead = m.decode(features(data, off))
                cols = {c: b.column(i).slice(lo, hi - lo) for i, c in enumerate(columns)}
                lang = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(k.tolist(), has.tolist(), strict=True)]
                yield arrow_rows(cols | {names[0]: lang, names[1]: pa.array(np.where(has, score, 0.0)), names[2]: pa.array(~has | (lead < AMBIGUOUS))}, out)

    return docs.withColumn(flag, _letters(text_col)).mapInArrow(tidy(run), out)


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from all folds but one and predicts every document."""
    out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    model = fit(docs, ~out, id_col, text_col, lang_col)
    named = identify(docs.select(id_col, text_col), model, text_col)
    return named.select(id_col, out.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose language is determined, with their own columns; ``und`` goes."""
    named = identify(docs, model, text_col)
    lang = next(c for c in named.columns if c not in docs.columns)
    return named.where(F.col(lang) != UNDETERMINED).select(*docs.columns)
