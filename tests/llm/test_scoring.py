"""Decoding and scoring of the classifiers against plain loops; ties and repeated rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftwork.llm import bradley_terry, brown_lm, language_id, toxicity
from weftwork.llm.common import text_buffers


def fitted_languages(names, seed=1):
    rng = np.random.default_rng(seed)
    labels = [names[k % len(names)] for k in range(60)]
    x = np.abs(rng.normal(0.1, 0.05, (60, 40))).astype(np.float32)
    for i, n in enumerate(labels):
        x[i, names.index(n)] += 1
    return language_id.LanguageModel(x, labels), x


@pytest.mark.parametrize("names", [["aa", "bb"], ["aa", "bb", "cc", "dd"], [f"l{k}" for k in range(8)]])
def test_loss_weighted_decoding_by_plain_loops(names):
    m, x = fitted_languages(names)
    got, score, lead = m.decode(x)
    for i in range(0, 60, 7):
        bits = m.bits.logit(x[i : i + 1])[0]
        loss = [sum(m.weight[k, j] * math.log1p(math.exp(-max(-30.0, min(30.0, float(bits[j]) * float(m.code[k, j]))))) for j in range(len(bits))) for k in range(len(names))]
        p = [math.exp(-4 * (v - min(loss))) for v in loss]
        p = [v / sum(p) for v in p]
        best = sorted(p, reverse=True)
        assert got[i] == p.index(max(p)) and abs(score[i] - best[0]) < 1e-5 and abs(lead[i] - (best[0] - best[1])) < 1e-5
    assert [m.languages[k] for k in got] == [names[k % len(names)] for k in range(60)]


def test_languages_that_tie_give_the_first_by_name_and_a_flag():
    m, x = fitted_languages(["aa", "bb", "cc"])
    m.bits.w[:] = 0
    m.bits.b[:] = 0
    m.weight[:] = 1 / m.weight.shape[1]
    k, score, lead = m.decode(x[:3])
    assert k.tolist() == [0, 0, 0] and np.allclose(score, 1 / 3) and (lead < language_id.AMBIGUOUS).all()


def test_worth_and_score_by_plain_loops():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 80)
    x = rng.normal(0, 1, (80, bradley_terry.FEATURES)).astype(np.float32)
    x[:, 0] += 2 * label
    m = bradley_terry.Ranking(x, label)
    m.calibrate(x, label, np.ones(80))
    got = m.score(x)
    for i in range(0, 80, 9):
        worth = sum(max(-8.0, min(8.0, (float(x[i, j]) - float(m.mean[j])) / float(m.scale[j]))) * float(m.w[j]) for j in range(x.shape[1]))
        want = 1 / (1 + math.exp(-(m.slope * (worth - m.cut) + math.log(0.7 / 0.3))))
        assert abs(got[i] - want) < 1e-5
    good, bad = got[label == 1], got[label == 0]
    assert (good[:, None] > bad).mean() > 0.8
    assert abs(int((got < 0.7).sum()) - int((label == 0).sum())) <= 1  # the threshold lies at the quantile of bad labels


def test_worths_that_tie_at_the_quantile():
    label = np.array([0, 0, 1, 1])
    m = bradley_terry.Ranking(np.zeros((4, bradley_terry.FEATURES), np.float32), label)
    m.calibrate(np.zeros((4, bradley_terry.FEATURES), np.float32), label, np.ones(4))
    assert np.allclose(m.score(np.zeros((2, bradley_terry.FEATURES), np.float32)), 0.7)


def test_chain_by_plain_loops():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (120, 6))
    y = np.column_stack([x[:, 0], x[:, 0] | x[:, 1]]).astype(np.float32)
    part = rng.integers(0, toxicity.FOLDS, 120)
    chain = toxicity.Chain(x, y, np.ones(120), part, [np.arange(6)] * (1 + toxicity.FOLDS))
    got = chain.probabilities(x.astype(np.float32))
    for i in range(0, 120, 11):
        inputs, want = [float(v) for v in x[i]], []
        for model in chain.models:
            z = sum(v * float(w) for v, w in zip(inputs, model.w[:, 0], strict=True)) + float(model.b[0])
            want.append(1 / (1 + math.exp(-z)))
            inputs.append(want[-1])
        assert np.allclose(got[i], want, atol=1e-4)
    assert ((got[:, 1] > 0.5) == (y[:, 1] == 1)).all()


def test_repeated_rows_are_judged_alike(spark, prose):
    rows = [(i % 30, prose(3000 + i % 30, 30) + (" vile" if i % 3 == 0 else ""), "en" if i % 2 else "de") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.col("text").contains("vile").cast("int").alias("toxic")).distinct()
    for name, got in (("lang", language_id.held_out_languages(docs)), ("quality", bradley_terry.held_out_quality(docs, labels)), ("toxic", toxicity.held_out_toxicity(docs, labels))):
        seen = {}
        for r in got.collect():
            seen.setdefault(r.doc_id, []).append([round(v, 6) if isinstance(v, float) else [round(x, 6) for x in v] if isinstance(v, list) else v for v in r])
        assert len(seen) == 30 and all(len(v) == 3 and len({str(x) for x in v}) == 1 for v in seen.values()), name


def test_columns_that_clash_are_not_read(spark, prose):
    rows = [(i, prose(4000 + i, 25), "en" if i % 2 else "de", "x", 9.0, 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string, score double, id long")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit("y").alias("text"), F.lit(1).alias("id"))
    plain, own = docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")
    for f in (bradley_terry.held_out_quality, toxicity.held_out_toxicity):
        a, b = ({r.doc_id: r.score for r in f(*t).collect()} for t in ((docs, labels), (plain, own)))
        assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-4 for i in a)


def test_features_of_a_very_long_text_are_its_own():
    import pyarrow as pa

    long = "word " * 600_000
    data, off = text_buffers(pa.array(["short text", long, None]))
    for f in (language_id.features, bradley_terry.features):
        every = f(data, off)
        for k, t in enumerate(["short text", long, ""]):
            alone = f(*text_buffers(pa.array([t])))
            assert np.allclose(every[k], alone[0], atol=1e-6)


def test_packed_counts_come_back():
    key = np.array([0, 1, 255, 256, brown_lm.BLOCK_KEYS - 1])
    n = np.array([1, 256, 2**31, 2**40 + 3, 7])
    got = brown_lm.unpack(brown_lm.pack(key, n))
    assert got[0].tolist() == key.tolist() and got[1].tolist() == n.tolist()
    assert [len(x) for x in brown_lm.unpack(brown_lm.pack(key[:0], n[:0]))] == [0, 0]


def test_contexts_of_words_beyond_the_head_by_plain_loops():
    rng, end = np.random.default_rng(3), 9
    classes = rng.integers(0, brown_lm.CLASSES, end + 1)
    rows, want = [], {}
    for size in (0, 1, 2, 30, 0, 5):
        ids = rng.integers(0, end, size).astype(np.int32)
        at = np.flatnonzero(ids >= 4).astype(np.int32)
        words = [f"w{k}" for k in rng.integers(0, 6, len(at))]
        own = sorted(set(words))
        rows.append((ids.tobytes(), at.tobytes(), np.array([own.index(w) for w in words], np.int32).tobytes(), own))
        around = [end, *ids.tolist(), end]
        for i, w in zip(at.tolist(), words, strict=True):
            want.setdefault(w, []).append((int(classes[around[i]]), brown_lm.CLASSES + int(classes[around[i + 2]])))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["ids", "at", "which", "rest"])
    words, first, seen = brown_lm.far_contexts(batch, end, classes)
    got = {w: [tuple(x) for x in seen[first[k] : first[k + 1]].tolist()] for k, w in enumerate(words.to_pylist())}
    assert got == want
    none = brown_lm.far_contexts(batch.slice(0, 1), end, classes)
    assert len(none[0]) == 0 and len(none[2]) == 0
