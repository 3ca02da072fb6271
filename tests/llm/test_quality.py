"""Quality is learned from every labelled row: the threshold and the blocks of pairs leave none out."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftwork.llm import bradley_terry
from weftwork.llm.linear import newton, sigmoid


def test_threshold_lies_at_the_quantile_of_all_labelled_rows(spark):
    rng = random.Random(3)
    n, words = 12_000, ["word", "Word", "12", "longer", "a", "!!", "#x", "other"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40))), int(rng.random() < 0.6)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4).cache()
    model = bradley_terry.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), F.lit(True))
    bad = sum(r[2] == 0 for r in rows)
    assert (model.bad, model.good) == (bad, n - bad)
    below = bradley_terry.score(docs.select("text"), model).where(F.col("score") < bradley_terry.THRESHOLD).count()
    assert abs(below - bad) <= 3  # texts of few words repeat, so worths may tie


def test_rare_labels_meet_all_others(spark):
    rng = np.random.default_rng(1)
    n, rare = 6000, 3
    x = rng.normal(0, 1, (n, bradley_terry.FEATURES)).astype(np.float32)
    rows = spark.createDataFrame([(i, int(i >= rare), bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, label int, x binary")
    got = bradley_terry.blocks_of(rows, n - rare, rare).collect()
    assert len(got) == n // bradley_terry.BLOCK_ROWS
    assert (sum(r.own_good for r in got), sum(r.own_bad for r in got)) == (n - rare, rare)
    assert all(len(r.bad) and len(r.good) for r in got)


def test_an_id_that_repeats_is_packed_in_parts_and_counted_once(spark):
    x = np.arange(9000 * bradley_terry.FEATURES, dtype=np.float32).reshape(9000, -1)
    rows = spark.createDataFrame([(7, int(i % 90 > 0), bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, label int, x binary")
    got = bradley_terry.blocks_of(rows, 8900, 100).collect()
    assert (sum(r.own_good for r in got), sum(r.own_bad for r in got)) == (8900, 100) and all(len(r.good) <= 4 * 4096 * bradley_terry.FEATURES for r in got)
    own = np.concatenate([bradley_terry._rows_of(bytes(b))[:k] for r in got for b, k in ((r.good, r.own_good), (r.bad, r.own_bad))])
    assert sorted(own[:, 0].tolist()) == x[:, 0].tolist()


def test_pair_sums_by_plain_loops():
    rng = np.random.default_rng(2)
    good, bad, w = rng.normal(0.5, 1, (9, 4)), rng.normal(0, 1, (6, 4)), rng.normal(0, 1, 4)
    v = bradley_terry.pair_sums(bradley_terry.Block(good, bad), lambda x: x, w)
    d = np.array([g - b for g in good for b in bad])
    p = sigmoid(-d @ w)
    assert v[0] == len(d) and np.isclose(v[1], np.log1p(np.exp(-d @ w)).sum())
    assert np.allclose(v[2:6], -(p[:, None] * d).sum(axis=0)) and np.allclose(v[6:].reshape(4, 4), (d.T * (p * (1 - p))) @ d)
    best = newton(lambda u: bradley_terry.pair_sums(bradley_terry.Block(good, bad), lambda x: x, u), 4, 1e-3)
    slope = bradley_terry.pair_sums(bradley_terry.Block(good, bad), lambda x: x, best)[2:6] / len(d) + 1e-3 * best
    assert np.abs(slope).max() < 1e-6
