"""Near sentences as brute force gives them; phrases are looked for by pattern only in lines that hold one."""

import random

from pyspark.sql import functions as F

from weftwork.operators import rules


def test_near_sentences_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        base = ["".join(rng.choices("abcdef ", k=rng.randint(12, 40))) for _ in range(6)]
        own = list(dict.fromkeys(s[: rng.randint(10, 40)] + rng.choice(["", "xy", "z q"]) for s in base * 3)) + ["", "q"]
        sets = [{c[i : i + 2] for i in range(len(c) - 1)} for c in ("".join(s.split()) for s in own)]
        want = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(own)) for b in range(a + 1, len(own)) if sets[a] and sets[b]]
        want = [w for w in want if w[2] > 0.7 and min(len(sets[w[0]]), len(sets[w[1]])) >= 0.7 * max(len(sets[w[0]]), len(sets[w[1]]))]
        assert [x[:3] for x in rules.near_sentences(own, 0.7)] == want


def test_phrases_are_counted_behind_a_plain_search(spark):
    df = spark.createDataFrame([(1, "obviously so, obviously; clearly"), (2, "no such word"), (3, "")], "k int, t string")
    got = df.select("k", rules._places(F.col("t"), rules.CONFIDENT).alias("n"))
    assert {r.k: r.n for r in got.collect()} == {1: 3, 2: 0, 3: 0}
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when" in plan and "contains" in plan
