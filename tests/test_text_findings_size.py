"""Findings in texts, read in two passes without a shuffle; near sentences by bits are those of the rarest pairs."""

import random

from weftwork.operators import rules


def test_findings_are_not_shuffled_and_hold_every_detector(spark):
    body = "In recent years it grew.\r\n\u2028As we all know, clearly clearly obviously; In Conclusion (Smith,\n 2020).\n \x1f\nA sentence that stands here twice. A sentence that stands here twice! A sentence that standt here twice?"
    rows = [(1, body), (2, None), (3, ""), (4, "- a\n" * 12 + "##### deep"), (5, "# a\nb\n1.\tc"), (6, "\u4f17\u6240\u5468\u77e5 \u663e\u7136\u5730\u3002"), (7, "ab ba " * 40), (8, "\u3002" * 120)]
    got = rules.text_findings(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    want = {
        (1, 1, "TEXT-001", 1), (1, 2, "TEXT-004", 3), (1, 2, "TEXT-005", 1), (1, 2, "TEXT-008", 1), (1, 6, "TEXT-007", 1), (1, 0, "TEXT-007", 1), (1, 3, "TEXT-001", 1),
        (4, 0, "TEXT-003", 2), (5, 0, "TEXT-003", 1), (6, 1, "TEXT-001", 1), (6, 1, "TEXT-004", 1), (6, 1, "TEXT-005", 1), (7, 1, "TEXT-006", 1), (8, 1, "TEXT-006", 1),
    }
    assert {(r.doc, r.line, r.rule, r.n) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_near_by_bits_are_those_by_rarest_pairs():
    rng = random.Random(2)
    for n in (0, 1, 40, 300):
        base = ["".join(rng.choices("abcde\u4e2d\U0001f600", k=rng.randint(0, 600))) for _ in range(8)]
        own = [rng.choice(base)[rng.randint(0, 3) :] + rng.choice(["", "xyz", "q" * 40]) for _ in range(n)]
        assert sorted(rules._near_by_bits(own, 0.7)) == sorted(rules._near_by_rarest(own, 0.7))


def test_scores_shuffle_findings_alone(spark):
    df = spark.createDataFrame([(1, "In recent years it grew."), (2, "Nothing to be found here.")], "k long, t string")
    got = rules.text_score(rules.text_findings(df, "k", "t"))
    assert [tuple(r) for r in got.collect()] == [(1, 15, False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
