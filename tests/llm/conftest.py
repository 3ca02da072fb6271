import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice(["ba", "ko", "ti", "ra", "ne", "su", "é", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """Deterministic prose: prose(seed, n) has n words."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """(doc_id, text) with nulls, empty, long, repeated and copied texts, and clashing extra columns' values."""
    passage = prose(900, 120)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, prose(1, 60)), (5, prose(1, 60)), (6, prose(2, 200)), (7, prose(2, 199) + " Zed"),
        (8, prose(3, 80) + " " + passage), (9, prose(4, 80) + "\n" + passage + "\n" + prose(5, 30)), (10, "ab " * 400), (11, "ab " * 300 + "cd"),
        (12, prose(6, 9000)), (None, prose(7, 50)), (13, prose(8, 40)), (13, prose(8, 40)), (14, "one"), (15, "one two"), (16, "日本語 ünï "), (17, "#$% 123 ..."),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """Documents with extra columns whose names operators use for their own results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, n_words string, items string, fingerprint string"
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "x", "y", "z", "f") for i, t in corpus]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
