"""Passages of over 50 words that documents share, against brute force."""

import collections
import random
import re

import pytest

import corpus_pipeline
from weftwork.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(texts, spared=(), size=51):
    found = [list(WORD.finditer(t or "")) for t in texts]
    windows = [[tuple(m[0] for m in w[i : i + size]) for i in range(len(w) - size + 1)] for w in found]
    seen = collections.Counter(x for w in windows for x in set(w))
    out = []
    for k, (t, words) in enumerate(zip(texts, found, strict=True)):
        gone = {i + j for i, x in enumerate(windows[k]) if seen[x] > 1 and k not in spared for j in range(size)}
        ends = [m.start() for m in words[1:]] + [len(t or "")]
        out.append(t if not gone else t[: words[0].start()] + "".join(t[m.start() : e] for i, (m, e) in enumerate(zip(words, ends, strict=True)) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_match_brute_force(spark, prose, seed):
    rng = random.Random(seed)
    common = [prose(100 + k, rng.randint(45, 130)) for k in range(8)]
    texts = [None, "", " \n ", "one", " ".join(["ab"] * 300), prose(50, 51), prose(50, 51), prose(60, 20) + "\n" + prose(61, 70) + " x " + prose(61, 70)]
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(common).split()
            a = rng.randint(0, 8)
            parts += [prose(rng.randint(0, 10**6), rng.randint(0, 60)), rng.choice(["\n", "  ", " "]).join(w[a : len(w) - rng.randint(0, 8)])]
        texts.append("\t".join(parts))
    spared = {k for k in range(len(texts)) if k % 9 == 8}
    rows = [(k, t, len(t or ""), k in spared) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spare boolean").repartition(4)
    got = passages.remove_shared(df, spare_col="spare")
    assert got.columns == ["doc_id", "text", "n_chars"]
    rows, want = {r.doc_id: r for r in got.collect()}, cut(texts, spared)
    assert {k: r.text for k, r in rows.items()} == dict(enumerate(want))
    assert all(r.n_chars == len(r.text or "") for r in rows.values())
    assert rows[5].text == rows[6].text == "" and rows[4].text == texts[4] and rows[7].text == texts[7]
    assert 20 < sum(a != b for a, b in zip(texts, want, strict=True)) < len(texts) - 15
    assert passages.remove_shared(df.limit(0), spare_col="spare").collect() == []


def test_copies_over_many_batches(spark, prose):
    texts = [prose(k, 70) + " " + prose(900 + k % 3, 55) + " " + prose(500 + k, 70) for k in range(40)] + [prose(k, 200) for k in range(2000, 2010)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: r.text for r in passages.remove_shared(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == dict(enumerate(cut(texts)))


def test_pipeline_cuts_passages_that_are_shorter_than_400_bytes(spark, tmp_path):
    """What reaches the tokenizer holds no such passage; a text with a passage of the benchmark is dropped, not cut."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = plain(60), plain(58)
    assert len(passage) < 400 and len(item) < 400
    texts = [f"{plain(150)} {passage} {plain(150)}" for _ in range(3)] + [f"{plain(150)} {item} {plain(150)}" for _ in range(2)] + [plain(300) for _ in range(5)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: t for k, t in enumerate(cut(texts, {3, 4})) if k not in (3, 4)}
    assert not any(passage in t for t in got.values())
