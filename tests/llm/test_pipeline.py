"""The whole pipeline against brute-force versions of its stages, and the registered queries over whole tables."""

import collections
import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_dedup import WORD, brute_components, cut, fingerprint, lower
from weftwork.llm.queries import ORACLES, PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(PIECE_MODEL)), reason="no test tables or tokenizer here")


def windows(text, size=10):
    w = WORD.findall(lower(text))
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


@needs
def test_stages_match_brute_force(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    sizes = {len(x) for x in items}
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        assert name == "tokenize" or docs.columns == before.columns
    assert list(held) == [n for n, _ in corpus_pipeline.STAGES]

    was, now = held["identify_language"]
    assert set(now) == {i for i, t in was.items() if t and re.search(r"[^\W\d_]", t)}
    was, now = held["drop_near_copies"]
    root = brute_components({i: fingerprint(t) for i, t in was.items()})
    assert set(now) == {i for i in was if root[i] == i} and len(now) < len(was)
    was, now = held["cut_repeats"]
    ids = list(was)
    want = cut([was[i].encode() for i in ids], 400)
    assert {i: r.text for i, r in now.items()} == {i: w[4].decode("utf-8", "ignore") for i, w in zip(ids, want, strict=True)}
    assert all(r.n_chars == len(r.text) for i, r in now.items() if r.text != was[i])
    was, now = held["drop_contaminated"]

    def hit(t):
        w = WORD.findall(lower(t))
        return any(tuple(w[i : i + n]) in items for n in sizes for i in range(len(w) - n + 1))

    assert set(now) == {i for i, t in was.items() if not hit(t)} and len(now) < len(was)
    was, now = held["tokenize"]
    s = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert all(now[i].token_ids == s.encode(t) and now[i].round_trip for i, t in was.items())


@needs
def test_every_operator_has_one_query_over_its_whole_table(spark):
    numbers = collections.Counter(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == collections.Counter(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op3_language_id", "op6_quality_ranking", "op9_toxicity_chain", "op4_sentencepiece"):
        assert QUERIES[name](spark, SF).count() == rows["documents"], name


@needs
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = c.sql(ORACLES[name]), QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    order = [rel.columns.index(x) for x in names]
    want = sorted((tuple(r[k] for k in order) for r in rel.limit(10**9).fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
