"""SimHash, repeated strings and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.llm import common, decontaminate, simhash, suffix_dedup


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, most=2):
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_matches_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    want = sorted((i if i is not None else -1, f"{fingerprint(t):016x}") for i, t in corpus)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint) for r in got) == want
    comp = brute_components({i: fingerprint(t) for i, t in corpus if i is not None})
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == comp
    assert comp[5] == 4 and comp[2] == comp[3] == 1


def test_simhash_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []


def test_keep_first_keeps_one_of_each_component(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and 5 not in ids and 1 in ids and 2 not in ids and None in ids and 12 in ids


def test_keep_first_judges_rows_not_ids(spark, prose):
    a, b, c = prose(501, 40), prose(502, 40), prose(503, 40)
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b), (None, c), (4, a), (4, a), (5, "lone words here"), (5, "lone words here")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "row long, text string").repartition(3), id_col="row")
    assert sorted(((r["row"] is None, r["row"] or 0, r.text) for r in kept.collect())) == [(False, 1, a), (False, 2, b), (False, 5, "lone words here"), (True, 0, c)]


def test_hot_keys_are_joined_where_they_lie(spark):
    rows = spark.range(0, 30_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = common.join_split(rows, table, "k", "n")
    assert got.count() == rows.where("k IS NOT NULL").count() and got.where("k = 7 AND low != 0 OR k != 7 AND low != id").count() == 0
    at = got.select(F.spark_partition_id().alias("p"), "k").where("k = 7").groupBy("p").count().collect()
    assert len(at) == 8 and max(r["count"] for r in at) < 2 * min(r["count"] for r in at)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 63), st.integers(0, 63)), max_size=60))
def test_gray_index_finds_all_links(base, near):
    f = set(base)
    for k, a, b in near:
        f.add(base[k % len(base)] ^ (1 << a) ^ (1 << b))
    f = np.array(sorted(f), np.uint64)
    half = len(f) // 2
    a, b = simhash.shard_links(f[half:], f[:half], 2)
    got, want = {int(x): {int(x)} for x in f}, {int(x): {int(x)} for x in f}

    def tie(sets, x, y):
        if sets[x] is not sets[y]:
            sets[x] |= sets[y]
            for z in sets[y]:
                sets[z] = sets[x]

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        tie(got, x, y)
    for i, x in enumerate(f.tolist()):
        for y in f[max(i + 1, half) :].tolist():  # visitors are not held against each other
            if (x ^ y).bit_count() <= 2:
                tie(want, x, y)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values()}


def test_large_near_copy_group_makes_few_links():
    rng = np.random.default_rng(1)
    center = np.uint64(rng.integers(0, 2**63))
    f = np.unique(center ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    a, _ = simhash.shard_links(f, np.zeros(0, np.uint64), 2)
    assert len(a) == len(f) - 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.vertex: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def cut(texts, size):
    seen = collections.Counter(t[q : q + size] for t in texts for q in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone, until = bytearray(len(t)), 0
        for q in range(len(t)):
            if q <= len(t) - size and seen[t[q : q + size]] > 1:
                until = q + size
            gone[q] = q < until
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for q in range(len(t)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats_match_brute_force(docs, corpus):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(docs).collect())
    want = cut([(t or "").encode() for _, t in corpus], 400)
    assert got == sorted(((i is None, i or 0), *w[:4]) for (i, _), w in zip(corpus, want, strict=True))
    assert sum(w[1] for w in want) > 3000


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_mixed_passages(spark, prose, seed):
    import random

    rng = random.Random(seed)
    passages = [prose(100 + k, rng.randint(40, 300)) for k in range(6)]
    texts = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [prose(rng.randint(0, 10**6), rng.randint(0, 60)), p[a : len(p) - rng.randint(0, len(p) // 3)]]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(df).collect()}
    assert got == {d: w[:4] for d, w in enumerate(cut([t.encode() for t in texts], 400))}


def test_repeats_of_copies_over_many_batches(spark, prose):
    copies, alone = [], []
    for k in range(8):
        passage = prose(700 + k, 150)
        copies += [prose(800 + k, 90) + " " + passage + " " + prose(820 + k, 90)] * 5
        alone += [prose(840 + k, 90) + " " + passage + " " + prose(860 + k, 90)]
    texts = copies + alone
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {d: w[:4] for d, w in enumerate(cut([t.encode() for t in texts], 400))}


def test_remove_repeats_keeps_columns_and_clean_texts(docs, corpus):
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    want = {i: w[4].decode("utf-8", "ignore") for (i, _), w in zip(corpus, cut([(t or "").encode() for _, t in corpus], 400), strict=True)}
    assert rows[1].text is None and rows[8].text == want[8] and rows[8].n_chars == len(want[8])
    assert all(rows[i].text == dict(corpus)[i] for i in (2, 3, 12, 14, 16, 17))


def test_repeats_empty_table(nothing):
    assert suffix_dedup.summary(nothing).collect() == []
    assert suffix_dedup.remove_repeats(nothing).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(texts, items, window=10):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for i, x in items:
            v = WORD.findall(lower(x))
            n = min(window, len(v))
            if i is None or not n:
                continue
            for j in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[j : j + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark, prose):
    rows = [(1, prose(900, 120)[50:400]), (2, None), (3, ""), (10, "One"), (4, prose(1, 60)), (5, prose(77, 30)), (4, "one  TWO"), (None, prose(2, 30)), (6, prose(6, 9000)[2000:2100])]
    return rows, spark.createDataFrame([(i, t, "q") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination_matches_brute_force(docs, corpus, benchmark, block):
    rows, table = benchmark
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.summary(docs, table, block_bytes=block).collect())
    want = brute_hits([t for _, t in corpus], rows)
    assert got == sorted(((i is None, i or 0), *w) for (i, _), w in zip(corpus, want, strict=True))
    kept = decontaminate.decontaminate(docs, table, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(not w[4] for w in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6), st.integers(2, 12))
def test_suffix_array_is_in_order(texts, depth):
    seq = np.array([x for t in texts for x in [*t, 0]], np.int32)
    at = np.flatnonzero(seq)
    got = decontaminate.suffix_array(seq, at, depth).tolist()
    suffix = lambda p: [*seq[p : p + depth].tolist(), 0][: ([*seq[p : p + depth].tolist(), 0]).index(0)]
    assert sorted(got) == at.tolist() and all(suffix(p) <= suffix(q) for p, q in zip(got[:-1], got[1:], strict=True))


def test_longest_matches(docs, corpus, benchmark):
    rows, table = benchmark
    got = {(r.doc_id, r.item, r.doc_start, r.item_start, r.n_words) for r in decontaminate.find_matches(docs, table).collect()}
    n = len(WORD.findall(lower(dict(corpus)[4])))
    assert (4, 4, 0, 0, n) in got and (15, 4, 0, 0, 2) in got
    for d, item, p, j, k in got:
        w = next(WORD.findall(lower(t)) for i, t in corpus if i == d)
        assert any(w[p : p + k] == (v := WORD.findall(lower(x)))[j : j + k] and (p + k == len(w) or j + k == len(v) or w[p + k] != v[j + k]) for i, x in rows if i == item)


def as_shard(texts):
    raw = [t.encode() for t in texts]
    return decontaminate.Shard(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 10)


def test_repeats_on_both_sides_cost_their_sum():
    """A word 4000 times against 80 000 times: as pairs that would be some 320 million."""
    b, s = decontaminate.Benchmark([1, 2], ["ab " * 4000, "ab " * 3000 + "cd"], 10), as_shard(["ab " * 80_000, "ab " * 9, "cd"])
    words, docs, sets = decontaminate.shard_hits(b, s)
    assert len(b.rows) == 2 and words[:80_000].all() and not words[80_000:].any()
    assert docs.tolist() == [0] and [b.sets[k] for k in sets] == [(0, 1)]


def test_equal_items_are_looked_up_once(prose):
    text = prose(31, 300)
    one, many = (decontaminate.Benchmark(list(range(n)), [text] * n, 10) for n in (1, 50))
    assert len(one.rows) == len(many.rows)
    s = as_shard([prose(32, 50) + " " + text, prose(33, 40)])
    for b, want in ((one, (0,)), (many, tuple(range(50)))):
        words, docs, sets = decontaminate.shard_hits(b, s)
        assert words.sum() == 300 and docs.tolist() == [0] and [b.sets[k] for k in sets] == [want]


def test_words_of_equal_hashes_stay_apart(monkeypatch, prose):
    """With hashes of two bits nearly all words have those of others; what is found is the same."""
    texts, items = [prose(k, 200) for k in range(6)], [prose(2, 200)[100:700], prose(40, 60), "One"]
    whole = decontaminate.shard_hits(decontaminate.Benchmark([1, 2, 3], items, 10), as_shard([*texts, "one two"]))
    of = decontaminate.WordTable.of
    monkeypatch.setattr(decontaminate.WordTable, "of", lambda *a: of(*a) & np.uint64(3))
    narrow = decontaminate.shard_hits(decontaminate.Benchmark([1, 2, 3], items, 10), as_shard([*texts, "one two"]))
    assert all((x == y).all() for x, y in zip(whole, narrow, strict=True)) and whole[0].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.lists(st.lists(st.integers(0, 2), max_size=16), min_size=1, max_size=4), st.integers(1, 5))
def test_hits_of_few_words_match_brute_force(texts, items, window):
    texts, items = ([" ".join("abc"[k] for k in t) for t in x] for x in (texts, items))
    raw = [t.encode() for t in texts]
    s = decontaminate.Shard(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), window)
    b = decontaminate.Benchmark(list(range(len(items))), items, window)
    words, docs, sets = decontaminate.shard_hits(b, s)
    found = [set() for _ in texts]
    for d, k in zip(docs, sets, strict=True):
        found[d].update(str(b.ids[i]) for i in b.sets[k])
    for d, (text, (_, n_hit, n_items, digest, _)) in enumerate(zip(texts, brute_hits(texts, list(enumerate(items)), window), strict=True)):
        assert words[s.first[d] : s.first[d + 1]].sum() == n_hit and len(found[d]) == n_items, text
        assert hashlib.sha256(",".join(sorted(found[d])).encode()).hexdigest() == digest


def test_longest_matches_of_repeats(spark):
    """Each match that can't be longer, once: the item's start anywhere, or the document's start against each of the item's."""
    docs, items = ["x " + "ab " * 30], [(7, "ab " * 13 + "y")]
    d = spark.createDataFrame([(1, docs[0])], "doc_id long, text string")
    got = sorted((r.doc_start, r.item_start, r.n_words) for r in decontaminate.find_matches(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    w, v = docs[0].split(), items[0][1].split()
    for p in range(len(w)):
        for j in range(len(v)):
            k = 0
            while p + k < len(w) and j + k < len(v) and w[p + k] == v[j + k]:
                k += 1
            if k >= 10 and not (p and j and w[p - 1] == v[j - 1]):
                want.append((p, j, k))
    assert got == sorted(want)


def test_decontamination_of_empty_tables(docs, nothing, benchmark):
    _, table = benchmark
    assert decontaminate.summary(nothing, table).collect() == []
    assert not any(r.contaminated for r in decontaminate.summary(docs, table.limit(0)).collect())
