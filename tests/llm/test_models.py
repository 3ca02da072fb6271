"""Classifiers, language model, tokenizer, rules and archives."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import bradley_terry, brown_lm, language_id, pieces, quality_rules, toxicity, warc
from weftwork.llm.common import shared_dir
from weftwork.llm.linear import bounded_sample

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no public tokenizer here")


# quality rules


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = collections.Counter(win)
    hit = {p for i, x in enumerate(win) if c[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rules_match_brute_force(spark, docs, corpus, prose):
    more = [(100, "a b c d e f g h i " * 3), (101, "x\n y\nx\n\n x\n y"), (102, prose(1, 30) + "\n" + prose(1, 30)), (103, "#a *b $c %d &e |f <g> h"), (104, "\x0b\x0c a b   c")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(table).collect())
    want = []
    for i, t in corpus + more:
        c = base_counts(t)
        want.append(((i is None, i or 0), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want)


def test_rules_are_native_and_keep_columns(docs, nothing):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert quality_rules.judge(nothing).collect() == []


# language identification

ALPHABETS = {"aa": "abcdef", "bb": "klmnop", "cc": "uvwxyz", "dd": "éàüöß"}


def tongue(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, tongue(lang, i, 5 + i % 40), lang) for i, lang in enumerate(random.Random(1).choices(list(ALPHABETS), k=240))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, tongue("cc", 0, 9), None), (None, tongue("dd", 0, 9), "dd")]
    return rows, spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)


def test_language_of_held_out_texts(languages):
    rows, table = languages
    got = {r.doc_id: r for r in language_id.held_out_languages(table).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, _ in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert np.mean([got[i].lang_pred == dict((r[0], r[2]) for r in rows)[i] for i in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].ambiguous for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())


def test_languages_with_little_to_learn(spark, languages):
    _, table = languages
    assert language_id.held_out_languages(table.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.held_out_languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = language_id.held_out_languages(table.where("lang = 'aa'"))
    assert {r.lang_pred for r in one.collect()} == {"aa", "und"}
    kept = language_id.keep_identified(table, language_id.fit(table, F.lit(True)))
    assert kept.columns == table.columns and kept.where("doc_id IN (1000, 1001, 1002)").count() == 0 and kept.count() == 242


def test_codewords_differ_by_pairs():
    for n in (2, 3, 4, 6, 9, 20):
        code = language_id.codewords(n)
        apart = [int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 5)


# quality and toxicity


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        t = " ".join([prose(5, 3)] * 20) if bad and i % 2 else prose(i + 5000, 60).upper() + " !! ##" if bad else prose(i + 5000, rng.randint(5, 80))
        if toxic:
            t += " " + rng.choice(["grobian", "grobianisch", "grobiante", "lumpenhund"]) + " " + prose(i, 4)
        texts.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    texts += [(900, None), (901, ""), (902, "grobianus " + prose(3, 5)), (None, prose(2, 9)), (903, prose(8, 8000))]
    labels += [(900, None, None), (None, 1, 1), (901, 1, 0), (901, 1, 0), (5000, 1, 1)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in texts], "doc_id long, text string, score double, label string").repartition(3)
    return dict(texts), docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality_of_held_out_texts(labelled):
    texts, docs, labels, truth = labelled
    got = {r.doc_id: r for r in bradley_terry.held_out_quality(docs, labels).collect()}
    assert set(got) == set(texts)
    held = [i for i in texts if i is not None and i < 400 and got[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert np.mean([got[i].predicted == truth[i][0] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_with_nothing_to_learn(labelled):
    _, docs, labels, _ = labelled
    assert {r.score for r in bradley_terry.held_out_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in bradley_terry.held_out_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert bradley_terry.held_out_quality(docs.limit(0), labels).collect() == []


def test_toxicity_of_held_out_texts(labelled):
    texts, docs, labels, truth = labelled
    got = {r.doc_id: r for r in toxicity.held_out_toxicity(docs, labels).collect()}
    assert set(got) == set(texts)
    held = [i for i in texts if i is not None and i < 400 and got[i].held_out]
    assert np.mean([got[i].predicted == truth[i][1] for i in held]) > 0.95
    assert got[902].toxic and not got[901].toxic and not got[900].toxic


def test_out_of_fold_inputs_have_not_seen_their_label(spark):
    """Every document has a word of its own and a random label: only a leak could tell the labels."""
    rng = random.Random(2)
    rows = [(i, f"own{i} shared other{i}", "en", int(rng.random() < 0.5)) for i in range(600)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    chosen, chain, names = toxicity.fit(t.drop("toxic"), t.select("doc_id", "toxic"), F.lit(True))
    assert names == ["toxic_en", "toxic"] and chain.unseen.shape == (600, 2)
    got = toxicity.fit(t.drop("toxic").withColumn("text", F.concat("text", F.lit(" telling"))), t.select("doc_id", "toxic"), F.lit(True))
    assert abs(float(np.corrcoef(chain.unseen[:, 0], chain.unseen[:, 1])[0, 1])) <= 1 and len(got[2]) == 2
    assert chain.unseen.std(axis=0).max() < 0.1


def test_features_of_each_fold_match_a_recount(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        bad = rng.random() < 0.4
        rows.append((" ".join(rng.choice(["red", "blue", "vile", "foul"] if bad else ["red", "blue", "calm"]) + rng.choice(["", "x", "y"]) for _ in range(4)), int(bad), i % toxicity.FOLDS))
    got = toxicity._choose(spark.createDataFrame(rows, "text string, label int, part int").repartition(3), 6)

    def want(k):
        inside = [r for r in rows if r[2] != k]
        seen = collections.defaultdict(lambda: [0, 0])
        for text, label, _ in inside:
            data = np.frombuffer(text.encode(), np.uint8)
            for key in set(toxicity.keys(data, np.array([0, len(data)]))[1].tolist()):
                seen[key][label] += 1
        n_bad = sum(r[1] for r in inside)
        z = {}
        for key, (good, bad) in seen.items():
            if bad >= toxicity.LEAST_DOCS:
                lift = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (len(inside) - n_bad + 1))
                z[key] = lift / math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        signed = lambda key: key - 2**64 if key >= 2**63 else key
        return sorted(sorted((k for k, v in z.items() if v >= toxicity.LEAST_Z), key=lambda k: (-z[k], signed(k)))[:6])

    assert [g.tolist() for g in got] == [want(k) for k in (None, *range(toxicity.FOLDS))]


def test_toxicity_with_nothing_to_learn(labelled):
    _, docs, labels, _ = labelled
    assert {r.score for r in toxicity.held_out_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.held_out_toxicity(docs.limit(0), labels).collect() == []


def test_bounded_sample(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("s"))
    n = {r.s: r["count"] for r in bounded_sample(df, "id", F.col("s"), 500).groupBy("s").count().collect()}
    assert 400 < n[0] < 600 and 400 < n[1] < 600
    assert bounded_sample(df, "id", F.col("s"), 10**6).count() == 20000


# language model


@pytest.mark.parametrize("head", [brown_lm.HEAD_WORDS, 40])
def test_base_scores_match_brute_force(docs, corpus, monkeypatch, head):
    monkeypatch.setattr(brown_lm, "HEAD_WORDS", head)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown_lm.scored(docs).collect())
    token = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in corpus if i is not None and not held(i) for x in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0), held(i), len(token(t)), sum(c[x] > 0 for x in token(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in token(t)), 6)) for i, t in corpus)
    assert got == want


@pytest.mark.parametrize("head", [brown_lm.HEAD_WORDS, 100])
def test_scores_match_a_recount(spark, prose, monkeypatch, head):
    """From the classes that were found: class bigrams, emissions and each text's probability by their definitions."""
    monkeypatch.setattr(brown_lm, "HEAD_WORDS", head)
    found = {}
    rounds, far = brown_lm.exchange_rounds, brown_lm.far_classes
    monkeypatch.setattr(brown_lm, "exchange_rounds", lambda *a, **k: found.setdefault("rounds", rounds(*a, **k)))
    monkeypatch.setattr(brown_lm, "far_classes", lambda *a, **k: found.setdefault("far", far(*a, **k)))
    texts = {i: prose(2000 + i, 5 + i % 60) + f" rare{i} Rare{i // 2}" for i in range(120)} | {500: None, 501: ""}
    got = {r.doc_id: r.score for r in brown_lm.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    token = lambda t: (t or "").encode().lower().split()
    learnt = [token(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for t in learnt for x in t)
    of, far = found["rounds"][0], {r.word.encode(): r["class"] for r in found["far"].collect()}
    size = len(of) - brown_lm.ENDINGS - 1
    assert size <= head and (head == 100 or size == len(c)) and bool(far) == (head == 100)
    ranked = sorted(c, key=lambda w: (-c[w], w.decode()))[:size]
    number = {w: int(of[k]) for k, w in enumerate(ranked)} | far
    last, k = brown_lm.CLASSES - 1, brown_lm.CLASSES
    cls = lambda w: number.get(w, int(of[size + brown_lm.ending(w)]))
    path = lambda t: [last, *map(cls, t), last]
    bigrams = collections.Counter(p for t in learnt for p in zip(path(t), path(t)[1:], strict=False))
    after, before = collections.Counter(), collections.Counter()
    for (x, y), n in bigrams.items():
        before[x] += n
        after[y] += n
    tokens, kinds = collections.Counter(), collections.Counter()
    for w, n in c.items():
        tokens[cls(w)] += n
        kinds[cls(w)] += 1
    tokens[last], kinds[last] = len(learnt), 1
    prior = lambda y: (after[y] + 1) / (sum(after.values()) + k)
    a, e = brown_lm.TRANSITION_PRIOR, brown_lm.EMISSION_PRIOR
    for i, t in texts.items():
        p, words = path(token(t)), [*token(t), None]
        want = sum(math.log10((bigrams[x, y] + a * prior(y)) / (before[x] + a)) + math.log10(((len(learnt) if w is None else c[w]) + e) / (tokens[y] + e * (kinds[y] + 1))) for x, y, w in zip(p, p[1:], words, strict=False))
        assert abs(got[i] - want) < 1e-6, i


def test_rounds_raise_the_likelihood(spark, monkeypatch):
    seen = []
    count = brown_lm._class_bigrams
    monkeypatch.setattr(brown_lm, "_class_bigrams", lambda *a: seen.append(count(*a)) or seen[-1])
    monkeypatch.setattr(brown_lm, "SEED_WORDS", 20)
    rng = random.Random(3)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.randint(0, 150)}" for k in range(80)) for _ in range(60)]
    brown_lm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(seen) >= 2 and brown_lm.likelihood(seen[1]) > brown_lm.likelihood(seen[0])


def test_model_probabilities_sum_to_one():
    table = np.random.default_rng(2).integers(0, 5, (brown_lm.CLASSES, brown_lm.CLASSES))
    m = brown_lm.ClassModel(table, table.sum(axis=0).astype(float), np.full(brown_lm.CLASSES, 3.0))
    assert np.allclose((10**m.transition).sum(axis=1), 1)


def test_exchange_finds_planted_classes():
    """Words of two kinds that follow each other end up in classes that the kinds don't share."""
    pairs = np.zeros((21, 21), np.int64)
    rng = np.random.default_rng(3)
    pairs[:10, 10:20] = rng.integers(5, 9, (10, 10))
    pairs[10:20, :10] = rng.integers(5, 9, (10, 10))
    of = brown_lm.exchange_clustering(pairs, 20, classes=6)
    assert not set(of[:10]) & set(of[10:20]) and set(of[:20]) <= set(range(5))


@pytest.mark.parametrize("classes", [3, 6])
def test_no_single_exchange_is_better(classes):
    pairs = np.random.default_rng(classes).integers(0, 20, (30, 30)).astype(float) ** 2

    def likelihood(of):
        m = np.zeros((30, classes))
        m[np.arange(30), of] = 1
        t = m.T @ pairs @ m
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    of = brown_lm.exchange_clustering(pairs, 29, classes=classes, sweeps=50)
    best = likelihood(of)
    for u in range(29):
        for c in range(classes - 1):
            moved = of.copy()
            moved[u] = c
            assert likelihood(moved) <= best + 1e-6


@pytest.mark.parametrize("head", [brown_lm.HEAD_WORDS, 1010])
def test_words_that_are_no_units_are_classed_by_their_contexts(spark, monkeypatch, head):
    """Words of one ending, most often between words of one of two kinds: in the head and beyond it."""
    monkeypatch.setattr(brown_lm, "HEAD_WORDS", head)
    rng, texts = random.Random(9), []
    kinds = [[f"{kind}{i}" for i in range(500)] for kind in "ab"]
    for _ in range(30):
        texts += [" ".join(rng.sample(kind, 500)) for kind in kinds]
    for k in range(240):
        texts.append(" ".join(x for _ in range(4) for x in (rng.choice(kinds[k % 2]), f"w{k % 60}xyz", rng.choice(kinds[k % 2]))))
    docs = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 or i < 60]
    probe = dict(zip((i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 7 == 2), ["a1 w0xyz a2", "b1 w0xyz b2", "b1 w1xyz b2", "a1 w1xyz a2"], strict=False))
    got = {r.doc_id: r.score for r in brown_lm.scored(spark.createDataFrame([*docs, *probe.items()], "doc_id long, text string")).collect()}
    score = {t: got[i] for i, t in probe.items()}
    assert score["a1 w0xyz a2"] > score["b1 w0xyz b2"] + 0.5 and score["b1 w1xyz b2"] > score["a1 w1xyz a2"] + 0.5


def test_empty_corpus_scores(nothing, docs):
    assert brown_lm.scored(nothing).collect() == []
    unseen = brown_lm.scored(docs.where("doc_id IS NULL")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in unseen] == [(0, 0, 0.0)]


# tokenizer


@needs_model
def test_pieces_equal_the_library(docs, corpus, words):
    import sentencepiece

    m, s = pieces.PieceModel.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    odd = ["", " ", "  a", "a  b   ", "▁x", "日本語 テスト 🤗🤗", "a" * 500, "<s> </s> <0x0A> <unk>", "tab\tnew\nline\x00", "=" * 300] + ["".join(rng.choice("ab ▁é\n=<0x>") for _ in range(40)) for _ in range(300)]
    for t in odd + [t for _, t in corpus if t]:
        assert m.encode(t).tolist() == s.encode(t), t[:80]
        assert m.decode(m.encode(t)).decode() == t.replace("▁", " "), t[:80]


@needs_model
def test_tokens_round_trip_through_tables(docs, corpus, nothing):
    tokens = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert tokens.columns == [*docs.columns, "token_ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in tokens.collect())
    got = pieces.summary(docs, MODEL, with_ids=True).collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) and r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<i4").tobytes()).hexdigest() for r in got)
    assert pieces.summary(nothing, MODEL).collect() == []


def unigram_model(scores):
    """A small unigram model file."""
    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    return piece("<unk>", 0, 2) + b"".join(piece(t, s) for t, s in scores.items()) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))


def test_viterbi_finds_the_best_split():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.1, "▁a": -3.5, "bc": -3.0, "abc": -7.0, "▁ab": -6.0, "cab": -4.5}
    m = pieces.PieceModel(unigram_model(scores))

    def best(t):
        if not t:
            return 0.0
        return max((best(t[:-k]) + scores[t[-k:]] for k in range(1, len(t) + 1) if t[-k:] in scores), default=-math.inf)

    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        ids = m.encode(t)
        assert abs(sum(m.score[i] for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1e-4
        assert m.decode(ids).decode() == t
    assert m.encode("aXXb").tolist() == [m.usable["▁a"], m.unknown, m.usable["b"]]


# archives


@pytest.fixture(scope="module")
def pages(spark, prose):
    rows = [(9, "http://www.b.example/x", "same"), (4, "https://a.example:443/x?q=1#f", "same"), (7, None, "same"), (1, "http://a.example/", None), (2, "http://a.example/", ""), (3, "not a url", prose(1, 5000)), (5, "http://[bad", "ü"), (6, "http://u:p@A.Example:8080/y z\r\nX: 1", "z" * 100), (None, "http://a.example/", "lone"), (8, "http://a.example/", "w\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, "http://hot.example/", f"page {i % 3}") for i in range(50)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(3)


def expected(rows):
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = low.get(h or "", None)
        kind = "response" if i == first else "revisit"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if i == first else first))
    return out


def test_archives_read_back(pages):
    rows, table = pages
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in warc.round_trip(table).collect()), key=key) == sorted(expected(rows), key=key)


def test_lookup_finds_all_captures(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows, table = pages
    folder = shared_dir(spark) + "/warc-test"
    captures = warc.write_archives(table, folder)
    index = warc.write_index(captures, folder, block_lines=4)
    want = [k for k in {warc.surt(u) for _, u, _ in rows}] + ["no,such)/", ""]
    found = warc.lookup(spark.createDataFrame([(k,) for k in want], "key string"), index, folder)
    assert collections.Counter(r.key for r in found.collect()) == collections.Counter(warc.surt(u) for _, u, _ in rows)
    records = warc.read_records(found, folder).collect()
    assert all(r.payload is None or len(r.payload) == r.payload_bytes for r in records)
    assert {r.page_id: bytes(r.payload) for r in records if r.payload is not None}[8] == b"w\r\n\r\nWARC/1.1\r\n"


def test_empty_pages(pages):
    _, table = pages
    assert warc.round_trip(table.limit(0)).collect() == []


def test_small_payloads_are_responses(spark, pages):
    rows, table = pages
    folder = shared_dir(spark) + "/warc-small"
    captures = warc.write_archives(table, folder, min_revisit_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_records(captures, folder).collect()}
    assert kinds[9] == kinds[7] == "response" and kinds[103] == "revisit"


def test_surt():
    assert warc.surt("http://user@WWW.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.surt("https://x.org:8443") == "org,x:8443)/"
    assert warc.surt(None) == warc.surt("") == "-"
