"""Whole-token counts, the filter audit and spelling variants against libraries, plain loops and brute force."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftwork.llm import filter_audit, spelling, token_counts
from weftwork.llm.common import stored

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts._read(WORD_BPE))


def tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


# --- token counts


def test_the_table_holds_just_the_strings_that_are_one_token(library, counter):
    assert len(counter.whole) > 30_000
    assert all(tokens(library, w) == 1 for w in counter.whole)
    table, back = set(counter.whole), {c: b for b, c in enumerate(counter.symbols)}
    for t in counter.vocab:
        raw = bytes(back[c] for c in t.removesuffix("</w>"))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert not (raw.split() == [raw] and tokens(library, text) == 1 and text not in table)


POOLS = [
    [chr(c) for c in range(128)], [chr(c) for c in range(0x250)], [chr(c) for c in range(0x300, 0x3000)], [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000],
    list("aeißÉé'sStTdDmMvr0 é̇İΣσς<|>endoftext\n\u0085\xa0 \x1c\x1d\x1f"),
]


@pytest.mark.parametrize("pool", range(len(POOLS)))
def test_counts_of_any_text_are_the_librarys(library, counter, pool):
    rng = random.Random(pool)
    for _ in range(1500):
        s = "".join(rng.choice(POOLS[pool]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            s = s[:7] + "<|endoftext|>" + s[7:] + "<|StartOfText|><|startoftext|>"
        assert counter.text(s) == tokens(library, s), s


def test_long_chunks_are_merged_by_the_heap_alike(library, counter):
    rng = random.Random(1)
    for size in (47, 48, 49, 200, 20_000):
        s = "".join(rng.choice("theaindo") for _ in range(size))
        assert counter.text(s) == tokens(library, s)


def test_a_long_text_is_counted_in_runs(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN_CHARS", 50)
    monkeypatch.setattr(token_counts, "MOST_KNOWN", 20)
    rng = random.Random(3)
    for _ in range(50):
        s = "".join(rng.choice(["the ", "Été\n", "x" * 60, "<|endoftext|>", "'s", " 12", "\x0b", "ñandú,", "fooBar "]) for _ in range(200))
        assert counter.text(s) == tokens(library, s)


def test_token_counts_of_documents(spark, library, docs, corpus, nothing):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD_BPE).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), tokens(library, t), tokens(library, t) > 2048) for i, t in corpus)
    assert got == want
    assert token_counts.token_counts(nothing, WORD_BPE).count() == 0
    clash = docs.withColumnRenamed("doc_id", "n_tokens")
    assert token_counts.token_counts(clash, WORD_BPE, id_col="n_tokens").columns == ["n_tokens", "n_bytes", "_n_tokens", "over_limit"]


def test_a_text_at_the_limit_is_not_over_it(spark, library):
    d = spark.createDataFrame([(1, "the " * 2048), (2, "the " * 2049)], "doc_id long, text string")
    assert {r.doc_id: r.over_limit for r in token_counts.token_counts(d, WORD_BPE).collect()} == {1: False, 2: True}


def test_whole_tokens_as_a_table(spark, library):
    rows = token_counts.whole_tokens(spark, WORD_BPE).limit(300).collect()
    assert all(library.encode(r.chunk, add_special_tokens=False).ids == [r.token] for r in rows)


def test_other_kinds_of_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        token_counts.Counter(token_counts._read(public_tokenizers.path("byte_bpe_50k.json")))


# --- filter audit


def audited(rows, labels):
    """The audit by its definition, one document and order at a time."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        t, low = text or "", [j for j, u, _ in rows if j is not None and (u or "") == (text or "")]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j < i for j in low),
        }
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in here if d[1][f]]
                kept = [d for d in here if not d[1][f]]
                all_failing = [d for d in docs if d[0] == part and d[1][f]]
                unique = [d for d in all_failing if sum(d[1].values()) == 1]
                out[part, "".join(order), step] = [len(kept), len(gone), len(all_failing) - len(gone), len(unique), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
                here = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_the_audit_is_that_of_plain_loops(spark, prose):
    rng = random.Random(5)
    texts = [None, "", prose(1, 250), prose(1, 250) + " #", prose(2, 300).upper(), "ab " * 300, prose(3, 100), "A$ " * 10, prose(4, 9000), "日本 ünï " * 120]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)] + [(7, texts[2], "en"), (7, texts[2], "en"), (None, "", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 30, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = as_audit(filter_audit.filter_audit(d, marks))
    assert got == audited(rows, labels) and len(got) % 600 == 0


def test_the_audit_of_nothing_and_without_labels(spark, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(nothing, marks).count() == 0
    d = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en")], "doc_id long, text string, lang string")
    assert as_audit(filter_audit.filter_audit(d, marks)) == audited([(1, "a b", "en"), (2, "a b", "en")], [])


def test_counts_are_handed_on_before_there_are_too_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 2)
    rows = [(k, "a b" * (k % 3), f"l{k % 7}") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    marks = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    assert as_audit(filter_audit.filter_audit(d, marks)) == audited(rows, [(3, 1, 1)])


def test_the_lookup_has_a_row_for_each_mask():
    orders, first = filter_audit.first_failures()
    assert first.shape == (32, 120)
    for m, o in itertools.product(range(32), range(120)):
        assert first[m, o] == next((s for s, f in enumerate(orders[o]) if m >> f & 1), 5)


# --- spelling variants


def variants(rows):
    """By the definition, with a dictionary of words with one place left open."""
    counts, lower = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    vocabulary = {w: n for w, n in counts.items() if n >= 5}
    near, open_at = defaultdict(set), defaultdict(set)
    for w in vocabulary:
        for k in range(len(w)):
            open_at[w[:k], w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in vocabulary:
                near[w].add(x)
                near[x].add(w)
    for group in open_at.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        if best is not None and vocabulary[best] >= 5 * n:
            form[w] = best
    out = {}
    for w, n in vocabulary.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), vocabulary[form[w]] if w in form else None, root)
    return out


def as_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled():
    """Texts of words with errors at every place, chains of forms, doubled letters, and a word of a few hundred letters."""
    rng = random.Random(9)
    base = ["cathedral", "aaaaaa", "aaaaaaa", "aabbaa", "université", "straßen", "letter", "lettter", "Ünïcode", "x" * 300, "abcdef", "abcdeg"]
    words = []
    for w in base:
        words += [w] * 30
        for _ in range(60):
            k, c = rng.randrange(len(w)), rng.choice("abeé")
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])] * rng.choice([1, 5, 6])
    words += ["kkkkkka"] * 5 + ["kkkkkkb"] * 25 + ["kkkkkbb"] * 125 + ["kkkkbbb"] * 625 + ["kkkbbbb"] * 3125
    rng.shuffle(words)
    return [(None, None), (1, ""), *((k // 3 if k % 50 else None, " ".join(words[k::120]) + (" 12 don't×÷ "[k % 5 :])) for k in range(120))]


def test_variants_are_those_of_brute_force(spark, spelled):
    d = spark.createDataFrame([(*r, "w", 1, "f") for r in spelled], "doc_id long, text string, word string, n int, form string").repartition(4)
    got, want = as_variants(spelling.spelling_variants(d)), variants(spelled)
    assert got == want
    assert any(r[2] and r[4] != r[2] for r in want.values()) and max(r[1] for r in want.values()) > 5


@pytest.mark.parametrize(("bucket", "run"), [(1, 1), (3, 2), (10, 1000), (1000, 5)])
def test_split_buckets_and_short_runs_lose_nothing(spark, spelled, bucket, run):
    d = spark.createDataFrame(spelled, "doc_id long, text string")
    vocabulary = stored(spelling.words(d).where("n >= 5"), "vocabulary")
    want = {w: (n[1], n[0]) for w, n in variants(spelled).items()}
    got = defaultdict(lambda: [0, None])
    for r in spelling.near_words(vocabulary, bucket, run).collect():
        got[r.word][0] += r.n_near
    assert {w: got[w][0] for w in want} == {w: v[0] for w, v in want.items()}


def test_variants_of_odd_documents(spark, docs, corpus, nothing):
    assert as_variants(spelling.spelling_variants(docs)) == variants(corpus)
    assert spelling.spelling_variants(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_registered_queries(spark, library):
    from weftwork.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_variants(QUERIES["op13_spelling_variants"](spark, SF)) == variants(rows)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op11_whole_token_counts"](spark, SF).collect()}
    assert got == {i: (len((t or "").encode()), tokens(library, t)) for i, t in rows}


def test_the_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    a = spelling.Automaton(words)
    assert a.count == len(words)
    for k, w in enumerate(words):
        state, number = a.root, 0
        for c in w:
            (e,) = [e for e in range(a.first[state], a.first[state + 1]) if a.char[e] == ord(c)]
            state, number = a.target[e], number + a.skip[e]
        assert a.final[state] and number == k
    after = {s: {w[len(s) :] for w in words if w.startswith(s)} for s in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(a.final) == len({frozenset(x) for x in after.values()})
