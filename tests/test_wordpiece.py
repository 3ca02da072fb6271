"""One pass with failure links against the longest-first loop."""

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weftwork.operators import wordpiece as W


def greedy(word, vocabulary):
    if word in vocabulary:
        return [word]
    return W.Pieces(dict.fromkeys(vocabulary, 0))._plain(word)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab#", min_size=1, max_size=4), max_size=8), st.lists(st.text("ab#", min_size=1, max_size=4), max_size=8), st.lists(st.text("ab#", min_size=1, max_size=9), max_size=6))
def test_pieces_are_those_of_the_longest_first_rule(first, inner, words):
    vocabulary = {p: k for k, p in enumerate(dict.fromkeys([*first, *("##" + p for p in inner)]))}
    p = W.Pieces(vocabulary)
    for w in words:
        assert p.cut(w) == greedy(w, vocabulary), (w, vocabulary)


def test_a_long_word_is_read_once():
    p = W.Pieces({"a": 0, "##a": 1, "##" + "a" * 50 + "b": 2})
    assert p.cut("a" * 100_000) == ["a", *["##a"] * 99_999] and p.cut("a" * 1000 + "c") == [W.UNKNOWN]


def parts(text):
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", (text or "")[:4096])
    text = re.sub("([一-鿿㐀-䶿豈-﫿])", r" \1 ", unicodedata.normalize("NFC", text))
    return [p for p in re.split(r"""([\s.,!?;:()\[\]{}<>"'`~@#$%^&*_+=\-/\\|]+)""", text) if p and not p.isspace()]


def test_ids_masks_and_padding(spark):
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "un": 4, "##aff": 5, "##able": 6, "中": 7, "é": 8, ",": 9, "a": 10, "##a": 11}
    rng = random.Random(1)
    texts = [None, "", "unaffable", "unaffable, 中文 un\x07aff", "é a,a", "a" * 5000, "a " * 900, "<a>\t文x", *("".join(rng.choice("a un,affable 中é\n-") for _ in range(rng.randint(0, 60))) for _ in range(60))]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, input string")
    table = spark.createDataFrame(list(vocabulary.items()), "piece string, id int")
    out = W.encode(d, table, most=32)
    got = {r.k: r for r in out.collect()}
    for k, t in enumerate(texts):
        want = [2]
        for w in parts(t):
            for piece in greedy(w, vocabulary):
                want.append(vocabulary.get(piece, 1))
        assert got[k].input_ids == [*want[:31], 3] and got[k].attention_mask == [1] * len(got[k].input_ids)
    full = W.padded(out, F.col("k") % 3).collect()
    for batch in range(3):
        rows = [r for r in full if r.batch == batch]
        longest = max(len(got[r.k].input_ids) for r in rows)
        for r in rows:
            n = len(got[r.k].input_ids)
            assert r.input_ids == got[r.k].input_ids + [0] * (longest - n) and r.attention_mask == [1] * n + [0] * (longest - n)
