"""Text buffers: chunks, nulls, slices and very long texts."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import common, simhash, suffix_dedup
from weftwork.llm.decontaminate import WordTable
from tests.llm.test_dedup import fingerprint


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=12), st.integers(1, 40), st.integers(1, 5), st.integers(0, 3))
def test_chunks_hold_whole_texts(texts, most, rows, skip):
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(texts, kind).slice(min(skip, len(texts)))
        want, got = [(t or "").encode() for t in texts[min(skip, len(texts)) :]], []
        for lo, hi, data, off in common.text_chunks(col, most, rows):
            assert 0 < hi - lo <= rows and lo == len(got) and off[0] == 0 and off[-1] == len(data)
            got += [data[off[k] : off[k + 1]].tobytes() for k in range(hi - lo)]
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB0 é\t\n.\x1f", max_size=20), min_size=1, max_size=6))
def test_word_spans_match_patterns(texts):
    data, off = common.text_buffers(pa.array(texts))
    for table, pattern, low in ((common.NOT_SPACE, r"[^\x20\x09-\x0D]+", False), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        d = common.LOWER[data] if low else data
        starts, ends, first = common.word_spans(d, off, table)
        for k, t in enumerate(texts):
            own = [d[s:e].tobytes().decode() for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert own == re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t) if low else t)


def test_text_longer_than_a_chunk(prose):
    long = prose(11, 500_000)
    assert len(long) > common.CHUNK_BYTES
    col = pa.array(["a b c d", long, None, ""])
    got = simhash.text_fingerprints(col)
    assert [int(x) for x in got[[0, 2, 3]]] == [fingerprint("a b c d"), 0, 0] and int(got[1]) == fingerprint(long)
    data, off = common.text_buffers(pa.array([long, long[:1000]]))
    p = suffix_dedup.Parse(data, off)
    assert abs(len(p.triggers) - len(long) / suffix_dedup.TRIGGER_ODDS) < len(long) / suffix_dedup.TRIGGER_ODDS * 0.2
    short = suffix_dedup.Parse(*common.text_buffers(pa.array([long[:1000]])))
    assert (p.triggers[p.doc == 1] - off[1] == short.triggers).all()


def test_equal_words_have_equal_hashes_anywhere():
    t = WordTable()
    data = np.frombuffer(b"abc xx abc abd", np.uint8)
    h = t.of(data, np.array([0, 7, 11, 4]), np.array([3, 10, 14, 6]))
    assert h[0] == h[1] and len({int(x) for x in h}) == 3
