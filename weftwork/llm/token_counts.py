"""Token counts without encoding: pre-tokens that are one token are looked up, only the rest is merged.

A word-level BPE drops white space before anything else, so a text's count is the sum of the counts of its
chunks, the runs between ASCII white space, and a chunk's count that of its pre-tokens; neither depends on
what stands around it. Which vocabulary strings encode alone as one token is proved once, before the job: each
goes through the whole way of a chunk (special strings, normaliser, pre-tokens, merges) and is kept if one token
comes out. Those strings are a table, sent to the tasks with the merges; its size is that of the vocabulary. In
a task pre-tokens are counted straight from the table; one that is not in it is merged by rank and remembered, up
to a bound.

ASCII text is lower-cased and cut into pre-tokens here, a text at once. Chunks with other characters are
normalised and cut by the normaliser and pre-tokenizer that the tokenizer file describes, so that tables of
the Unicode standard are those of the library; they are remembered likewise, as are chunks with special strings.

Edge cases: a null or empty text has no tokens; the strings of special tokens count one token wherever
they stand, since the library finds them before it normalises; a long text is cut at white space into runs of about
RUN_CHARS; a run of letters without white space is merged by a heap in O(n log n) and not remembered; rows are
judged one by one, so repeated rows and ids are no special case; a text of exactly ``most`` tokens is not over the
limit; an empty table gives an empty one; extra columns are not read, and results give way to an id column of
their name.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftwork.llm.common import arrow_rows, fresh, schema_of, tidy

#: Pre-tokens, and chunks beyond ASCII, that a worker remembers besides the table, and the longest of them.
MOST_KNOWN, LONGEST_KNOWN = 800_000, 64
#: Characters of text that are cut into pre-tokens at a time.
RUN_CHARS = 1 << 20
#: Symbols from which on merges are taken from a heap.
HEAP_FROM = 48
#: Rows that are handed on at a time.
STEP_ROWS = 1024
#: More tokens than this are over the limit.
MOST_TOKENS = 2048
#: What the tokenizer files that are understood cut pre-tokens by; a fixed value of their format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on lower-case ASCII without white space.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
_BLANK = re.compile(r"[\t-\r ]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it can be printed, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Known(dict):
    """Counts by string: a table that stays, and what was worked out besides, up to a bound."""

    def __init__(self, work_out, table=()) -> None:
        super().__init__(table)
        self.work_out, self.table = work_out, tuple(table)

    def __missing__(self, key: str) -> int:
        n = self.work_out(key)
        if len(key) <= LONGEST_KNOWN:
            if len(self) >= len(self.table) + MOST_KNOWN:
                self.clear()
                self.update(self.table)
            self[key] = n
        return n


class Counter:
    """Numbers of tokens of a tokenizer file's JSON; ``whole`` is the table of strings that are one token."""

    def __init__(self, spec: str, whole: list[str] | None = None) -> None:
        s = json.loads(spec)
        model, cut, norm = s["model"], s["pre_tokenizer"]["pretokenizers"], s["normalizer"]["normalizers"]
        known = (
            model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["ignore_merges"] and not model["dropout"] and s["post_processor"] is None
            and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"}
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in s["added_tokens"])
        )
        if not known:
            raise ValueError("only word-level BPE files that drop white space and have plain special tokens are supported")
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in s["added_tokens"]), key=len, reverse=True)) or r"(?!)")
        self.spec, self.library = spec, None
        self.pre_token, self.chunk = _Known(self.merged), _Known(self.count)
        self.whole = whole if whole is not None else self.prove()
        self.pre_token = _Known(self.merged, [(w if w.isascii() else "".join(self.symbols_of(w)), 1) for w in self.whole])

    def prove(self) -> list[str]:
        """Vocabulary strings that alone become one token, each taken the whole way of a chunk."""
        back = {c: b for b, c in enumerate(self.symbols)}
        ended = (t[: -len(self.end)] for t in self.vocab if t.endswith(self.end)) if self.end else self.vocab
        raw = {bytes(back[c] for c in t) for t in ended if t and all(c in back for c in t)}
        return sorted(w.decode() for w in raw if w.split() == [w] and self._readable(w) and self.count(w.decode()) == 1)

    @staticmethod
    def _readable(raw: bytes) -> bool:
        try:
            return bool(raw.decode())
        except UnicodeDecodeError:
            return False

    def symbols_of(self, text: str) -> list[str]:
        """Byte symbols of the pre-tokens of a text without special strings, by the tokenizer file's own description."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def merged(self, token: str) -> int:
        """Tokens of one pre-token, in ASCII or as byte symbols (which are printable and so stand for themselves)."""
        return self._merged(token if token.isprintable() else "".join(self.symbols[b] for b in token.encode()))

    def _merged(self, symbols: str) -> int:
        """Tokens of one pre-token's byte symbols: again and again the best-ranked pair of neighbours, the leftmost of equals."""
        part = list(symbols)
        part[-1] += self.end
        if len(part) >= HEAP_FROM:
            return self._merged_by_heap(part)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get((a, b), none) for a, b in zip(part, part[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank.get((part[k], part[k + 1]), none)
            if k:
                ranks[k - 1] = rank.get((part[k - 1], part[k]), none)
        return len(part)

    def _merged_by_heap(self, part: list[str]) -> int:
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, k + 1, part[k] + part[k + 1]) for k in range(n - 1) if (r := self.rank.get((part[k], part[k + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if part[i] is None or after[i] != j or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, b, part[a] + part[b]))
        return left

    def count(self, chunk: str) -> int:
        """Tokens of a chunk: one for each special string in it, and those of the pre-tokens between them."""
        total, at = 0, 0
        for m in [*self.special.finditer(chunk), None]:
            total += m is not None
            piece, at = chunk[at : m.start() if m else len(chunk)], m.end() if m else 0
            total += self.plain(piece) if piece.isascii() else sum(map(self.pre_token.__getitem__, self.symbols_of(piece)))
        return total

    def plain(self, text: str) -> int:
        """Tokens of ASCII text without special strings."""
        return sum(map(self.pre_token.__getitem__, _ASCII.findall(text.lower())))

    def text(self, text: str) -> int:
        total = 0
        while len(text) > RUN_CHARS and (cut := _BLANK.search(text, RUN_CHARS)):
            total, text = total + self._run(text[: cut.start()]), text[cut.start() :]
        return total + self._run(text)

    def _run(self, text: str) -> int:
        if text.isascii() and not self.special.search(text):
            return self.plain(text)
        special = self.special.search(text) is not None
        own, plain = [], []
        for w in text.encode().split():
            (plain if w.isascii() and not (special and self.special.search(w.decode())) else own).append(w)
        return self.plain(b" ".join(plain).decode()) + sum(self.chunk[w.decode()] for w in own)


_COUNTERS: dict[int, Counter] = {}


def _counter(spec: str, whole: list[str]) -> Counter:
    """The counter, kept with the pre-tokens it has met for the next task of this worker."""
    key = hash((spec, len(whole)))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(spec, whole)
    return _COUNTERS[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, token) of the vocabulary strings that are proved to encode alone as one token: the table of the shortcut."""
    c = Counter(_read(path))
    token = {w: c.vocab.get(("".join(c.symbols_of(w))) + c.end, -1) for w in c.whole}
    return spark.createDataFrame(list(token.items()), "chunk string, token int")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """Per document: id, UTF-8 bytes, tokens, whether they are more than ``most``."""
    spec = _read(path)
    held = docs.sparkSession.sparkContext.broadcast((spec, Counter(spec).whole))  # the tokenizer file and its table, some 3 MB
    key = docs.select(id_col)
    n_bytes, n_tokens, over = fresh(key, "n_bytes", "n_tokens", "over_limit")
    out = T.StructType([*schema_of(docs, id_col), T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType()), T.StructField(over, T.BooleanType())])

    def run(batches):
        counter = _counter(*held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(lo, STEP_ROWS)
                size, tokens = [], []
                for t in b.column(1):
                    text = t.as_py() or ""
                    size.append(len(text) if text.isascii() else len(text.encode()))
                    tokens.append(counter.text(text))
                yield arrow_rows({id_col: b.column(0), n_bytes: size, n_tokens: tokens, over: [n > most for n in tokens]}, out)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), out)
