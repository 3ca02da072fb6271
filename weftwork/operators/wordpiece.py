"""WordPiece: the longest piece first, in one pass over a word, and padded batches.

The vocabulary becomes a trie with failure links: where no edge goes on, what was read is given out as the pieces that
the longest-first rule would have cut by then, and matching goes on from the link, so no character is read twice.
Text is made ready natively: control characters become spaces, CJK characters stand alone, and words are cut
from runs of blanks and punctuation, which are parts of their own where they are more than blanks. Only the first
MOST_CHARS characters of a text are read and the first ``most`` ids are kept: a model takes no more.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.lineage import cut

# The pieces that a vocabulary names for itself, the mark of a piece within a word, and what parts words.
UNKNOWN, PAD, BEGIN, END, INNER = "[UNK]", "[PAD]", "[CLS]", "[SEP]", "##"
MOST_CHARS, MOST_IDS = 4096, 256
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_CJK = "([一-鿿㐀-䶿豈-﫿])"
_PARTING = r"""(?U)[\s.,!?;:()\[\]{}<>"'`~@#$%^&*_+=\-/\\|]+"""

#: Words that a worker remembers at most.
MOST_WORDS = 200_000
STEP_ROWS = 512


class Pieces:
    """A vocabulary's trie with failure links: ``next`` by state and character, ``link`` and ``given`` (pieces) by state."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.ids = vocabulary
        self.next: list[dict[str, int]] = [{}]
        own: list[str | None] = [None]
        self.inner = self._add(INNER, own)
        for piece in vocabulary:
            if piece and piece != INNER:
                own[self._add(piece, own)] = piece
        n = len(self.next)
        self.link: list[int | None] = [None] * n
        self.given: list[tuple[str, ...]] = [()] * n
        # states by depth, from the two roots; the way from one to the other is no way through a word
        rows = [(s, 0, c) for s, c in ((t, c) for c, t in self.next[0].items())] + [(t, self.inner, c) for c, t in self.next[self.inner].items()]
        on_the_way = self.next[0].get(INNER[0])
        while rows:
            after = []
            for state, parent, c in rows:
                if own[state] is not None:
                    self.link[state], self.given[state] = self.inner, (own[state],)
                else:
                    z, pieces = self.link[parent], list(self.given[parent])
                    while z is not None and c not in self.next[z]:
                        pieces += self.given[z]
                        z = self.link[z]
                    if z is not None:
                        self.link[state], self.given[state] = self.next[z][c], tuple(pieces)
                after += [(t, state, x) for x, t in self.next[state].items() if not (state == on_the_way and t == self.inner)]
            rows = after
        self.words: dict[str, list[int]] = {}

    def _add(self, text: str, own: list) -> int:
        state = 0
        for c in text:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                own.append(None)
            state = self.next[state][c]
        return state

    def cut(self, word: str) -> list[str]:
        """The word's pieces; the unknown piece alone if it can't be cut as a whole."""
        if word in self.ids:
            return [word]
        if word.startswith(INNER[0]):
            return self._plain(word)  # it would walk along the marks of inner pieces
        state, out = 0, []
        for c in word:
            while c not in self.next[state]:
                if self.link[state] is None:
                    return [UNKNOWN]
                out += self.given[state]
                state = self.link[state]
            state = self.next[state][c]
        while state != self.inner:
            if self.link[state] is None:
                return [UNKNOWN]
            out += self.given[state]
            state = self.link[state]
        return out

    def _plain(self, word: str) -> list[str]:
        """Longest first by the definition."""
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = (INNER if at else "") + word[at:end]
                if piece in self.ids:
                    out.append(piece)
                    at = end
                    break
            else:
                return [UNKNOWN]
        return out

    def of(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            known = self.words[word] = [self.ids.get(p, self.ids.get(UNKNOWN, 100)) for p in self.cut(word)]
        return known


def words(text: Column) -> Column:
    """Parts of a text in order: words, and runs of blanks and punctuation that are more than blanks."""
    short = F.substring(F.coalesce(text, F.lit("")), 1, MOST_CHARS)
    spaced = F.regexp_replace(F.regexp_replace(short, _CONTROL, " "), _CJK, " $1 ")
    parts = F.regexp_extract_all(spaced, F.lit(f"{_PARTING}|[^{_PARTING[5:-2]}]+"), F.lit(0))
    return F.filter(parts, lambda w: F.rlike(w, F.lit(r"(?U)\S")))


def encode(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text", most: int = MOST_IDS) -> DataFrame:
    """The documents with ``input_ids`` and ``attention_mask``; vocabulary: (piece, id), the table that a model comes with."""
    pieces = {r.piece: r.id for r in vocabulary.select("piece", "id").collect()}
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    begin, end = pieces.get(BEGIN, 101), pieces.get(END, 102)
    names = [*docs.columns, "input_ids"]
    # composed characters have no native function, so words are composed where they are cut
    ready = docs.select(*docs.columns, words(F.col(text_col)).alias("_words"))
    k = len(docs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        p = Pieces(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, STEP_ROWS):
                part = b.slice(lo, STEP_ROWS)
                out = []
                for row in part.column(k).to_pylist():
                    ids = [begin]
                    for w in row:
                        ids += p.of(unicodedata.normalize("NFC", w))
                        if len(ids) >= most - 1:
                            break
                    out.append([*ids[: max(1, most - 1)], end][:most])
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(out, pa.list_(pa.int32()))], names=names)

    found = ready.mapInArrow(run, f"{fields}, input_ids array<int>")
    return found.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))


def padded(encoded: DataFrame, batch: Column, pad: int = 0) -> DataFrame:
    """The rows with ids and masks filled up to the longest of their batch, which ``batch`` names; batches are of a model's size."""
    rows = cut(encoded.withColumn("batch", batch))
    n = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_n") - F.size(c))).alias(c)
    rest = [c for c in rows.columns if c not in ("input_ids", "attention_mask")]
    return rows.withColumn("_n", n).select(*rest, fill("input_ids", pad), fill("attention_mask", 0))
