"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

One pass over a text visits, at each position, the pieces that end there (the automaton's node and
its output links) and relaxes what is known of the prefix. For a unigram model that is Viterbi: the
best score of the prefix is the best over pieces of the score before the piece plus the piece's.

Scores of a BPE model are merge ranks and not log-probabilities, so the best-scoring split is not
what such a model encodes. There the same pass relaxes by compatibility: the encoding of a prefix ends
in the one piece that ends here and that the model would not merge with the last piece of the prefix
before it, a property of two pieces that is computed once for each pair. That gives exactly the
model's merges, in linear time.

Where no piece holds a space marker after another character, text is encoded in words (with their
leading markers) and each worker remembers the words that it met, up to a bound.

Edge cases: a null or empty text has no tokens and decodes to the empty text; characters outside the
vocabulary become byte pieces, or the unknown piece if the model has none (then the text does
not come back, and the result says so); of splits with equal scores, that with the piece met first at the
position stays, which the automaton gives from the longest to the shortest; rows that repeat are encoded alike, whatever their ids;
a very long text is encoded word by word as any other, or in one pass where pieces hold inner markers; an
empty table gives an empty one; extra columns may have any name, and a new column gives way to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftwork.llm.common import arrow_rows, fresh, schema_of, tidy

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers at most; then it starts anew. And pieces pairs likewise.
MOST_WORDS, MOST_PAIRS = 400_000, 500_000
UNKNOWN_PENALTY = 10.0
#: Rows that are handed on at a time.
STEP_ROWS = 256


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message, by number."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[i : i + size]
            i += size


class PieceModel:
    """A SentencePiece model file: its pieces, kind, and the automaton over its normal pieces."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, raw: bytes) -> None:
        pieces, self.kind, prefix, squeeze, escape, charsmap = [], UNIGRAM, True, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, bytes(4)), np.float32)[0]), p.get(3, self.NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                n = dict(_fields(value))
                charsmap, prefix, squeeze, escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if charsmap or squeeze or not escape or self.kind not in (UNIGRAM, BPE) or any(k == self.USER for _, _, k in pieces):
            raise ValueError("only identity-normalised unigram or BPE models that keep white space and have no user pieces are supported")
        self.dummy_prefix = prefix
        self.text = [t for t, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.usable = {t: i for i, (t, _, k) in enumerate(pieces) if k == self.NORMAL}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == self.UNKNOWN), 0)
        self.byte_piece = {int(t[3:-1], 16): i for i, (t, _, k) in enumerate(pieces) if k == self.BYTE}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.usable.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        kinds = [k for _, _, k in pieces]
        self.decoded = [bytes([int(t[3:-1], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else t.replace(MARK, " ").encode() for t, k in zip(self.text, kinds, strict=True)]
        self.splits = not any(MARK in t.lstrip(MARK) for t in self.usable)
        self.lowest = min((self.score[i] for i in self.usable.values()), default=0.0)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read())

    def merged(self, word: str) -> list[int]:
        """BPE by its definition: again and again the best-ranked pair of neighbours, the leftmost of equals. None stands for an unknown character."""
        parts: list[str] = list(word)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.usable.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return [self.usable.get(x) for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the model leaves these two pieces side by side as they are."""
        key = left * len(self.text) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def best_path(self, word: str) -> list[int | None]:
        """Pieces of a normalised text in one pass over the automaton; None for a character that no piece covers."""
        n = len(word)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, hit in self.automaton.iter(word):
            ends[last + 1].append(hit)
        piece: list[int | None] = [None] * (n + 1)
        before = [0] * (n + 1)
        if self.kind == UNIGRAM:
            best = [0.0] + [-np.inf] * n
            for e in range(1, n + 1):
                for i, size in ends[e]:
                    s = best[e - size] + self.score[i]
                    if s > best[e]:
                        best[e], piece[e], before[e] = s, i, e - size
                if best[e] == -np.inf or not any(size == 1 for _, size in ends[e]):
                    s = best[e - 1] + self.lowest - UNKNOWN_PENALTY
                    if s > best[e]:
                        best[e], piece[e], before[e] = s, None, e - 1
        else:
            reached = [True] + [False] * n
            for e in range(1, n + 1):
                for i, size in ends[e]:
                    b = e - size
                    if reached[b] and (not b or piece[b] is None or self.stays_apart(piece[b], i)) and self.whole(i):
                        piece[e], before[e], reached[e] = i, b, True
                        break
                if not reached[e] and word[e - 1] not in self.usable and reached[e - 1]:
                    piece[e], before[e], reached[e] = None, e - 1, True
            if not reached[n]:
                return self.merged(word)
        out, e = [], n
        while e:
            out.append(e)
            e = before[e]
        return [piece[e] for e in reversed(out)]

    def whole(self, i: int) -> bool:
        """Whether the model's merges can make the piece at all."""
        known = self.pairs.get(-1 - i)
        if known is None:
            known = self.pairs[-1 - i] = self.merged(self.text[i]) == [i]
        return known

    def ids(self, word: str) -> list[int]:
        """Piece ids of a normalised text, bytes for what no piece covers."""
        path = self.best_path(word)
        if None not in path:
            return path
        out, at = [], 0
        for i in path:
            if i is None:
                raw = word[at].encode()
                if all(x in self.byte_piece for x in raw):
                    out += [self.byte_piece[x] for x in raw]
                elif not out or out[-1] != self.unknown or at == 0:
                    out.append(self.unknown)
                at += 1
            else:
                out.append(i)
                at += len(self.text[i])
        return out

    _WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text as int32."""
        if not text:
            return np.zeros(0, np.int32)
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.splits:
            return np.array(self.ids(text), np.int32)
        words = self._WORD.findall(text)
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > MOST_WORDS:
                self.words.clear()
                new = set(words)
            for w in new:
                self.words[w] = np.array(self.ids(w), np.int32).tobytes()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a text from its piece ids."""
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return raw[1:] if self.dummy_prefix and raw.startswith(b" ") else raw


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    """Arrays of ids as one Arrow list column."""
    off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


_MODELS: dict[bytes, PieceModel] = {}


def _model(raw: bytes) -> PieceModel:
    """The model, kept with the words it has met for the next task of this worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(raw)
    return _MODELS[key]


def _held(docs: DataFrame, model_path: str):
    """The model file as a broadcast: a file of fixed size, some 0.5 MB."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """The documents with a column of piece ids (empty for a null text)."""
    (name,) = fresh(docs, out_col)
    columns, held = docs.columns, _held(docs, model_path)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches):
        model = _model(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, STEP_ROWS):
                part = b.slice(lo, STEP_ROWS)
                ids = [model.encode(t or "") for t in part.column(columns.index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, id_lists(ids)], names=[*columns, name])

    return docs.mapInArrow(tidy(run), out)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """The rows with a column of text made from piece ids."""
    (name,) = fresh(tokens, out_col)
    columns, held = tokens.columns, _held(tokens, model_path)
    out = T.StructType([*tokens.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        model = _model(held.value)
        for b in batches:
            col = b.column(columns.index(ids_col))
            texts = [model.decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, name])

    return tokens.mapInArrow(tidy(run), out)


def summary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: tokens, byte tokens, SHA-256 of the ids (32-bit little-endian), whether decoding gives the text again, and the ids if asked for."""
    held = _held(docs, model_path)
    ids_field = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    out = T.StructType([*schema_of(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), *ids_field])

    def run(batches):
        model = _model(held.value)
        is_byte = np.zeros(len(model.text), bool)
        is_byte[list(model.byte_piece.values())] = True
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(lo, STEP_ROWS)
                rows, every = {c: [] for c in ("n_tokens", "n_byte_tokens", "ids_sha256", "round_trip")}, []
                for t in b.column(1):
                    t = t.as_py() or ""
                    ids = model.encode(t)
                    for c, v in zip(rows, (len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), model.decode(ids) == t.encode()), strict=True):
                        rows[c].append(v)
                    if with_ids:
                        every.append(ids)
                yield arrow_rows({id_col: b.column(0), **rows} | ({"token_ids": id_lists(every)} if with_ids else {}), out)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), out)
