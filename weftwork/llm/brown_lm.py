"""Language-model scores from Brown's class-based bigrams.

Word counts are gathered over the whole training corpus. Words are dealt to classes by exchange, in two
steps. A start: the ``SEED_WORDS`` most frequent words, and all others in pools by their ending, are exchanged
one by one, as long as the likelihood of the class bigrams rises. Then rounds over all words that occur ``LEAST_CLASSED`` times or more, those
of the start too: each round gathers, over the whole corpus, the classes before and after each word, and
moves every word at once to the class under which they are most likely; rounds go on as long as the
likelihood of the class bigrams rises, ``ROUNDS`` at most. Words beyond the broadcast head get the class
that their gathered contexts make most likely when the rounds have ended. Rarer and unknown words share
pools by their ending, and a pool is exchanged like a word. Class bigrams are counted on the final classes.

A text's probability is the product over its tokens of P(class | class before) and P(word | class), both
smoothed; it begins after an end token, and the last token is an end.

Counts of frequent words (``HEAD_WORDS`` at most) go to the executors as a broadcast of bounded size. All
other words of a text, which grow with the corpus, are joined with their counts and classes by a shuffle,
so every token gets its exact count and its word's own class at any size.

Edge cases: a null or empty text is one end token; a null id is scored but not learned from; rows
with the same id are scored one by one, and learned from as often as they stand; words that tie in
frequency are ranked by their bytes, classes that tie by number; a very long text is one row of numbers;
with nothing to learn from, base scores are 0 and the model knows the unknown word alone; an empty table
gives an empty one; columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import arrow_rows, fold, schema_of, stored, text_buffers, tidy

#: The broadcast head, the words of the start, pools of rare and unknown words, and classes (the last is the end's own).
HEAD_WORDS, SEED_WORDS, ENDINGS, CLASSES = 200_000, 1000, 256, 64
#: A word has a class of its own from so many occurrences on.
LEAST_CLASSED = 3
ROUNDS = 2
EMISSION_PRIOR, TRANSITION_PRIOR = 0.5, 20.0
#: Words that a task counts before it passes counts on, and rows of contexts in a batch.
MOST_COUNTED, MOST_CONTEXTS = 400_000, 1 << 16
#: Words whose contexts are one row, so that a key in it takes 16 bits.
BLOCK_WORDS = (1 << 16) // (2 * CLASSES)
BLOCK_KEYS = BLOCK_WORDS * 2 * CLASSES
#: The end token; no word is empty.
END = ""


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[list[bytes]]:
    """Words of each text: A-Z in lower case, split at ASCII white space."""
    for t in batch.column(k):
        yield (t.as_py() or "").encode().lower().split()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all tokens, ends included."""

    def count(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for words in _texts(b, 0):
                held.update(words)
                held[b""] += 1
                if len(held) > MOST_COUNTED:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select(text_col).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Numbers of words: those of the head by rank, others after them by the pool of their ending, then the end."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w.encode(), i) for i, w in enumerate(words))
        self.size = len(words)
        self.end = self.size + ENDINGS

    def __missing__(self, word: bytes) -> int:
        return self.size + ending(word)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def sequences(col: pa.Array, end: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers of texts with an end before and after each, and where a number and the next are of one text."""
    data, off = text_buffers(col)
    off = off // 4
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        own = np.frombuffer(data[4 * off[lo] : 4 * off[hi]].tobytes(), np.int32)
        size = np.diff(off[lo : hi + 1])
        s = np.full(len(own) + 2 * (hi - lo), end, np.int64)
        s[np.arange(len(own)) + 2 * np.repeat(np.arange(hi - lo), size) + 1] = own
        inside = np.ones(len(s), bool)
        inside[np.cumsum(size + 2) - 1] = False
        yield s, inside[:-1]
        lo = hi


def seed_bigrams(numbered: DataFrame, end: int, unit) -> np.ndarray:
    """Counts of neighbours among the units of the start, which ``unit`` gives for each number. The table's size does not depend on the corpus."""
    size = SEED_WORDS + ENDINGS + 1

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for s, inside in sequences(b.column(0), end):
                x = unit.value[s]
                total += np.bincount((x[:-1] * size + x[1:])[inside], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = numbered.select("ids").mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def exchange_clustering(pairs: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """Class of each unit. Unit ``fixed`` (the end) keeps a class of its own, the last.

    Each sweep takes every unit out of its class and puts it where the sum of n log n over class
    bigrams, less that over the classes, is greatest; it ends when nothing moves (or after ``sweeps``).
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    size = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-size, kind="stable")
    order = order[(order != fixed) & (size[order] > 0)]
    of = np.zeros(n, np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[fixed] = classes - 1
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = pairs @ member, pairs.T @ member  # of each unit with each class after and before it
    table = member.T @ right
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    least = max(1e-9, 1e-13 * float(xlogx(pairs.sum())))  # what rounding can feign is no gain
    moved = 1
    while moved and (sweeps is None or sweeps > 0):
        moved, sweeps = 0, None if sweeps is None else sweeps - 1
        for u in order:
            a = of[u]
            r, c, own = right[u].copy(), left[u].copy(), pairs[u, u]
            r[a] -= own  # with the other members of its class
            c[a] -= own
            table[a, :] -= right[u]
            table[:, a] -= left[u]
            table[a, a] += own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (xlogx(table + r) - xlogx(table)).sum(axis=1) + (xlogx(table + c[:, None]) - xlogx(table)).sum(axis=0)
            d = np.diag(table)
            gain += xlogx(d + r + c + own) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            gain -= xlogx(rows + c + r.sum() + own) - xlogx(rows + c) + xlogx(cols + r + c.sum() + own) - xlogx(cols + r)
            b = int(np.argmax(gain[: classes - 1]))
            if gain[b] <= gain[a] + least:
                b = a
            if a != b:
                moved += 1
                of[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
            table[b, :] += right[u]
            table[:, b] += left[u]
            table[b, b] -= own
    return of


class ClassModel:
    """Class bigrams, and logarithms (base 10) of transitions and of each class's emission denominator."""

    def __init__(self, table: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> None:
        after = table.sum(axis=0)
        prior = (after + 1) / (after.sum() + CLASSES)
        self.transition = np.log10((table + TRANSITION_PRIOR * prior) / (table.sum(axis=1, keepdims=True) + TRANSITION_PRIOR))
        # one slot of each class is for all words that it has not seen; the end is the only word of its class
        self.below = np.log10(tokens + EMISSION_PRIOR * (words + 1))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, but for what does not depend on the classes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(table) - f(table.sum(axis=1)) - f(table.sum(axis=0))


def likely(table: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row of counts of the classes before and after a word, the class (but the end's) that makes them most likely."""
    t = table[:-1] + TRANSITION_PRIOR * (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
    u = table[:, :-1].T + TRANSITION_PRIOR * (table.sum(axis=1) + 1) / (table.sum() + CLASSES)
    return np.argmax(after @ np.log(t / t.sum(axis=1, keepdims=True)).T + before @ np.log(u / u.sum(axis=1, keepdims=True)).T, axis=1)


def pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of one block, by planes of bytes: most planes of small counts are zeros, which shuffle and storage compress away."""
    return key.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(10, -1)
    return np.ascontiguousarray(planes[:2].T).view("<u2").ravel(), np.ascontiguousarray(planes[2:].T).view("<i8").ravel()


def head_contexts(numbered: DataFrame, end: int, of) -> DataFrame:
    """(block, counts), stored: for each ``BLOCK_WORDS`` words, how often each stands after a word of each class and before one.

    A key in a block is a word's place in it times 2 CLASSES, plus the class before it, or CLASSES plus the class after it. A task counts
    in one table, whose size hangs on ``HEAD_WORDS`` and not on the corpus (100 MB), and hands on one row a block; rows of a block are
    added one by one.
    """

    def count(batches):
        classes, total, any_ = of.value, np.zeros((end + 1) * 2 * CLASSES, np.int32), False
        for b in batches:
            for s, inside in sequences(b.column(0), end):
                c, any_ = classes[s], True
                np.add.at(total, (s[1:] * 2 * CLASSES + c[:-1])[inside], np.int32(1))
                np.add.at(total, (s[:-1] * 2 * CLASSES + CLASSES + c[1:])[inside], np.int32(1))
        if not any_:
            return
        found = []
        for block in range(-(-(end + 1) // BLOCK_WORDS)):
            part = total[block * BLOCK_KEYS : (block + 1) * BLOCK_KEYS]
            if len(key := np.flatnonzero(part)):
                found.append((block, pack(key, part[key])))
            if found and (len(found) == 32 or (block + 1) * BLOCK_WORDS > end):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["block", "counts"])
                found = []

    def add(batches):
        now, total = None, None

        def row():
            key = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(key, total[key])], pa.binary())], names=["block", "counts"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros(BLOCK_KEYS, np.int64)
                key, n = unpack(counts.as_buffer())
                total[key] += n
        if now is not None:
            yield row()

    kind = "block int, counts binary"
    return stored(numbered.select("ids").mapInArrow(tidy(count), kind).repartition("block").sortWithinPartitions("block").mapInArrow(tidy(add), kind), "contexts")


def _blocks(batches, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and counts of the words of each block of ``head_contexts``; ``size`` words in all."""
    for b in batches:
        for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total = np.zeros(BLOCK_KEYS, np.int64)
            key, n = unpack(counts.as_buffer())
            total[key] = n
            words = np.arange(block * BLOCK_WORDS, min(size, (block + 1) * BLOCK_WORDS))
            yield words, total.reshape(BLOCK_WORDS, 2 * CLASSES)[: len(words)]


def _class_bigrams(contexts: DataFrame, of) -> np.ndarray:
    """Counts of neighbouring classes, from the classes after each word."""

    def count(batches):
        total = np.zeros((CLASSES, CLASSES), np.int64)
        for words, seen in _blocks(batches, len(of.value)):
            np.add.at(total, of.value[words], seen[:, CLASSES:])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES)), pa.array(total.ravel())], names=["at", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for r in contexts.mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r.n
    return table.reshape(CLASSES, CLASSES)


def exchange_rounds(numbered: DataFrame, end: int, of: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all numbers and their bigrams, from rounds of exchange that begin with the classes ``of``."""
    send = numbered.sparkSession.sparkContext.broadcast
    best = None
    for left in range(rounds, -1, -1):
        held = send(of)
        contexts = head_contexts(numbered, end, held)
        table = _class_bigrams(contexts, held)
        if best is not None and likelihood(table) <= likelihood(best[1]):
            return best
        best = (of, table)
        if not left:
            return best
        sent = send(table)

        def move(batches, sent=sent):
            for words, seen in _blocks(batches, end):
                keep = seen[:, :CLASSES].sum(axis=1) >= LEAST_CLASSED
                to = likely(sent.value, seen[keep, :CLASSES], seen[keep, CLASSES:])
                yield pa.RecordBatch.from_arrays([pa.array(words[keep]), pa.array(to.astype(np.int32))], names=["word", "class"])

        # at most HEAD_WORDS and ENDINGS rows
        moved = contexts.mapInArrow(tidy(move), "word long, class int").toArrow()
        of = of.copy()
        of[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return best


def far_contexts(batch: pa.RecordBatch, end: int, classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words beyond the head in a batch (ids, at, which, rest), where the places of each begin, and for each place the class before and, plus CLASSES, after."""
    ids, at, which = (_int32(batch.column(k)) for k in range(3))
    text = np.repeat(np.arange(batch.num_rows), np.diff(at[1]))
    place = ids[1][text] + at[0]
    c = np.append(classes[ids[0]], classes[end])  # the last for both ends
    before = np.where(at[0] == 0, len(c) - 1, place - 1)
    after = np.where(place + 1 == ids[1][text + 1], len(c) - 1, place + 1)
    rest = batch.column(3)
    own = np.append(0, np.cumsum(rest.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    words = rest.flatten().dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False)[own[text] + which[0]]
    order = np.argsort(word, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(word, minlength=len(words.dictionary))))
    return words.dictionary, first, np.stack([c[before[order]], c[after[order]] + CLASSES], axis=1).astype(np.uint8)


def _int32(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed int32, and where each row's begin (and the last one's end)."""
    data, off = text_buffers(col)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), np.int32), (off - off[0]) // 4


def far_classes(numbered: DataFrame, end: int, of, table) -> DataFrame:
    """(word, class) of the words beyond the head that occur ``LEAST_CLASSED`` times or more."""

    def contexts(batches):
        for b in batches:
            words, first, seen = far_contexts(b, end, of.value)
            for lo in range(0, len(words), MOST_CONTEXTS):
                off = first[lo : lo + MOST_CONTEXTS + 1]
                places = pa.py_buffer(np.ascontiguousarray(seen[off[0] : off[-1]]))
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((2 * (off - off[0])).astype(np.int32)), places])
                yield pa.RecordBatch.from_arrays([words[lo : lo + MOST_CONTEXTS], packed], names=["word", "seen"])

    def settle(words, seen):
        keep = seen[:, :CLASSES].sum(axis=1) >= LEAST_CLASSED
        return pa.RecordBatch.from_arrays([words.filter(pa.array(keep)), pa.array(likely(table.value, seen[keep, :CLASSES], seen[keep, CLASSES:]).astype(np.int32))], names=["word", "class"])

    def assign(batches):
        held = None  # a batch's last word, which may go on in the next
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(0)
            new = np.append(True, pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False))
            data, off = text_buffers(b.column(1))
            group = np.repeat(np.cumsum(new) - 1, np.diff(off))
            seen = np.bincount(group * 2 * CLASSES + data[off[0] : off[-1]], minlength=2 * CLASSES * int(new.sum())).reshape(-1, 2 * CLASSES)
            w = w.filter(pa.array(new))
            if held is not None:
                if held[0].equals(w[:1]):
                    seen[0] += held[1][0]
                else:
                    yield settle(*held)
            yield settle(w[:-1], seen[:-1])
            held = w[-1:], seen[-1:]
        if held is not None:
            yield settle(*held)

    got = numbered.select("ids", "at", "which", "rest").mapInArrow(tidy(contexts), "word string, seen binary")
    return got.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(assign), "word string, class int")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    learn = docs.where(~out & F.col(id_col).isNotNull())
    counts = stored(word_counts(learn, text_col), "counts")
    # the head: words above the lowest of 512 count levels at which they are few enough
    level = F.floor(F.log2("n") * 8)
    levels = counts.where(F.col("word") != END).groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    cut, n_head = None, 0
    for r in levels:
        n_head += r.words
        if n_head > HEAD_WORDS:
            break
        cut = r.least
    least = F.lit(cut if cut is not None else 2**62)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    n_tokens, n_words, n_ends = int(total[0]), int(total[1]), int(total[2])
    head = counts.where((F.col("word") != END) & (F.col("n") >= least)).toArrow()
    ranked = sorted(zip(head.column("n").to_pylist(), head.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    vocabulary = send(Vocabulary([w for _, w in ranked]))
    size, end = vocabulary.value.size, vocabulary.value.end
    head_counts = np.array([n for n, _ in ranked], np.int64)
    base_below = float(np.log10(n_tokens + n_words + 1))
    end_base, end_model = float(np.log10(n_ends + 1.0)), float(np.log10(n_ends + EMISSION_PRIOR))
    logs = send((np.log10(head_counts + 1.0), np.log10(head_counts + EMISSION_PRIOR)))

    local = T.StructType([*schema_of(docs, id_col), *(T.StructField(c, t) for c, t in (
        ("row", T.LongType()), ("held_out", T.BooleanType()), ("learn", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("model", T.DoubleType()),
        ("ids", T.BinaryType()), ("at", T.BinaryType()), ("which", T.BinaryType()), ("rest", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.LongType())),
    ))])
    names = [f.name for f in local]

    def number(batches):
        v, (base, emission) = vocabulary.value, logs.value
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = {c: [] for c in names[1:]}
            for words, held_out, learnt in zip(_texts(b, 1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                k = v.numbers(words)
                known, far = k[k < v.size], np.flatnonzero(k >= v.size)
                own: dict[bytes, int] = {}
                which = np.array([own.setdefault(words[i], len(own)) for i in far.tolist()], np.int32)
                times = np.bincount(which, minlength=len(own)).tolist() if len(far) else []
                made = (at, held_out, learnt, len(k) + 1, len(known) + (n_ends > 0), base[known].sum() + end_base - base_below * (len(k) + 1), emission[known].sum() + end_model, k.tobytes(), far.astype(np.int32).tobytes(), which.tobytes(), [w.decode() for w in own], times)
                for c, x in zip(names[1:], made, strict=True):
                    rows[c].append(x)
                at += 1
            yield arrow_rows({names[0]: b.column(0), **rows}, local)

    numbered = stored(docs.select(id_col, text_col, out.alias("held"), (~out & F.col(id_col).isNotNull()).alias("learn")).mapInArrow(tidy(number), local), "numbered")
    learnt = numbered.where("learn")

    # classes: a start, rounds over the head, then the words beyond it
    unit = np.array([*range(min(size, SEED_WORDS)), *(SEED_WORDS + ending(w.encode()) for _, w in ranked[SEED_WORDS:]), *range(SEED_WORDS, SEED_WORDS + ENDINGS + 1)], np.int64)
    seed = exchange_clustering(seed_bigrams(learnt, end, send(unit)), SEED_WORDS + ENDINGS)
    of, table = exchange_rounds(learnt, end, seed[unit])
    classes = send(of)
    rare = counts.where((F.col("word") != END) & (F.col("n") < least))
    rare = stored(rare.join(far_classes(learnt, end, classes, send(table)), "word", "left"), "rare")

    def by_class(batches):
        for b in batches:
            pools = classes.value[size + np.array([ending(w.encode()) for w in b.column(0).to_pylist()], np.int64)]
            c = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.isnan(c), pools, c).astype(np.int32) if len(c) else np.zeros(0, np.int32)), b.column(1)], names=["class", "n"])

    tokens, kinds = np.bincount(of[:size], head_counts, CLASSES), np.bincount(of[:size], minlength=CLASSES).astype(float)
    for r in rare.select("word", "n", F.col("class").cast("double")).mapInArrow(tidy(by_class), "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens[r["class"]] += r.n
        kinds[r["class"]] += r.words
    tokens[CLASSES - 1], kinds[CLASSES - 1] = n_ends, 1

    rest = numbered.select("row", F.posexplode(F.arrays_zip("rest", "times")).alias("k", "x")).select("row", "k", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    sums = rest.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(n + 1.0)).alias("more_base"),
        F.sum(F.col("times") * F.log10(n + F.lit(EMISSION_PRIOR))).alias("more_model"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("k", "class"))).alias("own"),
    )
    filled = stored(numbered.drop("rest", "times").join(sums, "row", "left").withColumn("own_k", F.col("own.k")).withColumn("own_class", F.col("own.class")).drop("own"), "filled")
    parts = ("ids", "at", "which", "own_k", "own_class")

    def followed(b):
        """Classes of each text, an end before and after."""
        for ids, at, which, k, c in zip(*(b.column(x).to_pylist() for x in parts), strict=True):
            s = classes.value[np.concatenate([[end], np.frombuffer(ids, np.int32), [end]])]
            if k:
                at, which = np.frombuffer(at, np.int32), np.frombuffer(which, np.int32)
                mine = np.full(int(which.max()) + 1, -1, np.int64)
                mine[k] = c
                has = mine[which] >= 0
                s[at[has] + 1] = mine[which[has]]
            yield s

    def class_bigrams(batches):
        found = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for s in followed(b):
                found += np.bincount(s[:-1] * CLASSES + s[1:], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES)), pa.array(found)], names=["at", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for r in filled.where("learn").select(*parts).mapInArrow(tidy(class_bigrams), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r.n
    fitted = ClassModel(table.reshape(CLASSES, CLASSES), tokens, kinds)
    model = send((fitted.transition, fitted.below))
    kept_names = ("held_out", "n_tokens", "n_known", "base", "model", "more_known", "more_base", "more_model")
    passed = T.StructType([*schema_of(docs, id_col), *(filled.schema[c] for c in kept_names), T.StructField("path", T.DoubleType())])

    def follow(batches):
        transition, below = model.value
        for b in batches:
            path = [float(transition[s[:-1], s[1:]].sum() - below[s[1:]].sum()) for s in followed(b)]
            yield arrow_rows({c: b.column(c) for c in (names[0], *kept_names)} | {"path": path}, passed)

    final = filled.select(id_col, *kept_names, *parts).mapInArrow(tidy(follow), passed)
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("path") + F.col("model") + zero("more_model")
    return final.select(id_col, "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
