"""Spelling variants: words one error apart, by forward and backward minimal acyclic automata.

Words are counted over the corpus and the frequent ones are the vocabulary. If two words differ by one
inserted, deleted or replaced code point, that error lies either behind the first half of the one, so that
this half stands exactly at the beginning of the other, or before its second half ends, so that its second half
stands exactly at the other's end. So a word's first half is followed from the root of a minimal acyclic
automaton of the words without branching, and what is left is completed with exactly one error; the same is
done with turned words for the second half. Edges carry the number of words that are passed by, so the
end of a way gives the word's number among the sorted words, by which counts are found. What both ways find is
kept once: the backward way hands on only words that do not begin with the first half.

Words are dealt to tasks by that half (a word of the vocabulary lies under the halves of words one shorter,
as long and one longer, which are two), so an automaton has all words that its searches can reach. Buckets
are gathered into automata of about RUN_WORDS words; a bucket of more than MOST_BUCKET is split into parts, and
each part's searches go through each part's automaton in a task of their own. Each search hands on the number of near words and the best
one, not pairs. Forms are followed by joins that double the way each round.

Edge cases: a null or empty text has no words; a null id stands as the empty string before the colon; rows that
repeat count each time; a word is not near to itself; of near words with equal counts the first in code-point
order is the form; very long words are letters like any other; a table without frequent words gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import LOWER, stored, text_chunks, tidy

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, DAMAGE_EVERY, TIMES = 6, 5, 199, 5
#: Words of one automaton, about; more only where they are of one bucket, up to MOST_BUCKET.
RUN_WORDS, MOST_BUCKET = 30_000, 60_000
#: Distinct words that a task counts before it hands them on; words searched at a time.
MOST_COUNTED, SEARCH_WORDS = 200_000, 8192


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, damage_every: int = DAMAGE_EVERY) -> DataFrame:
    """(word, n) of all runs of letters after damage, of at least ``min_length`` code points; one row a word."""
    run_of = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["word", "n"])

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, off in text_chunks(b.column(1)):
                raw = LOWER[data].tobytes()
                for k in range(hi - lo):
                    seen = Counter(run_of.findall(raw[off[k] : off[k + 1]].decode()))
                    prefix = zlib.crc32(f"{'' if ids[lo + k] is None else ids[lo + k]}:".encode())
                    for w, n in seen.items():
                        h = zlib.crc32(w.encode(), prefix)
                        if h % damage_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < min_length:
                                continue
                        total[w] += n
                    if len(total) > MOST_COUNTED:
                        yield table(total)
                        total.clear()
        yield table(total)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with the numbers of its words.

    ``key`` holds the edges as state << 21 | code point, in order, with the target of each and the number
    of words of the state that come before those of the edge.
    """

    def __init__(self, sorted_words: list[str]) -> None:
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        open_edges: list[list] = [[]]
        ends = [False]
        before = ""
        for w in [*sorted_words, None]:
            same = 0
            if w is not None:
                most = min(len(w), len(before))
                while same < most and w[same] == before[same]:
                    same += 1
            while len(ends) > same + 1:
                state = (ends.pop(), *open_edges.pop())
                number = known.get(state)
                if number is None:
                    number = known[state] = len(states)
                    states.append(state)
                open_edges[-1] += (ord(before[len(ends) - 1]), number)
            if w is not None:
                for _ in range(len(w) - same):
                    open_edges.append([])
                    ends.append(False)
                ends[-1] = True
                before = w
        states.append((ends[0], *open_edges[0]))
        self.root = len(states) - 1
        self.final = np.array([s[0] for s in states], bool)
        size = np.array([len(s) // 2 for s in states], np.int64)
        self.degree, self.first = size, np.concatenate([[0], np.cumsum(size)])
        flat = np.array([x for s in states for x in s[1:]], np.int64).reshape(-1, 2)
        self.char, self.target = flat[:, 0], flat[:, 1]
        self.key = np.repeat(np.arange(len(states)), size) << 21 | self.char
        self.skip = np.zeros(len(flat), np.int64)
        count = [0] * len(states)
        for s, (lo, hi) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):  # targets come before their sources
            n = int(self.final[s])
            for e in range(lo, hi):
                self.skip[e] = n
                n += count[self.target[e]]
            count[s] = n
        self.count = count[self.root]

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states have such an edge, the edges)."""
        if not len(self.key):
            z = np.zeros(0, np.int64)
            return z, z
        want = state << 21 | char
        e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        found = np.flatnonzero(self.key[e] == want)
        return found, e[found]

    def fan(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which state, edge) of all edges of the states."""
        n = self.degree[state]
        which = np.repeat(np.arange(len(state)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n)

    def one_error(self, codes: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number), each once, of words that have the first ``exact`` code points of the row and differ from it by one error behind them."""
        rows, size = codes.shape
        at = np.arange(rows)
        state, number = np.full(rows, self.root, np.int64), np.zeros(rows, np.int64)
        # the ways with their error behind them
        w_at = w_state = w_number = np.zeros(0, np.int64)
        for p in range(size + 1):
            new_at, new_state, new_number = [], [], []
            if p >= exact and len(at):
                which, e = self.fan(state)
                inserted = (at[which], self.target[e], number[which] + self.skip[e])
                if p < size:
                    other = self.char[e] != codes[inserted[0], p]
                    new_at += [inserted[0][other], at]
                    new_state += [inserted[1][other], state]
                    new_number += [inserted[2][other], number]
                w_at, w_state, w_number = (np.concatenate([a, b]) for a, b in zip((w_at, w_state, w_number), inserted, strict=True))
            if p == size:
                break
            found, e = self.step(w_state, codes[w_at, p])
            w_at, w_state, w_number = w_at[found], self.target[e], w_number[found] + self.skip[e]
            if new_at:
                w_at, w_state, w_number = np.concatenate([w_at, *new_at]), np.concatenate([w_state, *new_state]), np.concatenate([w_number, *new_number])
            found, e = self.step(state, codes[at, p])
            at, state, number = at[found], self.target[e], number[found] + self.skip[e]
        done = self.final[w_state]
        pair = np.unique(w_at[done] * (self.count + 1) + w_number[done])
        return pair // (self.count + 1), pair % (self.count + 1)


def _best(asked: list[str], named: list[str], n: np.ndarray, backward: bool) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, list[str]]]:
    """(words, number of near words, the best one's count, the best one) of the searches that find any, through one automaton."""
    seen = sorted(range(len(named)), key=lambda i: named[i][::-1]) if backward else sorted(range(len(named)), key=named.__getitem__)
    held = [named[i] for i in seen]
    count = n[seen]
    order = np.empty(len(held), np.int64)  # of the words in code-point order
    order[sorted(range(len(held)), key=held.__getitem__)] = np.arange(len(held))
    automaton = Automaton([w[::-1] for w in held] if backward else held)
    by_size: dict[int, list[str]] = {}
    for w in asked:
        by_size.setdefault(len(w), []).append(w)
    for size, group in by_size.items():
        step = max(1, min(SEARCH_WORDS, (SEARCH_WORDS * 32) // size))
        first = size // 2
        for lo in range(0, len(group), step):
            own = group[lo : lo + step]
            turned = [w[::-1] for w in own] if backward else own
            codes = np.frombuffer("".join(turned).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(own), size)
            q, k = automaton.one_error(codes, size - first if backward else first)
            if backward:  # the forward way has found what begins with the first half
                new = np.fromiter((held[j][:first] != own[i][:first] for i, j in zip(q.tolist(), k.tolist(), strict=True)), bool, len(q))
                q, k = q[new], k[new]
            if not len(q):
                continue
            s = np.lexsort((order[k], -count[k], q))
            q, k = q[s], k[s]
            some, at, near = np.unique(q, return_index=True, return_counts=True)
            yield [own[i] for i in some.tolist()], near, count[k[at]], [held[i] for i in k[at].tolist()]


def near_words(vocabulary: DataFrame, most_bucket: int = MOST_BUCKET, run_words: int = RUN_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) of a stored vocabulary (word, n): rows of some of a word's near words, which add up; the best of the rows is the best."""
    size = F.length("word")
    even = size % 2 == 0
    half, more = F.floor(size / 2), F.ceil(size / 2)

    def under(turned: bool) -> list[Column]:
        """Buckets of a word: the half that it is searched by, and that of words one shorter or longer if it is another."""
        of = F.reverse("word") if turned else F.col("word")
        both = (more, F.when(even, half + 1).otherwise(half)) if turned else (half, F.when(even, half - 1).otherwise(more))
        return [F.struct(F.lit(turned).alias("turned"), F.substring(of, F.lit(1), k.cast("int")).alias("half"), F.lit(k is both[0]).alias("searched")) for k in both]

    rows = vocabulary.select("word", "n", F.inline(F.array(*under(False), *under(True))))
    large = rows.groupBy("turned", "half").agg(F.count("*").alias("size")).where(F.col("size") > most_bucket)
    parts = large.select("turned", "half", F.ceil(F.col("size") / most_bucket).cast("int").alias("parts"))
    # buckets of more than most_bucket words: fewer than four vocabularies' words by that number
    dealt = rows.join(parts, ["turned", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    cell = lambda part, named, searched: F.struct(part.alias("part"), named.alias("named"), searched.alias("searched"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    grid = F.concat(F.transform(every, lambda k: cell(F.col("own") * F.col("parts") + k, F.lit(True), F.lit(False))), F.transform(every, lambda k: cell(k * F.col("parts") + F.col("own"), F.lit(False), F.col("searched"))))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(True), F.col("searched")))).otherwise(grid)
    dealt = dealt.select("turned", "half", "parts", "word", "n", F.inline(cells)).where("named OR searched")
    dealt = dealt.select("turned", "half", "part", "parts", "named", "searched", "word", "n")

    def search(batches):
        run: list[list] = [[], [], []]  # words to ask, words of the automaton, their counts
        inside, turned_now, was_split = None, None, False

        def done():
            asked, named, n = run
            if named and asked:
                counts = dict(zip(named, n, strict=True))  # a word lies under two halves, which may be in one run
                distinct = list(counts)
                for some in _best(asked, distinct, np.fromiter(counts.values(), np.int64, len(counts)), turned_now):
                    yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.string()), pa.array(some[1]), pa.array(some[2]), pa.array(some[3], pa.string())], names=["word", "n_near", "near_n", "near"])
            for x in run:
                x.clear()

        for b in batches:
            for turned, half, part, parts, named, searched, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bucket = (turned, half, part)
                if bucket != inside:
                    if parts > 1 or was_split or len(run[1]) >= run_words or turned != turned_now:
                        yield from done()
                    inside, turned_now, was_split = bucket, turned, parts > 1
                if searched:
                    run[0].append(word)
                if named:
                    run[1].append(word)
                    run[2].append(n)
        yield from done()

    return dealt.repartition("turned", "half", "part").sortWithinPartitions("turned", "half", "part").mapInArrow(tidy(search), "word string, n_near long, near_n long, near string")


def _roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root) of stored (word, form): each round doubles the way. A form is ``TIMES`` as frequent, so ``most`` bounds the steps."""
    steps, n = 0, most
    while n >= MIN_COUNT * TIMES:
        n, steps = n // TIMES, steps + 1
    far = links
    while steps > 1:
        ahead = far.select(F.col("word").alias("form"), F.col("form").alias("next"))
        far = stored(far.join(ahead, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "roots")
        steps = -(-steps // 2)
    return far.select("word", F.col("form").alias("root"))


def forms(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a stored vocabulary (word, n)."""
    none = vocabulary.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"), "n")
    found = none.unionByName(near_words(vocabulary), allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))))
    near = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    known = -F.col("best.less") >= TIMES * F.col("n")
    out = stored(near.select("word", "n", "n_near", F.when(known, F.col("best.word")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n")), "forms")
    links = out.where("form IS NOT NULL").select("word", "form")
    most = out.agg(F.max("form_n")).first()[0] or 0
    return out.join(_roots(links, most), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """Per frequent word: word, n, n_near, form, form_n, root."""
    vocabulary = stored(words(docs, id_col, text_col).where(F.col("n") >= min_count), "vocabulary")
    return forms(vocabulary).select("word", "n", "n_near", "form", "form_n", "root")
