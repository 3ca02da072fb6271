"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints come from 3-word shingles. Only distinct fingerprints are joined: they are cut into
shards along their Gray rank (neighbours in that order differ in few bits), and the bits on which all
members of a shard agree form the upper nodes of the index. Each fingerprint is sent to those shards
alone whose agreed bits differ from it in at most ``max_bits`` places. In a shard the order is cut
again and again into groups: a node holds the bits its members share beyond what its parent holds,
a search adds up differences on the way down and leaves a whole group as soon as the sum is too
large, and takes a whole group at once when the sum can't become too large.

A shard returns links of a spanning forest, not pairs, so a large group of near copies makes as many
rows as it has members. Components over all shards are joined by alternating star contraction.
A fingerprint, vertex or component that holds a large share of all rows is joined through a small
broadcast (``join_split``), so its rows are not brought together.

Edge cases: a null, empty or wordless text has fingerprint zero, which links like any other; rows
with the same doc_id are rows of their own, in the components of their own texts; a null doc_id takes
part, and a component's id is the smallest doc_id that is not null (null if all are); a bit set in
exactly half the shingles is zero; a very long text is hashed ``CHUNK_BYTES`` at a time with others or
alone; an empty table gives an empty one; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import arrow_rows, fresh, join_split, schema_of, stored, text_chunks, tidy
from weftwork.operators.relations import hot_share

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Distinct fingerprints that a shard holds, and the most shards whose upper nodes a task is given. From a
#: thousand million fingerprints on shards grow instead of their number; results are the same, and a shard of a
#: million (some 65 thousand million fingerprints) takes 8 MB and its visitors about as much for each bit of MAX_BITS.
SHARD_ROWS, MOST_SHARDS = 1 << 14, 1 << 16
FANOUT = 8
#: Search states (query, node) that are held at a time.
FRONTIER = 1 << 18


def majority_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of ``counts`` hashes: the bits set in over half of each run; zero for an empty one.

    Eight bits are counted at a time, each in a byte of its own, over stretches of at most 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    pieces = -(-n // 255)
    piece_first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
    cuts = np.repeat(first, pieces) + 255 * within
    found = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_first, axis=0)
        bits = (2 * sums > n[:, None]).astype(np.uint64)
        found |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    out[full] = found
    return out


def text_fingerprints(col: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of a text column as uint64."""
    one, out = partial(xxhash.xxh64_intdigest, seed=seed), []
    for lo, hi, data, off in text_chunks(col):
        raw, hashes, counts = data.tobytes(), [], np.zeros(hi - lo, np.int64)
        for d in range(hi - lo):
            w = raw[off[d] : off[d + 1]].lower().split()  # bytes: only A-Z and ASCII white space
            if len(w) >= shingle:
                counts[d] = len(w) - shingle + 1
                hashes.append(np.fromiter(map(one, map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))), np.uint64, counts[d]))
            elif w:
                counts[d] = 1
                hashes.append(np.array([one(b" ".join(w))], np.uint64))
        out.append(majority_bits(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray sequence."""
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


def gray_rank_column(f: Column) -> Column:
    """The same as a signed long in the same order."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, s))
    return f.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """Hierarchy over (mask, pattern) leaves that are in Gray order; plain fingerprints have full masks."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray, fanout: int = FANOUT) -> None:
        self.fanout, self.levels = fanout, [(masks, patterns & masks)]
        while len(self.levels[-1][0]) > fanout:
            m, p = self.levels[-1]
            cut = np.arange(0, len(m), fanout)
            every, some = np.bitwise_and.reduceat(p, cut), np.bitwise_or.reduceat(p, cut)
            mask = np.bitwise_and.reduceat(m, cut) & ~(every ^ some)
            self.levels.append((mask, every & mask))
        # what a node's mask has beyond its parent's: differences on the rest were added up above
        self.own = []
        for k, (m, _) in enumerate(self.levels):
            parent = self.levels[k + 1][0][np.arange(len(m)) // fanout] if k + 1 < len(self.levels) else np.zeros(len(m), np.uint64)
            self.own.append(m & ~parent)

    def search(self, queries: np.ndarray, most: int, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs at most ``most`` apart, in blocks.

        whole: of a group that lies within ``most`` as a whole, and whose members then are linked
        among each other, only the first leaf is given.
        """
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        step = max(1, FRONTIER // max(1, n))
        for a in range(0, len(queries), step):
            q = np.arange(a, min(a + step, len(queries)))
            yield from self._down(queries, np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.uint8), top, most, whole)

    def _down(self, queries, q, node, acc, level, most, whole):
        mask, pattern = self.levels[level]
        acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & self.own[level][node])
        keep = acc <= most
        q, node, acc = q[keep], node[keep], acc[keep]
        if not level:
            if len(q):
                yield q, node
            return
        if whole:
            done = acc + np.bitwise_count(~mask[node]) <= most
            if done.any():
                yield q[done], node[done] * self.fanout**level
                q, node, acc = q[~done], node[~done], acc[~done]
        below = len(self.levels[level - 1][0])
        step = FRONTIER // self.fanout
        for a in range(0, len(q), step):
            child = node[a : a + step, None] * self.fanout + np.arange(self.fanout)
            real = child < below
            yield from self._down(queries, np.repeat(q[a : a + step], self.fanout)[real.ravel()], child[real], np.repeat(acc[a : a + step], self.fanout)[real.ravel()], level - 1, most, whole)

    def tight_chains(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join the members of each group in which no two members can differ in over ``most`` bits."""
        a, b = [], []
        for level in range(1, len(self.levels)):
            tight = np.flatnonzero(np.bitwise_count(~self.levels[level][0]) <= most)
            if len(tight):
                size = self.fanout**level
                leaf = (tight[:, None] * size + np.arange(size)).ravel()
                leaf = leaf[leaf < len(self.levels[0][0])]
                inner = leaf[leaf % size > 0]
                a.append(inner)
                b.append(inner - 1)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over each set joined by the links a-b; ``labels`` point to smaller or equal positions."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def shard_links(members: np.ndarray, visitors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the members and visitors of a shard (visitors aren't held against each other)."""
    members = members[np.argsort(gray_rank(members), kind="stable")]
    index = GrayIndex(np.full(len(members), 2**64 - 1, np.uint64), members)
    labels = np.arange(len(members) + len(visitors))
    labels = merge(labels, *index.tight_chains(most))
    every = np.concatenate([members, visitors])
    for q, leaf in index.search(every, most):
        labels = merge(labels, q, leaf)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return every[moved], every[labels[moved]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint): a fingerprint is a long with the 64 bits."""
    out = T.StructType([*schema_of(docs, id_col), T.StructField("fingerprint", T.LongType())])

    def compute(batches):
        for b in batches:
            yield arrow_rows({id_col: b.column(0), "fingerprint": pa.array(text_fingerprints(b.column(1), shingle, seed).view(np.int64))}, out)

    return docs.select(id_col, text_col).mapInArrow(tidy(compute), out)


def hamming_links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that join just those distinct fingerprints that a chain of steps of at most ``max_bits`` joins.

    What comes to the driver: the shard boundaries and upper nodes, ``MOST_SHARDS`` at most.
    """
    out = "a long, b long"
    ranked = distinct.select("fingerprint", gray_rank_column(F.col("fingerprint")).alias("rank"))
    n = ranked.count()
    shards = int(min(MOST_SHARDS, max(16, -(-n // shard_rows))))
    cuts = ranked.agg(F.percentile_approx("rank", [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def shard_of(rank: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, rank.to_numpy(), "right").astype(np.int32)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fingerprint"), pa.array(shard_of(b.column("rank")))], names=["fingerprint", "shard"])

    placed = ranked.mapInArrow(tidy(place), "fingerprint long, shard int")
    top = placed.groupBy("shard").agg(F.bit_and("fingerprint").alias("every"), F.bit_or("fingerprint").alias("some")).orderBy("shard").collect()
    shard = np.array([r.shard for r in top], np.int32)
    every, some = (np.array([r[k] for r in top], np.int64).view(np.uint64) for k in ("every", "some"))

    def route(batches):
        upper = GrayIndex(~(every ^ some), every) if len(shard) else None
        for b in batches:
            f, own = b.column("fingerprint").to_numpy().view(np.uint64), shard_of(b.column("rank"))
            yield pa.RecordBatch.from_arrays([b.column("fingerprint"), pa.array(own), pa.array(np.ones(len(f), bool))], names=["fingerprint", "shard", "member"])
            for q, s in upper.search(f, max_bits, whole=False):
                later = shard[s] > own[q]  # a pair is found in the later of its two shards
                yield pa.RecordBatch.from_arrays([pa.array(f[q[later]].view(np.int64)), pa.array(shard[s[later]]), pa.array(np.zeros(later.sum(), bool))], names=["fingerprint", "shard", "member"])

    def join(t: pa.Table) -> pa.Table:
        f, own = t.column("fingerprint").to_numpy().view(np.uint64), t.column("member").to_numpy()
        a, b = shard_links(f[own], f[~own], max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return ranked.mapInArrow(tidy(route), "fingerprint long, shard int, member boolean").groupBy("shard").applyInArrow(join, out)


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored, most_rounds: int = 60) -> DataFrame:
    """(vertex, root) of every vertex in a link: alternating large-star and small-star rounds until nothing changes.

    Minima are aggregated before they are shuffled and then joined by ``join_split`` if a vertex has very
    many links, which then stay where they are. What a step made is kept before the next one reads it, as
    each reads it several times: a plan over whole rounds would hold every step many times over, in the driver.
    """

    def tally(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def with_lowest(e: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) with the lowest neighbour m of a, itself included, and (a, m)."""
        low = keep(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "lowest")
        hot = (low.agg(F.max("n")).first()[0] or 0) > hot_share(total)
        return (join_split(e, low, "a", "n", total) if hot else e.join(low, "a")), low

    edges = keep(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = tally(edges)
    for _ in range(most_rounds if state[0] else 0):
        # large star: each vertex ties its larger neighbours to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found, _ = with_lowest(both, 2 * state[0])
        large = keep(found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: each vertex ties its smaller neighbours and itself to the smallest of them
        found, low = with_lowest(large, 2 * state[0])
        small = found.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")
        now = tally(edges)
        if now == state:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        state = now
    if state[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def _classes(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(fingerprint, n, best) from stored (fingerprint, n, low): the smallest ``low`` of the fingerprint's component."""
    roots = components(hamming_links(distinct, max_bits))
    own = distinct.join(roots.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "low", "n")
    own = stored(own, "roots")
    best = own.groupBy("root").agg(F.min("low").alias("best"), F.count("*").alias("members"))
    return join_split(own, best, "root", "members").select("fingerprint", "n", "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    (cid,) = fresh(docs.select(id_col), "component_id")
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints").withColumnRenamed(id_col, "id")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    found = join_split(prints, stored(_classes(distinct, max_bits), "classes"), "fingerprint", "n")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("best").alias(cid))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each component left: that of the smallest id, and of rows with that id the first that was read.

    Rows are judged, not ids: an id that repeats with another text stays with that text, unless a row
    before it stands for it. A null id is above all others. The texts are stored once with the number of
    their row; what is joined with them is the numbers of the rows that go.
    """
    row, mark = fresh(docs, "row", "fingerprint")
    columns, k = docs.columns, docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField(row, T.LongType()), T.StructField(mark, T.LongType())])

    def number(batches):
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows)), pa.array(text_fingerprints(b.column(k)).view(np.int64))], names=[*columns, row, mark])
            at += b.num_rows

    x = stored(docs.mapInArrow(tidy(number), out), "rows")
    rows = x.select(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row)).alias("own"), F.col(mark).alias("fingerprint"))
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("own").alias("low"), F.count("*").alias("n")), "distinct")
    found = join_split(rows, stored(_classes(distinct, max_bits), "classes"), "fingerprint", "n")
    gone = found.where(F.col(f"own.{row}") != F.col(f"best.{row}")).select(F.col(f"own.{row}").alias(row))
    return x.join(gone, row, "left_anti").select(*columns)
