"""Filter interaction audit: what each order of the filters removes at which step, from counts by failure mask.

A document's five verdicts are one mask of five bits. For each of the 32 masks and 120 orders, a table that
is worked out once says at which step the document goes (the first filter of the order that it fails), or
that it stays. Tasks count their documents by part, mask and labels, look the masks' rows of that table up,
and np.bincount adds the counts up by part, order and step; these partial arrays are summed over the tasks.
All other figures follow from what was removed: nothing is done once for each order and document.

Equal texts are told by a 256-bit digest. Copies are folded by digest, part, mask and labels before they are
shuffled, with the number of rows of their smallest id, so that a text of very many copies is a few rows.

Edge cases: a null text is empty (it fails A alone, unless a smaller id has an empty text too); a null part is
the empty string; an id that repeats with equal text is not its own smaller copy; a null id has no smaller id
and is none, and no labels; a label row that repeats counts as 1 if any says 1; a very long text is one row of
its task; an empty table gives no part and so no row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.llm.common import NOT_SPACE, text_chunks, tidy

NAMES = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 3
MARKS = b"#$%&*|"
#: Parts that a task holds counts of; then they are handed on.
MOST_PARTS = 1000

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80


def first_failures(filters: int = len(NAMES)) -> tuple[np.ndarray, np.ndarray]:
    """(orders, first): every order of the filters, and for each mask and order the step (from 0) of the first failure; ``filters`` if there is none."""
    orders = np.array(list(itertools.permutations(range(filters))), np.int64)
    masks = np.arange(1 << filters)
    fails = (masks[:, None, None] >> orders[None]) & 1 == 1
    return orders, np.where(fails.any(2), fails.argmax(2), filters)


def _totals(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[off])


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, digest): the failures that a text alone decides (bits 0 to 3), and the text's digest."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column(2)):
                raw = data.tobytes()
                masks, digests = np.zeros(hi - lo, np.int32), []
                points = _totals(_LEAD[data], off)
                masks |= np.where(100 * _totals(_CAPITAL[data], off) > MOST_CAPITAL_PERCENT * points, 4, 0).astype(np.int32)
                masks |= np.where(_totals(_MARK[data], off) > 0, 8, 0).astype(np.int32)
                for k in range(hi - lo):
                    text = raw[off[k] : off[k + 1]]
                    words = text.split()
                    masks[k] |= (len(words) < MIN_WORDS) | 2 * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
                    digests.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(masks), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    assert not (NOT_SPACE[[*b" \t\n\r\x0b\x0c"]]).any()  # bytes.split() parts by the same bytes
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), part.alias("part"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, part string, mask int, digest binary")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by part, all five failures, and labels."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = verdicts(docs, id_col, text_col, part_col)
    # rows without an id are joined by a key of their own text, which no label has, so that they are not one key
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    on = (F.col("id") == F.col("label_id")) & (F.col("spread") == F.col("none"))
    rows = rows.join(marks.withColumn("none", F.lit(0).cast("long")), on, "left")
    same = ["digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))]
    ids = rows.groupBy("id", *same).agg(F.count("*").alias("n"))
    kinds = ids.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low")
    )
    # a text's kinds are at most its parts times four label pairs
    least = F.min("low.id").over(Window.partitionBy("digest"))
    first = F.col("nameless") + F.when(F.col("low.id") == least, F.col("low.n")).otherwise(F.lit(0))
    copy = F.lit(1 << NAMES.index("E"))
    both = F.array(F.struct(F.lit(0).alias("copy"), F.col("first").alias("m")), F.struct(copy.alias("copy"), (F.col("n") - F.col("first")).alias("m")))
    split = kinds.withColumn("first", first).select("part", "mask", "good", "toxic", F.inline(both))
    return split.where("m > 0").groupBy("part", (F.col("mask") + F.col("copy")).alias("mask"), "good", "toxic").agg(F.sum("m").alias("n"))


def removals(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, filter_order, step, removed, good_lost, toxic_lost, failing, unique_fails, documents), summed, from rows (part, mask, good, toxic, n)."""
    size = len(names)
    orders, first = first_failures(size)
    n_orders, steps = len(orders), size + 1
    texts = ["".join(names[f] for f in o) for o in orders]
    schema = "part string, filter_order string, step int, removed long, good_lost long, toxic_lost long, failing long, unique_fails long, documents long"

    def run(batches):
        parts: dict[str, int] = {}
        cells = np.zeros((0, 1 << size, 4), np.int64)

        def partial() -> Iterable[pa.RecordBatch]:
            masks = np.arange(1 << size)
            where = (np.arange(n_orders) * steps)[None] + first  # mask and order to the place of order and step
            for name, p in parts.items():
                own = cells[p]
                of = lambda weight: np.bincount(where.ravel(), np.repeat(weight, n_orders), n_orders * steps).reshape(n_orders, steps)[:, :size].astype(np.int64)  # noqa: E731, B023
                per_mask = own.sum(1)
                failing = np.array([per_mask[(masks >> f) & 1 == 1].sum() for f in range(size)])[orders]
                unique = np.array([per_mask[1 << f] for f in range(size)])[orders]
                flat = [of(per_mask), of(own[:, 2] + own[:, 3]), of(own[:, 1] + own[:, 3]), failing, unique]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (n_orders * size)), pa.array(np.repeat(texts, size)), pa.array(np.tile(np.arange(1, steps, dtype=np.int32), n_orders)), *(pa.array(x.ravel()) for x in flat), pa.array(np.full(n_orders * size, per_mask.sum()))],
                    names=["part", "filter_order", "step", "removed", "good_lost", "toxic_lost", "failing", "unique_fails", "documents"],
                )

        for b in batches:
            names_here = b.column(0).dictionary_encode()
            known = names_here.dictionary.to_pylist()
            if parts and len(parts) + len(known) > MOST_PARTS:
                yield from partial()
                parts, cells = {}, cells[:0]
            for x in known:
                parts.setdefault(x, len(parts))
            cells = np.concatenate([cells, np.zeros((len(parts) - len(cells), 1 << size, 4), np.int64)])
            at = np.array([parts[x] for x in known], np.int64)[names_here.indices.to_numpy()] if known else np.zeros(0, np.int64)
            label = 2 * b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
            np.add.at(cells.reshape(-1), (at * (1 << size) + b.column(1).to_numpy()) * 4 + label, b.column(4).to_numpy())
        yield from partial()

    partials = rows.select("part", F.col("mask").cast("int"), "good", "toxic", F.col("n").cast("long")).mapInArrow(tidy(run), schema)
    return partials.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "failing", "unique_fails", "documents")))


def audit(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, failed by this filter alone, lost of good and toxic, and the filter's Shapley sum."""
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    x = removals(rows, names).withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    return x.select(
        "part", "filter_order", "step", "filter", (F.col("documents") - so_far).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over whole texts, by part."""
    return audit(judged(docs, labels, id_col, text_col, part_col))
