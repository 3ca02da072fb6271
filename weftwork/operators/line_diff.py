"""Line diff of two versions of a text: opcodes, and what follows from them.

Both texts become arrays of lines, natively. Opcodes are found in one pass over the rows (no shuffle): lines
at both ends that agree are set aside; lines that stand once on both sides are anchors, of which a longest
increasing subsequence is kept; the gaps between them are done alike. In a gap without such lines the rarest
common lines are matched by a longest common subsequence, of at most MOST_MATCHES places at a time, so that a
line that stands very often on both sides costs no square. Whatever is matched, the opcodes rebuild the new
text from the old; added and removed lines and previews are native expressions over them.

A null text has no lines, as has an empty one; a line end at the end of a text begins no further line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of places that are searched for a common subsequence at a time.
MOST_MATCHES = 200_000
#: Lines of an edit that a preview shows.
PREVIEW_LINES = 3
#: Pairs of texts that are handed on at a time.
STEP_ROWS = 64

_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_OP = "struct<tag:string,i1:int,i2:int,j1:int,j2:int>"


def lines(text: Column) -> Column:
    """Lines of a text; none of an empty or null one."""
    every = F.split(F.coalesce(text, F.lit("")), _LINE_ENDS)
    return F.transform(F.array(every), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))[0]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tails, v)
        if p == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[p], at[p] = v, k
        before[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _anchors(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places that are matched in a gap whose first and last lines differ, increasing on both sides."""
    a, b = Counter(old), Counter(new)
    common = [x for x in a if x in b]
    once = {x for x in common if a[x] == b[x] == 1}
    if once:
        at = {x: j for j, x in enumerate(new) if x in once}
        pairs = [(i, at[x]) for i, x in enumerate(old) if x in once]
    else:
        budget, taken = MOST_MATCHES, set()
        for x in sorted(common, key=lambda x: (a[x] * b[x], x)):
            budget -= a[x] * b[x]
            if budget < 0:
                break
            taken.add(x)
        if taken:
            at_all: dict[str, list[int]] = {}
            for j, x in enumerate(new):
                if x in taken:
                    at_all.setdefault(x, []).append(j)
            # a place of the old text meets those of the new one from the last on, so an increasing subsequence takes one of them at most
            pairs = [(i, j) for i, x in enumerate(old) if x in taken for j in reversed(at_all[x])]
        elif common:  # the rarest common line alone has more: its occurrences are matched in order
            x = min(common, key=lambda x: (a[x] * b[x], x))
            pairs = list(zip((i for i, y in enumerate(old) if y == x), (j for j, y in enumerate(new) if y == x), strict=False))
        else:
            pairs = []
    keep = increasing([j for _, j in pairs])
    return [pairs[k] for k in keep]


def matched(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """(i, j) of all lines that are kept, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(old), 0, len(new))]
    while gaps:
        i1, i2, j1, j2 = gaps.pop()
        while i1 < i2 and j1 < j2 and old[i1] == new[j1]:
            out.append((i1, j1))
            i1, j1 = i1 + 1, j1 + 1
        while i1 < i2 and j1 < j2 and old[i2 - 1] == new[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i1 == i2 or j1 == j2:
            continue
        last_i, last_j = i1, j1
        for i, j in _anchors(old[i1:i2], new[j1:j2]):
            out.append((i1 + i, j1 + j))
            gaps.append((last_i, i1 + i, last_j, j1 + j))
            last_i, last_j = i1 + i + 1, j1 + j + 1
        if last_i > i1:
            gaps.append((last_i, i2, last_j, j2))
    return sorted(out)


def opcodes(old: list[str], new: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2) that cover both texts in order; equal runs and edits take turns."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for p, q in [*matched(old, new), (len(old), len(new))]:
        if p > i or q > j:
            out.append(("replace" if p > i and q > j else "delete" if p > i else "insert", i, p, j, q))
        if p < len(old):
            if out and out[-1][0] == "equal" and out[-1][2] == p:
                out[-1] = ("equal", out[-1][1], p + 1, out[-1][3], q + 1)
            else:
                out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    return out


def line_diff(pairs: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """The pairs' other columns with ``old`` and ``new`` (lines) and ``ops``."""
    rest = [c for c in pairs.columns if c not in (old_col, new_col)]
    split = pairs.select(*rest, lines(F.col(old_col)).alias("old"), lines(F.col(new_col)).alias("new"))
    names = [*rest, "old", "new", "ops"]
    op = pa.list_(pa.struct([("tag", pa.string()), *((c, pa.int32()) for c in ("i1", "i2", "j1", "j2"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STEP_ROWS):
                part = b.slice(lo, STEP_ROWS)
                found = [[dict(zip(("tag", "i1", "i2", "j1", "j2"), o, strict=True)) for o in opcodes(x.as_py(), y.as_py())] for x, y in zip(part.column(len(rest)), part.column(len(rest) + 1), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, op)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema.fields)
    return split.mapInArrow(run, f"{fields}, ops array<{_OP}>")


def edits(ops: Column) -> Column:
    return F.filter(ops, lambda o: o["tag"] != "equal")


def added(ops: Column) -> Column:
    """Numbers (from 1) of lines of the new text that the old one has not."""
    return F.flatten(F.transform(F.filter(ops, lambda o: (o["tag"] != "equal") & (o["j2"] > o["j1"])), lambda o: F.sequence(o["j1"] + 1, o["j2"])))


def removed(ops: Column, old: Column) -> Column:
    """(after_line, content): lines that went, and the line of the new text that they stood behind (0 at its beginning)."""
    return F.flatten(F.transform(edits(ops), lambda o: F.transform(F.slice(old, o["i1"] + 1, o["i2"] - o["i1"]), lambda x: F.struct(o["j1"].alias("after_line"), x.alias("content")))))


def previews(ops: Column, old: Column, new: Column) -> Column:
    """(line, before, after) of each edit, with its first lines on both sides."""
    first = lambda x, lo, hi: F.slice(x, lo + 1, F.least(hi - lo, F.lit(PREVIEW_LINES)))
    line = lambda o: F.greatest(F.lit(1), F.when(o["j2"] > o["j1"], o["j1"] + 1).otherwise(o["j1"]))
    return F.transform(edits(ops), lambda o: F.struct(line(o).alias("line"), first(old, o["i1"], o["i2"]).alias("before"), first(new, o["j1"], o["j2"]).alias("after")))


def rebuilt(ops: Column, old: Column, new: Column) -> Column:
    """The new text's lines from the old one's: equal runs are taken from the old text, others from the new."""
    take = lambda o: F.when(o["tag"] == "equal", F.slice(old, o["i1"] + 1, o["i2"] - o["i1"])).otherwise(F.slice(new, o["j1"] + 1, o["j2"] - o["j1"]))
    return F.flatten(F.transform(ops, take))
