"""Taint across calls: which dangerous calls a value from outside can reach, through any number of functions and files.

Each file is read once, into facts about its functions: their parameters, which of their parameters (or
which values from outside) they hand to which argument of which call, and which reach a dangerous call. All
else is joins: callees are resolved to definitions, and a semi-naive fixpoint over (function, parameter)
joins in each round only what the round before found. It ends when a round finds nothing, however long the
chains are; functions that call each other in a ring are found once.

files: (path, text). A file that does not parse has no facts. Of definitions of one name in a file the
outermost first one counts; a name that its own file does not define is that of the smallest path that does.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.code import each_file
from weftwork.operators.graph import MOST_FRONT
from weftwork.operators.lineage import cut

# Calls whose result comes from outside, what they may be called on, and calls that are dangerous with it.
SOURCES = ("get", "input", "getenv")
SOURCE_OWNERS = ("", "args", "os", "sys")
SINKS = ("open", "eval", "system", "Popen", "execute")

FACTS = "file string, fn string, kind string, line int, origin int, name string, pos int, keyword string, params array<string>"
#: The origin of a value from outside; others are places of parameters.
OUTSIDE = -1


def _called(node: ast.Call) -> tuple[str, str]:
    """(name, what it is called on) of a call; an expression other than a name is no owner."""
    f = node.func
    if isinstance(f, ast.Name):
        return f.id, ""
    if isinstance(f, ast.Attribute):
        return f.attr, f.value.id if isinstance(f.value, ast.Name) else "?"
    return "", "?"


def _is_source(node: ast.AST) -> bool:
    if not isinstance(node, ast.Call):
        return False
    name, owner = _called(node)
    return name in SOURCES and owner in SOURCE_OWNERS


def _carried(node: ast.AST, known: dict[str, frozenset[int]]) -> frozenset[int]:
    """Origins of a value: of a name, of text that is put together from it, or of a source."""
    if isinstance(node, ast.Name):
        return known.get(node.id, frozenset())
    if _is_source(node):
        return frozenset([OUTSIDE])
    if isinstance(node, ast.BinOp):
        return _carried(node.left, known) | _carried(node.right, known)
    if isinstance(node, ast.JoinedStr):
        return frozenset().union(*(_carried(v.value, known) for v in node.values if isinstance(v, ast.FormattedValue)))
    return frozenset()


def _facts(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    seen: set[str] = set()
    for fn in ast.walk(tree):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)) or fn.name in seen:
            continue
        seen.add(fn.name)
        params = [a.arg for a in [*fn.args.posonlyargs, *fn.args.args]]
        yield path, fn.name, "def", fn.lineno, None, None, None, None, params
        known = {p: frozenset([k]) for k, p in enumerate(params)}
        for node in sorted((n for n in ast.walk(fn) if isinstance(n, (ast.Assign, ast.Call))), key=lambda n: (n.end_lineno, n.end_col_offset, n.lineno, n.col_offset)):
            if isinstance(node, ast.Assign):
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        known[t.id] = _carried(node.value, known)
                continue
            name, owner = _called(node)
            kinds = ["sink"] * (name in SINKS) + ["call"] * (owner != "?" and name != "")
            values = [(k, None, a) for k, a in enumerate(node.args)] + [(None, k.arg, k.value) for k in node.keywords if k.arg]
            for kind in kinds:
                for pos, keyword, value in values:
                    for origin in sorted(_carried(value, known)):
                        yield path, fn.name, kind, node.lineno, origin, name, pos, keyword, None


def facts(files: DataFrame) -> DataFrame:
    """Facts of all functions: ``def`` rows with parameters, ``call`` and ``sink`` rows with the origin of an argument."""
    return each_file(files, _facts, FACTS)


def flows(found: DataFrame) -> DataFrame:
    """(file, fn, origin, to_file, to_fn, to_pos): arguments that carry a parameter or a value from outside, at the definition that is called."""
    defs = found.where("kind = 'def'").select(F.col("file").alias("to_file"), F.col("fn").alias("name"), "params")
    calls = found.where("kind = 'call'").select("file", "fn", "origin", "name", "pos", "keyword").distinct()
    own = defs.select(F.col("to_file").alias("file"), "name", F.struct("to_file", "params").alias("own"))
    anywhere = defs.groupBy("name").agg(F.min(F.struct("to_file", "params")).alias("any"))
    at = calls.join(own, ["file", "name"], "left").join(anywhere, "name", "left").withColumn("at", F.coalesce("own", "any")).where("at IS NOT NULL")
    to_pos = F.coalesce("pos", (F.array_position("at.params", F.col("keyword")) - 1).cast("int"))
    return at.select("file", "fn", "origin", F.col("at.to_file").alias("to_file"), F.col("name").alias("to_fn"), to_pos.alias("to_pos"), F.size("at.params").alias("n")).where("to_pos >= 0 AND to_pos < n").drop("n").distinct()


def tainted(links: DataFrame, trust_parameters: bool = True) -> DataFrame:
    """(file, fn, pos, depth): parameters that a value from outside reaches, with the least number of calls on its way.

    If parameters are not trusted, every function's own count as from outside, so whatever passes one on is a start too.
    """
    links = cut(links)
    to = [F.col("to_file").alias("file"), F.col("to_fn").alias("fn"), F.col("to_pos").alias("pos")]
    start = links.where(F.col("origin") == OUTSIDE) if trust_parameters else links
    front = seen = cut(start.select(*to).distinct().withColumn("depth", F.lit(1)))
    steps = links.where(F.col("origin") != OUTSIDE).withColumnRenamed("origin", "pos")
    size, depth = front.count(), 1
    while size:
        depth += 1
        own = front.select("file", "fn", "pos")
        reached = steps.join(F.broadcast(own) if size <= MOST_FRONT else own, ["file", "fn", "pos"]).select(*(F.col(f"to_{c}").alias(c) for c in ("file", "fn", "pos"))).distinct()
        front = cut(reached.join(seen, ["file", "fn", "pos"], "left_anti").withColumn("depth", F.lit(depth)))
        size = front.count()
        seen = seen.unionByName(front)
    return seen


def taint_findings(files: DataFrame, trust_parameters: bool = True) -> DataFrame:
    """(file, fn, line, sink, depth): dangerous calls that a value from outside reaches; depth 0 is within the function."""
    found = cut(facts(files))
    sinks = found.where("kind = 'sink'").select("file", "fn", "line", F.col("name").alias("sink"), F.col("origin").alias("pos"))
    inside = sinks.where(F.col("pos") == OUTSIDE).withColumn("depth", F.lit(0))
    across = sinks.join(tainted(flows(found), trust_parameters), ["file", "fn", "pos"])
    return inside.unionByName(across).groupBy("file", "fn", "line", "sink").agg(F.min("depth").alias("depth"))
