"""What a goal of speed or memory finds in Python files, and which tests a change asks for.

Loops and calls come from Python's own parser, a file at a time; lines, caps and everything across files are native.
files: (path, text). A file that does not parse gives nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.code import each_file
from weftwork.operators.text import tags

# Calls that wait for something outside, words of goals, folders that are passed over, and how many findings a file and a folder give.
WAITING = r"\b(open|read|requests|urlopen|connect)\s*\("
TIME_WORDS, MEMORY_WORDS = ("ms", "响应"), ("内存",)
PASSED_OVER = ("node_modules", "target", ".git", "__pycache__")
MOST_OF_FILE, MOST_OF_FOLDER = 15, 100
URGENT_TAGS = ("bugfix", "security", "perf")

_FACTS = "file string, k int, kind string, line int, depth int"


def _loops(path: str, text: str) -> Iterator[tuple]:
    """In the order of the tree's levels: loops with the depth of those in them, sorting calls, and comprehensions of several loops; first a row that says that the file parses."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    yield path, 0, "file", 0, None
    depth: dict[ast.AST, int] = {}
    # children before their parents, so that a loop's depth is one more than the deepest below it
    stack, order = [tree], []
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(ast.iter_child_nodes(n))
    for n in reversed(order):
        below = max((depth[c] for c in ast.iter_child_nodes(n)), default=0)
        depth[n] = below + isinstance(n, (ast.For, ast.While))
    for k, n in enumerate(ast.walk(tree), 1):
        if isinstance(n, (ast.For, ast.While)) and depth[n] >= 2:
            yield path, k, "complexity", n.lineno, depth[n]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "sorted":
            yield path, k, "hotspot", n.lineno, None
        elif isinstance(n, ast.ListComp) and len(n.generators) >= 2:
            yield path, k, "memory", n.lineno, len(n.generators)


def performance(files: DataFrame, goal: str, most: int = MOST_OF_FILE) -> DataFrame:
    """(file, kind, line, depth, rank): what speaks against a goal, in order, the first ``most`` of each file.

    Nested loops and sorting speak against any; calls that wait where the goal is a time; comprehensions of several loops where it is memory.
    """
    known = files.where(F.lower("path").endswith(".py"))
    facts = each_file(known, _loops, _FACTS)
    wanted = ["complexity", "hotspot"] + ["memory"] * (any(w in goal for w in MEMORY_WORDS) or "memory" in goal.lower())
    found = facts.where(F.col("kind").isin(wanted)).select("file", F.when(F.col("kind") == "memory", 2).otherwise(0).alias("part"), "k", "kind", "line", "depth")
    if any(w in goal for w in TIME_WORDS):
        split = known.select(F.col("path").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("k", "x"))
        waits = split.where(F.rlike("x", F.lit("(?U)" + WAITING))).join(facts.where("kind = 'file'").select("file"), "file", "left_semi")
        found = found.unionByName(waits.select("file", F.lit(1).alias("part"), "k", F.lit("io_in_hot_path").alias("kind"), (F.col("k") + 1).alias("line"), F.lit(None).cast("int").alias("depth")))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("part", "k", "line"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("file", "kind", "line", "depth", "rank")


def performance_report(files: DataFrame, goal: str, root: Column, most: int = MOST_OF_FOLDER) -> tuple[DataFrame, DataFrame]:
    """(root, files, findings) of each folder, and its first ``most`` findings by file and rank; folders of other people's files are passed over."""
    inside = ~F.rlike("path", F.lit("(^|/)(" + "|".join(f.replace(".", r"\.") for f in PASSED_OVER) + ")/"))
    own = files.where(inside & F.lower("path").endswith(".py")).withColumn("root", root)
    found = performance(own.select("path", "text"), goal).join(own.select(F.col("path").alias("file"), "root"), "file")
    n = own.groupBy("root").agg(F.count("*").alias("files")).join(found.groupBy("root").agg(F.count("*").alias("findings")), "root", "left").select("root", "files", F.coalesce("findings", F.lit(0)).alias("findings"))
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("file", "rank"))).where(F.col("_k") <= most).drop("_k")
    return n, first


def affected_tests(changed: DataFrame, listing: DataFrame, messages: DataFrame) -> DataFrame:
    """(test, reason, priority): tests that exist for changed files (path), of a listing (path), and 0 for all if a message (message) speaks of a fix, of security or of speed, else 1.

    A test is named after the file, as ``test_x`` or ``x_test``, beside it, below ``tests`` at the top, or in a folder ``tests`` beside it; of several changed files the
    smallest path is the reason.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    base = F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    below = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "/")
    names = F.array(*(F.concat(F.lit(a), stem, F.lit(b)) for b in (".py", ".rs") for a in ("test_",)), *(F.concat(stem, F.lit(b)) for b in ("_test.py", "_test.rs")))
    places = F.array(folder, below(F.lit("tests"), folder), below(folder, F.lit("tests")))
    asked = changed.select(F.col("path").alias("source"), F.explode(F.flatten(F.transform(places, lambda d: F.transform(names, lambda n: below(d, n))))).alias("test"))
    found = asked.join(listing.select(F.col("path").alias("test")).distinct(), "test", "left_semi").groupBy("test").agg(F.min("source").alias("reason"))
    urgent = messages.select(F.max(F.arrays_overlap(tags(F.col("message")), F.array(*map(F.lit, URGENT_TAGS)))).alias("urgent"))
    return found.join(F.broadcast(urgent)).select("test", "reason", F.when(F.coalesce("urgent", F.lit(False)), 0).otherwise(1).alias("priority"))
