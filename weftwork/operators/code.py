"""Findings and symbols of Python source files, and relational questions about them.

Parsing needs the whole file and Python's own parser, so it runs over Arrow batches; everything after it is joins.
files: (path, text). A file that does not parse gives one finding and no symbols.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftwork.operators.relations import asof_join

FINDINGS = "file string, line int, col int, rule string, severity string, snippet string"
#: Files that are parsed before their rows are handed on.
STEP_FILES = 64
SYMBOLS = "file string, line int, name string, kind string, body string"

_CALLS = {
    "eval": "dynamic_exec", "exec": "dynamic_exec", "os.system": "shell_injection", "os.popen": "shell_injection", "pickle.load": "unsafe_pickle", "pickle.loads": "unsafe_pickle",
    "random.random": "insecure_random", "random.randint": "insecure_random", "random.choice": "insecure_random",
}
_SEVERE = {"dynamic_exec", "shell_injection", "unsafe_pickle", "unsafe_yaml", "tar_path_traversal", "taint_flow", "divide_by_zero", "syntax_error"}
_SOURCES, _SINKS = {"input", "os.getenv", "os.environ.get"}, {"eval", "exec", "os.system", "os.popen", "open", "subprocess.run", "subprocess.call", "subprocess.Popen"}


def _name(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _name(node.value)):
        return f"{base}.{node.attr}"
    return ""


def _nothing(body: list[ast.stmt]) -> bool:
    return all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in body)


def _call_rules(node: ast.Call) -> Iterator[str]:
    name, words = _name(node.func), {k.arg: k.value for k in node.keywords}
    true = lambda k: isinstance(words.get(k), ast.Constant) and words[k].value is True
    if name in _CALLS:
        yield _CALLS[name]
    if name.startswith("subprocess.") and true("shell"):
        yield "shell_injection"
    if name == "yaml.load" and "Safe" not in ast.dump(node):
        yield "unsafe_yaml"
    if name.endswith(".extractall") and "filter" not in words:
        yield "tar_path_traversal"
    if re.fullmatch(r"requests\.(get|post|put|delete|patch|head|request)", name) and "timeout" not in words:
        yield "request_no_timeout"
    if re.fullmatch(r"re\.\w+", name) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) and re.search(r"\([^()]*[+*]\)[+*]", node.args[0].value):
        yield "regex_dos"


def _rules(node: ast.AST) -> Iterator[str]:
    if isinstance(node, ast.ExceptHandler):
        if node.type is None:
            yield "bare_except"
        elif _name(node.type) in ("Exception", "BaseException"):
            yield "overwide_except"
        if _nothing(node.body):
            yield "swallowed_exception"
    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*node.args.defaults, *node.args.kw_defaults]):
            yield "mutable_default_arg"
    elif isinstance(node, ast.BinOp):
        if isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)) and isinstance(node.right, ast.Constant) and type(node.right.value) in (int, float) and node.right.value == 0:
            yield "divide_by_zero"
    elif isinstance(node, ast.Assert):
        yield "assert_validation"
    elif isinstance(node, ast.Subscript):
        if isinstance(node.value, (ast.List, ast.Tuple)) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, int) and node.slice.value >= len(node.value.elts):
            yield "index_out_of_range"
    elif isinstance(node, ast.Call):
        yield from _call_rules(node)


def _taint(function: ast.AST) -> Iterator[ast.Call]:
    """Sinks in a function that are reached by a source's value through assignments, in the order of the text."""
    dirty: set[str] = set()

    def is_dirty(x: ast.AST) -> bool:
        return any(isinstance(n, ast.Name) and n.id in dirty or isinstance(n, ast.Call) and _name(n.func) in _SOURCES for n in ast.walk(x))

    for node in sorted((n for n in ast.walk(function) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    (dirty.add if is_dirty(node.value) else dirty.discard)(t.id)
        elif isinstance(node, ast.Call) and _name(node.func) in _SINKS and any(is_dirty(a) for a in node.args):
            yield node


def _findings(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield path, getattr(e, "lineno", None) or 1, 0, "syntax_error", "Critical", ""
        return
    rows = text.split("\n")
    put = lambda node, rule: (path, node.lineno, node.col_offset, rule, "Critical" if rule in _SEVERE else "Warning", rows[node.lineno - 1].strip()[:80])
    for node in ast.walk(tree):
        for rule in _rules(node):
            yield put(node, rule)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for sink in _taint(node):
                yield put(sink, "taint_flow")


def _symbols(path: str, text: str) -> Iterator[tuple]:
    """def, import, use and incomplete rows; a definition's body is the digest of its text without white space if that has 60 characters or more."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            squeezed = re.sub(r"\s+", "", "".join(ast.unparse(s) for s in node.body))[:400]
            yield path, node.lineno, node.name, "def", hashlib.sha256(squeezed.encode()).hexdigest() if len(squeezed) >= 60 else None
            if not isinstance(node, ast.ClassDef) and (_nothing(node.body) or len(node.body) == 1 and isinstance(node.body[0], ast.Raise) and "NotImplementedError" in ast.dump(node.body[0])):
                yield path, node.lineno, node.name, "incomplete", None
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                yield path, node.lineno, (a.asname or a.name).split(".")[0], "import", None
        elif isinstance(node, ast.Name):
            yield path, node.lineno, node.id, "use", None
        elif isinstance(node, ast.Attribute):
            yield path, node.lineno, node.attr, "use", None


def each_file(files: DataFrame, rows: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of a helper that sees one file's path and text (a null is empty), in Arrow batches."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, STEP_FILES):
                part = b.slice(lo, STEP_FILES)
                found = [r for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows(p, t or "")]
                columns = zip(*found, strict=True) if found else ([] for _ in arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, kind)


def findings(files: DataFrame) -> DataFrame:
    return each_file(files, _findings, FINDINGS)


def symbols(files: DataFrame) -> DataFrame:
    return each_file(files, _symbols, SYMBOLS)


def dead_definitions(s: DataFrame) -> DataFrame:
    """Definitions whose name is used nowhere; private and test names are left out."""
    uses = s.where("kind = 'use'").select("name").distinct()
    return s.where("kind = 'def' AND NOT startswith(name, '_') AND NOT startswith(name, 'test')").join(uses, "name", "left_anti").select("file", "line", "name")


def unused_imports(s: DataFrame) -> DataFrame:
    """Imports whose name their own file does not use."""
    lines = F.collect_list(F.when(F.col("kind") == "import", F.col("line")))
    names = s.where("kind IN ('import', 'use')").groupBy("file", "name").agg(lines.alias("lines"), F.count_if(F.col("kind") == "use").alias("uses"))
    return names.where("uses = 0").select("file", F.explode("lines").alias("line"), "name")


def duplicate_bodies(s: DataFrame) -> DataFrame:
    """(body, n, first file): definitions with equal bodies."""
    return s.where("kind = 'def' AND body IS NOT NULL").groupBy("body").agg(F.count("*").alias("n"), F.min("file").alias("first_file")).where("n > 1")


def duplicate_definitions(s: DataFrame) -> DataFrame:
    """(name, n): names that are defined in several places."""
    return s.where("kind = 'def' AND NOT startswith(name, '_') AND NOT startswith(name, 'test')").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def annotate(found: DataFrame, s: DataFrame) -> DataFrame:
    """Findings with the definition that they stand in: the last that begins at or before their line."""
    at = asof_join(found, s.where("kind = 'def'").groupBy("file", "line").agg(F.max("name").alias("name")), ["file"], "line", "line", ["name"])
    return at.withColumn("symbol", F.coalesce("asof_name", F.lit("<unknown>"))).drop("asof_name")
