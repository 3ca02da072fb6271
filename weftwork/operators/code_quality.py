"""Ten detectors of careless code (DEAD-001 to DEAD-010) for Python, Go, C, C++, Rust, TypeScript and JavaScript.

files: (path, text); the language is that of the path's suffix, and files of others are left out. Rules on
lines are one projection over a file's array of lines, so nothing is shuffled and a line sees its
neighbours by place. What needs Python's syntax (names that are used, bodies that do nothing, handlers that
swallow, runs of ``try``) comes from its own parser, over Arrow batches of Python files alone; a Python file
that does not parse has no such findings.

Where the order of things would decide by accident the sensible reading is taken: a Rust or TypeScript name is
looked for outside the line that imports it, and every function's body is scanned for runs of ``try`` once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators.code import each_file

FINDINGS = "file string, line int, rule string, severity string, subject string"

# Suffixes, weights, words, names, calls and patterns that the detectors look for.
LANGUAGES = {
    ".py": "python", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
}
WEIGHTS = {"Blocker": 25, "Critical": 15, "Warning": 5}
PLACEHOLDERS = [
    "TODO", "FIXME", "XXX", "HACK", "NotImplementedError", "NotImplemented", "placeholder", "Placeholder", "PLACEHOLDER", "stub", "Stub", "STUB", "dummy", "Dummy",
    "模拟实现", "内存模拟", "模拟数据", "假数据", "后续实现", "后续替换", "暂时实现", "临时实现",
]
FAKE_MARKS = ["模拟实现", "内存模拟", "模拟数据", "假数据", "后续替换", "后续实现", "暂时实现", "临时实现", "临时方案", "示例实现"]
STUB_MARKS = ["注入实现", "由子类", "外部注入", "embed_fn", "外部实现"]
MEANINGLESS = "data[0-9]?|temp[0-9]?|tmp[0-9]?|foo|bar|baz|qux|stuff|thing|things|obj[0-9]?|item[0-9]?|var[0-9]?|val[0-9]?|misc|something|whatever|asdf"
INVENTED_CALLS = [
    ("python", r"\.to_iso_string\("), ("python", r"\.to_isoformat\("), ("python", r"\.reverse\(\)\s*$"), ("python", r"\.remove_all\("), ("python", r"\.contains\("),
    ("python", r"\.size\(\)"), ("python", r"\.length\(\)"), ("python", r"\.first\(\)"), ("python", r"\.last\(\)"), ("python", r"\.push\("),
    ("python", r"datetime\.now\(\)\.strftime\([^)]*\)\.to_iso"), ("javascript", r"\.last\(\)\b(?!\s*[:(])"), ("javascript", r"\.contains\("),
    ("typescript", r"\.contains\("), ("go", r"strings\.ContainsAny\([^,]*\)"),
]
OBVIOUS_COMMENTS = [
    r"#\s*(i|j|k|n|count|cnt|num)\s*\+?=\s*1\s*$", r"#\s*(循环|返回|输出|打印|初始化|定义|赋值|加一|自增|递增|开始|结束)\s*$", r"#\s*return\s*$", r"(?i)#\s*for\s+loop\s*$",
    r"(?i)#\s*if\s+statement\s*$", r"(?i)#\s*(get|set|create|delete|update)\s*$", r"//\s*(循环|返回|输出|打印|初始化|定义|赋值|开始|结束)\s*$", r"(?i)//\s*for\s+loop\s*$", r"//\s*return\s*$",
]
SAYING_CALLS = ("print", "log", "logging", "logger", "warn", "warning", "debug", "info", "error")
MOST_OBVIOUS, MOST_COMMENT_SHARE, LEAST_RUN, LEAST_FACTORIES, LEAST_NAMES = 20, 0.5, 3, 3, 5

_BRACED = ("c", "cpp", "rust", "go", "typescript", "javascript")
_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def language(path: Column) -> Column:
    """The language of a file's suffix, or null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), suffix)


def _finding(line: Column, rule: str, severity: str, subject: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(f"DEAD-{rule}").alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"))


def _u(pattern: str) -> str:
    """A pattern whose classes are Unicode's."""
    return "(?U)" + pattern


def _like(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(_u(pattern)))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_u(pattern)), group)


def _if(condition: Column, found: Column) -> Column:
    """An array with the finding, or an empty one."""
    return F.when(condition, F.array(found)).otherwise(F.array().cast(f"array<{_FOUND}>"))


_FOUND = "struct<line:int,rule:string,severity:string,subject:string>"


def _blank(line: Column) -> Column:
    return ~_like(line, r"\S")


def _comment(line: Column, lang: Column) -> Column:
    return F.when(lang == "python", _like(line, r"^\s*#")).otherwise(_like(line, r"^\s*(//|/\*|\*)"))


def _line_findings(lines: Column, lang: Column, text: Column) -> Column:
    """Findings that a line gives, with what stands before it or elsewhere in the file."""
    braced, python = lang.isin(*_BRACED), lang == "python"

    def of(x: Column, i: Column) -> Column:
        at = i + 1
        placeholders = F.transform(F.filter(F.array(*map(F.lit, PLACEHOLDERS)), lambda w: F.contains(x, w)), lambda w: _finding(at, "002", "Critical", w))
        marks = F.transform(F.filter(F.array(*map(F.lit, FAKE_MARKS)), lambda w: F.contains(x, w)), lambda w: _finding(at, "003", "Blocker", w))
        marked = F.when(~python & ~_like(x, r"^\s*(#|//|/\*|\* |--)"), marks).otherwise(F.array().cast(f"array<{_FOUND}>"))
        empty = braced & _like(x, r"\{\s*\}") & ~_like(x, r"(=>|return|=|const|let|var)\s*\{\s*\}")
        nothing = braced & _like(x, r"\{\s*return\s*(None|null|nil|undefined)?\s*;?\s*\}")
        names = F.transform(F.array_distinct(_all(x, rf"\b({MEANINGLESS})\b", 1)), lambda w: _finding(at, "005", "Warning", w))
        before = F.get(lines, i - 1)
        silent = ~python & _like(x, r"catch\s*\([^)]*\)\s*\{\s*\}")
        said = ~python & _like(x, r"^\s*(console\.log|print|fmt\.Println|println)\s*\(") & F.contains(before, F.lit("catch"))
        invented = F.coalesce(*(F.when((lang == own) & _like(x, p), F.lit(p)) for own, p in INVENTED_CALLS))
        package = F.regexp_extract(x, _u(r'^\s*"([^"]+)"\s*$'), 1)
        last = F.regexp_extract(package, r"([^/]*)$", 1)
        unused_go = (lang == "go") & (last != "") & ~F.rlike(text, F.concat(F.lit(r"(?U)\b\Q"), last, F.lit(r"\E\.")))
        path = F.regexp_extract(x, _u(r"^\s*use\s+([\w:]+)"), 1)
        item = F.regexp_extract(path, _u(r"(\w*)$"), 1)
        elsewhere = lambda w: F.exists(F.transform(lines, lambda y, j: (j != i) & F.rlike(y, F.concat(F.lit(r"(?U)\b\Q"), w, F.lit(r"\E\b")))), lambda found: found)
        unused_rust = (lang == "rust") & (item != "") & ~elsewhere(item)
        imported = F.regexp_extract(x, _u(r"^\s*import\s+(?:type\s+)?\{([^}]+)\}\s+from"), 1)
        bound = F.filter(F.transform(F.split(imported, ","), lambda w: F.regexp_extract(w, _u(r"([\w$]+)\s*$"), 1)), lambda w: w != "")
        unused_script = F.when(
            lang.isin("typescript", "javascript") & (imported != ""), F.transform(F.filter(bound, lambda w: ~elsewhere(w)), lambda w: _finding(at, "001", "Critical", w))
        ).otherwise(F.array().cast(f"array<{_FOUND}>"))
        return F.concat(
            _if(unused_go, _finding(at, "001", "Critical", package)), _if(unused_rust, _finding(at, "001", "Critical", path)), unused_script, placeholders, marked,
            _if(empty, _finding(at, "003", "Blocker", F.lit("{}"))), _if(nothing, _finding(at, "003", "Blocker", F.lit("return"))), names,
            _if(silent, _finding(at, "008", "Critical", F.lit("catch"))), _if(F.coalesce(said, F.lit(False)), _finding(at, "008", "Critical", F.lit("catch and print"))),
            _if(invented.isNotNull(), _finding(at, "009", "Blocker", invented)),
        )

    return F.flatten(F.transform(lines, of))


def _file_findings(lines: Column, lang: Column, text: Column) -> Column:
    """Findings that need a file as a whole: comments that say what stands there, factories of one thing, runs of lines, mixed names."""
    full = F.filter(lines, lambda x: ~_blank(x))
    n_comments = F.size(F.filter(full, lambda x: _comment(x, lang)))
    n_code = F.size(full) - n_comments
    said = F.filter(F.transform(lines, lambda x, i: F.when(_comment(x, lang) & F.rlike(x, F.lit("|".join(f"(?:{'(?U)' + p})" for p in OBVIOUS_COMMENTS))), i + 1)), lambda i: i.isNotNull())
    obvious = F.when((n_code > 0) & (n_comments > n_code * MOST_COMMENT_SHARE), F.transform(F.slice(said, 1, MOST_OBVIOUS), lambda i: _finding(i, "004", "Warning", F.lit("comment")))).otherwise(F.array().cast(f"array<{_FOUND}>"))
    factories = F.size(_all(text, r"def\s+(create|make|build)\w*\s*\(", 1))
    made = F.array_distinct(_all(text, r"return\s+(\w+)\(", 1))
    kinds = F.transform(lines, lambda x: F.when(_like(x, r"^\s*(try|catch)"), "try").when(_like(x, r"^\s*if") & F.contains(x, F.lit("==")), "if-eq").otherwise(""))

    def runs(k: Column) -> Column:
        same = lambda i, step: F.coalesce(F.get(k, i + step) == F.get(k, i), F.lit(False))
        begins = lambda x, i: (x != "") & ~same(i, -1) & same(i, 1) & same(i, 2)
        found = F.transform(k, lambda x, i: F.when(begins(x, i), _finding(i + 1, "007", "Warning", x)))
        return F.filter(found, lambda x: x.isNotNull())

    repeated = F.when(lang.isin(*_BRACED), F.transform(F.array(kinds), runs)[0]).otherwise(F.array().cast(f"array<{_FOUND}>"))
    code = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(#|//).*$", ""), r'"[^"]*"', '""'), r"'[^']*'", "''"))
    joined = F.concat_ws("\n", code)
    humps, bars = (F.size(_all(joined, p, 0)) for p in (r"\b[a-z][a-z0-9]*[A-Z]\w*\b", r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b"))
    return F.concat(
        obvious, _if((factories >= LEAST_FACTORIES) & (F.size(made) == 1), _finding(F.lit(1), "006", "Warning", made[0])), repeated,
        _if((humps >= LEAST_NAMES) & (bars >= LEAST_NAMES), _finding(F.lit(1), "010", "Warning", F.concat(humps.cast("string"), F.lit(" and "), bars.cast("string")))),
    )


def _does_nothing(fn: ast.FunctionDef) -> bool:
    real = [s for s in fn.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if not real:
        return True
    if len(real) > 1:
        return False
    (only,) = real
    if isinstance(only, ast.Return):
        v = only.value
        return v is None or isinstance(v, ast.Constant) and v.value in (None, "") or isinstance(v, ast.Dict) and not v.keys or isinstance(v, ast.List) and not v.elts
    return isinstance(only, ast.Pass)


def _marked(node: ast.AST, name: str) -> bool:
    return any(getattr(d, "id", getattr(d, "attr", None)) == name for d in node.decorator_list)


def _python(path: str, text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError):
        tree = ast.Module([], [])
    put = lambda line, rule, severity, subject: (path, line, f"DEAD-{rule}", severity, subject)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    nodes = list(ast.walk(tree))
    used = {n.id for n in nodes if isinstance(n, ast.Name)}
    in_docs: set[int] = set()
    base = path.replace("\\", "/").split("/")[-1]
    is_test = "test_" in base or "_test" in base
    for n in nodes:
        body = getattr(n, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            in_docs.update(range(body[0].lineno, body[0].end_lineno + 1))
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            for a in n.names:
                bound = a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.split(".")[0])
                if a.name != "*" and bound not in used and bound != "__future__":
                    yield put(n.lineno, "001", "Critical", bound)
        elif isinstance(n, functions):
            if n.name not in used and not (n.name.startswith("_") and n.name.endswith("_")):
                yield put(n.lineno, "001", "Warning", n.name)
            if isinstance(n, ast.FunctionDef) and _does_nothing(n) and not _marked(n, "abstractmethod") and not is_test and not any(k in (ast.get_docstring(n) or "") for k in STUB_MARKS):
                yield put(n.lineno, "003", "Blocker", n.name)
        elif isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, functions)]
            free = lambda m: any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in m.decorator_list)
            if len(methods) >= 2 and all(map(free, methods)):
                yield put(n.lineno, "006", "Warning", n.name)
        elif isinstance(n, ast.ExceptHandler) and "#" not in "\n".join(lines[n.lineno - 1 : n.body[0].lineno + 1]) and len(n.body) == 1:
            (only,) = n.body
            if isinstance(only, ast.Pass):
                yield put(n.lineno, "008", "Critical", "pass")
            elif isinstance(only, ast.Expr) and isinstance(only.value, ast.Call):
                name = getattr(only.value.func, "id", getattr(only.value.func, "attr", ""))
                if name in SAYING_CALLS:
                    yield put(n.lineno, "008", "Critical", name)
        if isinstance(n, (ast.Module, *functions)):
            run: list[ast.stmt] = []
            for s in [*n.body, None]:
                if isinstance(s, ast.Try):
                    run.append(s)
                    continue
                if len(run) >= LEAST_RUN:
                    yield put(run[0].lineno, "007", "Warning", "try")
                run = []
    for i, line in enumerate(lines, 1):
        if i not in in_docs and not re.match(r"\s*(#|//|/\*|\* |--)", line):
            for w in FAKE_MARKS:
                if w in line:
                    yield put(i, "003", "Blocker", w)


def code_quality(files: DataFrame) -> DataFrame:
    """(file, line, rule, severity, subject) of all ten detectors."""
    known = files.select("path", F.coalesce("text", F.lit("")).alias("text"), language(F.col("path")).alias("lang")).where("lang IS NOT NULL")
    split = known.withColumn("lines", F.split("text", _LINE_ENDS))
    every = F.concat(_line_findings(F.col("lines"), F.col("lang"), F.col("text")), _file_findings(F.col("lines"), F.col("lang"), F.col("text")))
    on_lines = split.select(F.col("path").alias("file"), F.inline(every))
    return on_lines.unionByName(each_file(known.where("lang = 'python'"), _python, FINDINGS))


def quality_report(files: DataFrame, findings: DataFrame, by: Column) -> DataFrame:
    """Per group of files: files, findings by severity, the score (weights added up, 100 at most), and whether it passes."""
    n = files.where(language(F.col("path")).isNotNull()).groupBy(by.alias("part")).agg(F.count("*").alias("files"))
    counts = findings.withColumnRenamed("file", "path").groupBy(by.alias("part")).agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in WEIGHTS))
    j = n.join(counts, "part", "left").na.fill(0)
    score = sum((F.col(s.lower()) * w for s, w in list(WEIGHTS.items())[1:]), F.col("blocker") * WEIGHTS["Blocker"])
    return j.select("part", "files", "findings", *(s.lower() for s in WEIGHTS), F.least(score, F.lit(100)).alias("score"), ((F.col("blocker") == 0) & (F.col("critical") == 0)).alias("passed"))
