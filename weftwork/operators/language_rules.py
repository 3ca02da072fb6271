"""Rules on lines of many languages, states of null pointers and nil maps, placeholders and magic numbers, and dispatch by suffix.

files: (path, text). Everything is one projection over a file's array of lines: a line gives the first rule of
its language that it matches, pointers and maps are declared and used by names that are compared as arrays, and
nothing is shuffled but the cap of findings a rule and file. A match lies within a line.
``code_only`` blanks comments and what stands in strings, block comments over several lines too, so that rules can
be run on code alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators import code
from weftwork.operators.rule_pack import first_hits

# Rules (pattern, rule, severity) of each suffix, in the order of trial, and suffixes that stand for others.
_C_FAMILY = [
    (r"\bgoto\s+[A-Za-z_]\w*\s*;", "goto_used", "warning"), (r"\bstrcpy\s*\(|\bstrcat\s*\(|\bsprintf\s*\(", "unsafe_string", "warning"),
    (r"\bgets\s*\(", "gets_unsafe", "error"), (r"\b\w*\s*=\s*realloc\s*\(", "realloc_unchecked", "warning"),
]
_CONSOLE = (r"console\.log\s*\(", "debug_residue", "warning")
_EVAL = (r"\beval\s*\(", "dynamic_exec", "error")
_LOOSE = (r"(?<![=!<>])==(?!=)", "loose_eq", "warning")
_TIMEOUT = (r"setTimeout\s*\(\s*['\"]", "string_exec", "warning")
_ANY = (r"\bany\s*[\):,=\s]", "any_abuse", "info")
_REACT = (r"dangerouslySetInnerHTML", "xss_risk", "warning")
_PRINT = (r"\bprint\s*\(", "debug_residue", "warning")
_PRINTLN = (r"\bprintln\s*\(", "debug_residue", "warning")
_NOT_NULL = (r"!!(?=\s|\)|,|;|$)", "nonnull_assert", "warning")
RULES = {
    ".go": [
        (r"\bfmt\.Println?\s*\(", "debug_residue", "warning"), (r"\bpanic\s*\(", "panic", "warning"), (r"\bgo\s+[A-Za-z_][\w.]*\s*\(", "goroutine_sync", "info"),
        (r"\brecover\s*\(\).*$", "recover_ignored", "warning"), (r",\s*_\s*:?=\s*[A-Za-z_][\w.]*\s*\(", "err_ignored", "warning"),
    ],
    ".ts": [_CONSOLE, _ANY, _EVAL, _LOOSE, _TIMEOUT],
    ".tsx": [_CONSOLE, _ANY, _EVAL, _LOOSE, _REACT, _TIMEOUT],
    ".js": [_CONSOLE, _EVAL, (r"\.innerHTML\s*=", "xss_risk", "warning"), _LOOSE, _TIMEOUT, (r"\bvar\s+[A-Za-z_$][\w$]*", "var_leak", "info"), (r"\bparseInt\s*\(\s*[A-Za-z_$][\w$]*\s*\)", "parseint_radix", "warning")],
    ".jsx": [_CONSOLE, _EVAL, _LOOSE, _REACT, _TIMEOUT],
    ".gd": [_PRINT, (r"\bget_node\s*\([^)]*\)\s*\.", "null_access", "warning"), (r"\bfree(\s*[^)]*)\s*;?", "free_unsafe", "warning")],
    ".c": [(r"\bprintf\s*\(", "debug_residue", "warning"), *_C_FAMILY],
    ".cpp": [(r"std::cout\s*<<", "debug_residue", "warning"), *_C_FAMILY],
    ".h": [(r"\bprintf\s*\(", "debug_residue", "warning"), *_C_FAMILY],
    ".hpp": [(r"std::cout\s*<<", "debug_residue", "warning"), *_C_FAMILY],
    ".cs": [
        (r"\bConsole\.Write(?:Line)?\s*\(", "debug_residue", "warning"), (r"\bDebug\.Log\s*\(", "debug_residue", "warning"), (r"\bthrow\s+new\s+Exception\s*\(", "bare_throw", "warning"),
        (r"\(\s*(?:string|int|long|double|float|bool|object)\s*\)\s*[A-Za-z_]", "unsafe_cast", "warning"), (r"\basync\s+void\s+[A-Za-z_]\w*\s*\(", "async_void", "warning"),
    ],
    ".lua": [_PRINT, (r"\bos\.execute\s*\(", "shell_injection", "error"), (r"\bloadstring\s*\(", "dynamic_exec", "error")],
    ".sh": [(r"\beval\s+[\"']", "shell_injection", "error"), (r"\brm\s+-rf\s+/\s*(?:\*|\s|$)", "destructive", "error"), (r"\bcurl\s+[^\|]*\|\s*(?:sudo\s+)?(?:bash|sh)\b", "pipe_exec", "warning")],
    ".java": [
        (r"\bSystem\.out\.print(?:ln)?\s*\(", "debug_residue", "warning"), (r"\.printStackTrace\s*\(", "debug_residue", "warning"), (r"\bClass\.forName\s*\(", "dynamic_load", "warning"),
        (r"[A-Za-z_]\w*\s*==\s*[\"']", "string_equals", "warning"), (r"\b[A-Za-z_]\w*\s*\.equals\s*\(", "equals_npe", "warning"),
    ],
    ".kt": [_NOT_NULL, (r"\bas\s+[A-Za-z_]\w*(?:\?)?\s*(?:[;)]|$)", "unsafe_cast", "warning"), _PRINTLN],
    ".kts": [_NOT_NULL, _PRINTLN],
    ".swift": [_PRINT, (r"!\s*(?:\.|\)|\)\s*\.|\s*=|\s*\()", "force_unwrap", "warning"), (r"\bas!\s", "force_cast", "warning"), (r"\btry!\s", "force_try", "warning")],
    ".php": [(r"\becho\s+|\bprint_r\s*\(", "debug_residue", "warning"), _EVAL, (r"\bmysql_query\s*\(", "unsafe_sql", "warning"), _LOOSE, (r"\$_(?:GET|POST|REQUEST|COOKIE)\s*\[", "unsanitized_input", "warning")],
    ".rb": [(r"\bputs\s+|\bp\s+", "debug_residue", "warning"), _EVAL, (r"\bsystem\s*\(", "shell_injection", "warning")],
    ".ps1": [(r"\bWrite-Host\s+", "debug_residue", "warning"), (r"\bInvoke-Expression(?:\s*\(|\s+[$\w])", "shell_injection", "error"), (r"\bRemove-Item\s+[^\n]*\s-Recurse", "destructive", "warning")],
    ".dart": [(r"[A-Za-z_][\w.]*!(?=\s*[.;,)\]])", "nonnull_assert", "warning"), _PRINT, (r"\bdynamic\s+[A-Za-z_]\w*", "dynamic_abuse", "info"), (r"\bas\s+[A-Za-z_]\w*\s*[);]", "unsafe_cast", "warning")],
}
ALIASES = {".cc": ".cpp", ".cxx": ".cpp", ".hh": ".hpp", ".hxx": ".hpp", ".bash": ".sh", ".zsh": ".sh"}
PLACEHOLDER = r"(?i)lorem\s+ipsum|placeholder|占位|假数据|示例文案|待补充|待完善|待实现|待完成|待办|这里写|此处写|暂未实现|尚未实现|未实现|your[-_ ]?(name|email|url|project|org)|example\.(com|org)"
TODO = r"(?i)TODO\s*[:：]|FIXME\s*[:：]|XXX\s*[:：]"
UI_VALUE = (
    r"(#[0-9a-fA-F]{3,8}\b)|(rgba?\(\s*\d+)|(Color::rgb)|(Color::rgba)|(Color::hex)|(width\s*[:=]\s*\d{3,})|(height\s*[:=]\s*\d{3,})|(font_size\s*[:=]\s*\d{2,})|(padding\s*[:=]\s*\d{2,})|(margin\s*[:=]\s*\d{2,})|"
    r"(Val::Px\(\s*\d{2,})|(Color\(0x[0-9a-fA-F]{6,8}\))|(width:\s*\d{3,})|(height:\s*\d{3,})|(fontSize:\s*\d{2,})|(padding:\s*(EdgeInsets\.)?\w+)|(margin:\s*\d{2,})"
)
MAGIC_NUMBER = r"\b(?:[3-9][\d_]{2,}|[1-9][\d_]{3,})\b"
NAMED_NUMBER = r"^[A-Z][A-Z0-9_]*\s*(?::\s*[A-Za-z_][A-Za-z0-9_]*)?\s*=\s*[+-]?[0-9_]+(?:\.[0-9_]+)?\s*(?:#.*)?$"
UI_SUFFIXES = (".rs", ".ts", ".tsx", ".js", ".jsx", ".gd", ".dart")
NUMBER_SUFFIXES = (".py", ".rs", ".go", ".ts", ".tsx", ".js", ".jsx", ".gd", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".lua", ".sh", ".bash", ".java", ".kt", ".kts", ".swift", ".php", ".rb", ".ps1", ".dart")
HASH_SUFFIXES = (".py", ".gd", ".sh", ".bash", ".rb", ".ps1")
MOST_FINDINGS, SNIPPET = 50, 80

FINDING = "struct<line:int,col:int,rule:string,severity:string,snippet:string>"
_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def suffix(path: Column, aliases: bool = True) -> Column:
    """The lower-case suffix of a path, or that which it stands for."""
    own = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    if not aliases:
        return own
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), own), own)


def _u(pattern: str) -> Column:
    return F.lit("(?U)" + pattern)


def _found(i: Column, x: Column, at: Column, rule: Column, severity: Column) -> Column:
    return F.struct((i + 1).cast("int").alias("line"), at.cast("int").alias("col"), rule.alias("rule"), severity.alias("severity"), F.substring(F.trim(x), 1, SNIPPET).alias("snippet"))


def _line_rules(lines: Column, own: Column) -> Column:
    """For each line the first rule of its language that it matches."""

    def of(x: Column, i: Column) -> Column:
        choice = F.lit(None).cast(FINDING)
        for ext, rules in RULES.items():
            first = F.coalesce(*(F.when(F.rlike(x, _u(p)), _found(i, x, F.regexp_instr(x, _u(p)), F.lit(rule), F.lit(severity))) for p, rule, severity in rules))
            choice = F.when(own == ext, first).otherwise(choice)
        return choice

    return F.filter(F.transform(lines, of), lambda f: f.isNotNull())


def _tracked(lines: Column, declared: Column, used: str | list[str], rule: str) -> Column:
    """Lines that use a name of ``declared`` (name, line), other than where it is declared."""
    patterns = [used] if isinstance(used, str) else used

    def of(x: Column, i: Column) -> Column:
        names = F.concat(*(F.regexp_extract_all(x, _u(p), F.lit(1)) for p in patterns))
        first = F.filter(declared, lambda d: (d["line"] != i + 1) & F.array_contains(names, d["name"]))
        name = F.get(first, F.lit(0))["name"]
        return F.when(name.isNotNull(), _found(i, x, F.instr(x, name), F.lit(rule), F.lit("error")))

    return F.filter(F.transform(lines, of), lambda f: f.isNotNull())


def _last(events: Column) -> Column:
    """(name, line) of each name's last event, in the order of first events."""
    names = F.array_distinct(F.transform(events, lambda e: e["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(events, lambda e: e["name"] == n), -1))


def null_pointers(lines: Column) -> Column:
    """C: pointers that are set to NULL or 0 where they are declared, used elsewhere."""
    pattern = r"\b([A-Za-z_]\w*)\s*=\s*(?:NULL|0)\s*;"

    def event(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, "(?U)" + pattern, 1)
        before = F.substring(x, F.lit(1), F.regexp_instr(x, _u(pattern)) - 1)
        return F.when((name != "") & (F.contains(before, F.lit("*")) | F.contains(F.lower(name), F.lit("ptr"))), F.struct(name.alias("name"), (i + 1).alias("line")))

    declared = _last(F.filter(F.transform(lines, event), lambda e: e.isNotNull()))
    return _tracked(lines, declared, [r"(?<!\w)\*([A-Za-z_]\w*)\b", r"\b([A-Za-z_]\w*)\s*->"], "null_deref")


def nil_maps(lines: Column) -> Column:
    """Go: maps that are declared and not made, written to."""

    def events(x: Column, i: Column) -> Column:
        name, made = F.regexp_extract(x, r"(?U)\bvar\s+([A-Za-z_]\w*)\s+map\[", 1), F.regexp_extract(x, r"(?U)\b([A-Za-z_]\w*)\s*=\s*make\s*\(", 1)
        at = lambda n, open_: F.struct(n.alias("name"), (i + 1).alias("line"), F.lit(open_).alias("open"))
        return F.array_compact(F.array(F.when((name != "") & ~F.rlike(x, _u(r"\bmake\s*\(")), at(name, True)), F.when(made != "", at(made, False))))

    declared = F.filter(_last(F.flatten(F.transform(lines, events))), lambda e: e["open"])
    return _tracked(lines, F.transform(declared, lambda e: F.struct(e["name"].alias("name"), F.lit(0).alias("line"))), r"\b([A-Za-z_]\w*)\s*\[[^\]]*\]\s*=", "nil_map_write")


def _known(files: DataFrame) -> DataFrame:
    return files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.split(F.coalesce("text", F.lit("")), _LINE_ENDS).alias("lines"), suffix(F.col("path")).alias("own"), suffix(F.col("path"), False).alias("plain"))


def language_findings(files: DataFrame) -> DataFrame:
    """(file, line, col, rule, severity, snippet) of the rules by suffix, null pointers and nil maps."""
    k = _known(files).where(F.col("own").isin(*RULES))
    none = F.array().cast(f"array<{FINDING}>")
    state = F.when(F.col("own").isin(".c", ".cpp"), null_pointers(F.col("lines"))).when(F.col("own") == ".go", nil_maps(F.col("lines"))).otherwise(none)
    return k.select(F.col("path").alias("file"), F.inline(F.concat(_line_rules(F.col("lines"), F.col("own")), state)))


def scan(files: DataFrame, pack: DataFrame | None = None) -> DataFrame:
    """(file, line, rule, severity, snippet): Python by its syntax, languages with a rule table by that, and a rule pack over both."""
    python = code.findings(files.where(suffix(F.col("path")) == ".py")).select("file", "line", "rule", F.lower("severity").alias("severity"), "snippet")
    out = python.unionByName(language_findings(files).select("file", "line", "rule", "severity", "snippet"))
    if pack is not None:
        known = files.where(suffix(F.col("path")).isin(".py", *RULES))
        out = out.unionByName(first_hits(known, pack).select("file", "line", "rule", "severity", "snippet"))
    return out


def _commented(x: Column, own: Column) -> Column:
    mark = F.when(own.isin(*HASH_SUFFIXES), "#").when(own == ".lua", "--").otherwise("//")
    return F.startswith(F.ltrim(F.regexp_replace(x, r"^[\t\x0B\x0C]+", "")), mark)


def text_rules(files: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """(file, line, rule, what): placeholders outside comments, values that are written into user interfaces, and numbers without a name; ``most`` of each rule and file, in order."""
    k = _known(files)
    lines, own = F.col("lines"), F.col("plain")
    hit = lambda i, rule, what: F.struct((i + 1).cast("int").alias("line"), F.lit(rule).alias("rule"), what.alias("what"))

    def of(x: Column, i: Column) -> Column:
        none = F.array().cast("array<struct<line:int,rule:string,what:string>>")
        every = lambda p, rule: F.transform(F.regexp_extract_all(x, _u(p), F.lit(0)), lambda w: hit(i, rule, w))
        text = F.when(~_commented(x, own), every(PLACEHOLDER, "text_placeholder")).otherwise(none)
        values = F.when(own.isin(*UI_SUFFIXES), every(UI_VALUE, "ui_hardcode")).otherwise(none)
        named = F.rlike(F.ltrim(x), F.lit(NAMED_NUMBER)) | F.rlike(F.ltrim(x), F.lit("^(import |from |__version__|VERSION)")) | F.rlike(x, F.lit("Val::(Px|Percent|Vw|Vh)"))
        numbers = F.when(own.isin(*NUMBER_SUFFIXES) & ~_commented(x, own) & ~named, F.slice(every(MAGIC_NUMBER, "magic_number"), 1, 1)).otherwise(none)
        return F.concat(text, values, numbers)

    rows = k.select(F.col("path").alias("file"), F.posexplode(F.flatten(F.transform(lines, of))).alias("at", "f")).select("file", "at", "f.*")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("file", "rule").orderBy("at"))).where(F.col("k") <= most).select("file", "line", "rule", "what")


def todo_counts(files: DataFrame) -> DataFrame:
    """(file, n): marks of work to do, which are counted and no findings."""
    return files.select(F.col("path").alias("file"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), _u(TODO), F.lit(0))).cast("long").alias("n"))


def code_only(text: Column, own: Column) -> Column:
    """The text with comments and what stands in strings replaced by spaces; lines and places stay. Null for suffixes without a known way of comments."""
    strings = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
    kinds = [
        (own.isin(*HASH_SUFFIXES), r'(?s)"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''|" + strings + r"|#[^\n]*|[^\"'#]+|."),
        (own == ".lua", r"(?s)--\[\[.*?\]\]|" + strings + r"|--[^\n]*|[^\"'-]+|."),
        (own.isin(*RULES, ".rs"), r"(?s)/\*.*?\*/|" + strings + r"|`(?:\\.|[^`\\])*`|//[^\n]*|[^\"'`/]+|."),
    ]
    blank = lambda t: F.regexp_replace(t, r"[^\n\r]", " ")
    string = lambda t: F.concat(F.substring(t, 1, 1), blank(F.substring(t, F.lit(2), F.length(t) - 2)), F.substring(t, -1, 1))
    one = lambda t: F.when(F.rlike(t, F.lit(r"(?s)^(//|/\*.*\*/$|#|--)")) & (F.length(t) > 1), blank(t)).when(F.rlike(t, F.lit(r"(?s)^([\"'`]).*\1$")) & (F.length(t) > 1), string(t)).otherwise(t)
    out = F.lit(None).cast("string")
    for when, pattern in reversed(kinds):
        out = F.when(when, F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one))).otherwise(out)
    return out
