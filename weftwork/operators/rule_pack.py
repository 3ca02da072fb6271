"""Rule packs: patterns as rows, screened before use, matched only where a literal that they need stands.

A pattern is read into a small tree of alternatives, sequences and quantifiers. The tree tells which patterns
may take exponential time (a quantifier over a group that has alternatives, quantifiers or a group of
its own), and a set of literals of which every match holds at least one. Lines are exploded once; a line meets
the rules whose literal it holds through an equality join with the pack's index, and only those are tried.

files: (path, text). rules: (id, pattern, language, severity, msg); language is a suffix with its dot, or ``all``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST_PATTERN, LONGEST_ID, LONGEST_MSG, SNIPPET = 200, 40, 120, 80
#: Rules of a pack that are broadcast; a larger pack is refused.
MOST_RULES = 10_000

# The rules of the pack that comes with the engine (id, pattern, language, severity).
PACK = [
    ("sql_injection", r"""(execute|executemany|query)\s*\(\s*f?["']?.*(SELECT|INSERT|UPDATE|DELETE).*\+""", ".py", "warning"),
    ("ssrf_open_url", r"urlopen\s*\(\s*[a-z_]", ".py", "warning"),
    ("zip_slip", r"ZipFile\s*\(|zipfile\.", ".py", "info"),
    ("proto_pollution", r"__proto__|prototype\s*=", ".js", "warning"),
    ("log_injection", r"""logging\..*\(f?["'].*\{.*\}""", ".py", "info"),
    ("sql_injection_js", r"""(execute|query)\s*\(\s*[`"'].*(SELECT|INSERT|UPDATE|DELETE).*\$\{""", ".js", "warning"),
    ("xxe_unsafe", r"(ElementTree|ET)\.(parse|fromstring)|etree\s*\.\s*parse|XMLParser\s*\(", ".py", "info"),
    ("command_var_subprocess", r"(getoutput|popen)\s*\(", ".py", "warning"),
    ("php_file_include", r"(include|require)\s*\(?\s*\$", ".php", "warning"),
    ("go_race_shared", r"go\s+func[^{]*\{[^}]*\[[^]]*\]\s*=", ".go", "info"),
    ("js_dynamic_eval", r"""\beval\s*\(\s*(?!['"`])""", ".js", "error"),
    ("py_pickle_untrusted", r"""pickle\.loads\s*\(\s*(?!b?['"])""", ".py", "error"),
    ("go_http_var_url", r"http\.(Get|Post|Do)\s*\(\s*[a-zA-Z_]", ".go", "warning"),
    ("js_innerhtml_untrusted", r"\.innerHTML\s*=\s*[a-zA-Z_]", ".js", "warning"),
]


@dataclass
class Item:
    """A literal character, a group of alternatives (each a list of items), or anything else; and how often it stands."""

    char: str | None = None
    group: list[list[Item]] | None = None
    least: int = 1
    many: bool = False
    quantified: bool = False
    look: bool = False


class _Unreadable(ValueError):
    pass


_QUANTIFIER = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})([?+]?)")


def _alternatives(p: str, at: int) -> tuple[list[list[Item]], int]:
    """Alternatives from a place of the pattern to the bracket that ends them, or its end."""
    out: list[list[Item]] = [[]]
    while at < len(p) and p[at] != ")":
        c = p[at]
        if c == "|":
            out.append([])
            at += 1
            continue
        if c == "(":
            head = re.compile(r"\((\?(?:P?<\w+>|[:>]|<?[=!]|[aiLmsux-]*[:)]))?").match(p, at)
            at = head.end()
            if (head[1] or "").endswith(")"):  # flags alone
                continue
            inner, at = _alternatives(p, at)
            if at >= len(p):
                raise _Unreadable("open group")
            at += 1
            item = Item(group=inner, look=bool(re.fullmatch(r"\?<?[=!]", head[1] or "")))
        elif c == "[":
            end = re.compile(r"\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]", re.S).match(p, at)
            if not end:
                raise _Unreadable("open set")
            item, at = Item(), end.end()
        elif c == "\\":
            if at + 1 >= len(p):
                raise _Unreadable("open escape")
            item, at = Item(char=None if p[at + 1].isalnum() else p[at + 1]), at + 2
        else:
            item, at = Item(char=None if c in ".^$" else c), at + 1
        q = _QUANTIFIER.match(p, at)
        if q and (q[1][0] != "{" or q[2] or q[4]):
            at = q.end()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(q[1], (int(q[2] or 0), (int(q[4]) if q[4] else None) if q[3] else int(q[2] or 0)))
            item.least, item.many, item.quantified = least, most is None or most > 1 or q[1][0] == "{", True
            again = _QUANTIFIER.match(p, at)
            if again and (again[1][0] != "{" or again[2] or again[4]):
                raise _Unreadable("quantified quantifier")
        out[-1].append(item)
    return out, at


def parse(pattern: str) -> list[list[Item]]:
    out, at = _alternatives(pattern, 0)
    if at < len(pattern):
        raise _Unreadable("bracket too many")
    return out


def _items(alternatives: list[list[Item]]) -> Iterator[Item]:
    for sequence in alternatives:
        for item in sequence:
            yield item
            if item.group is not None:
                yield from _items(item.group)


def screen(pattern: str) -> str | None:
    """Why a pattern is refused; None if it may be used."""
    if len(pattern) > LONGEST_PATTERN:
        return "too long"
    try:
        tree = parse(pattern)
        for item in _items(tree):
            if item.group is not None and item.many:
                inner = list(_items(item.group))
                if any(x.quantified for x in inner):
                    return "nested quantifier"
                if len(item.group) > 1 or any(x.group is not None and len(x.group) > 1 for x in inner):
                    return "alternatives under a quantifier"
                if any(x.group is not None for x in inner):
                    return "group in a quantified group"
        re.compile(pattern)
    except _Unreadable as e:
        return "quantified quantifier" if str(e) == "quantified quantifier" else "not a pattern"
    except (re.error, OverflowError, RecursionError):
        return "not a pattern"
    return None


def required(pattern: str) -> list[str]:
    """Literals of which every match holds at least one; ``[""]`` if none can be told."""
    found = None if re.search(r"\(\?[aLmsux-]*i", pattern) else _needed(parse(pattern))
    return sorted(found) if found else [""]


def _needed(alternatives: list[list[Item]]) -> set[str] | None:
    out: set[str] = set()
    for sequence in alternatives:
        choices: list[set[str]] = []
        run = ""
        for item in [*sequence, None]:
            if item is not None and item.char is not None and not item.quantified:
                run += item.char
                continue
            if item is not None and item.char is not None and item.least and not item.look:
                run += item.char  # it stands once at least, but what follows need not follow it at once
            if run:
                choices.append({run})
            run = ""
            if item is not None and item.group is not None and item.least and not item.look and (inner := _needed(item.group)):
                choices.append(inner)
        if not choices:
            return None
        out |= max(choices, key=lambda s: (min(map(len, s)), -len(s)))
    return out


def screened(rules: DataFrame) -> DataFrame:
    """The rules with ``reason`` (null: may be used) and ``literals``; ids and messages are cut to their length, a rule without id or pattern is refused."""
    names = rules.columns
    extra = {"language": F.lit("all"), "severity": F.lit("warning"), "msg": F.lit("")}
    r = rules.select(
        F.substring("id", 1, LONGEST_ID).alias("id"), "pattern", *(F.coalesce(F.col(c), d).alias(c) if c in names else d.alias(c) for c, d in extra.items())
    ).withColumn("msg", F.substring("msg", 1, LONGEST_MSG))

    def run(frames):
        for f in frames:
            why = [("no id or pattern" if not i or not p else screen(p)) for i, p in zip(f["id"], f["pattern"], strict=True)]
            f["reason"] = why
            f["literals"] = [required(p) if w is None else [] for p, w in zip(f["pattern"], why, strict=True)]
            yield f

    return r.mapInPandas(run, "id string, pattern string, language string, severity string, msg string, reason string, literals array<string>")


def pack(spark: SparkSession, rows: list[tuple] = PACK) -> DataFrame:
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], "id string, pattern string, language string, severity string, msg string")


def first_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, line, rule, severity, msg, snippet): the first line of each file that each usable rule of its language matches."""
    usable = screened(rules).where("reason IS NULL").select("id", "pattern", "language", "severity", "msg", "literals").limit(MOST_RULES + 1).collect()
    spark = files.sparkSession
    if len(usable) > MOST_RULES:
        raise ValueError(f"a pack of more than {MOST_RULES} rules")
    literals = sorted({w for r in usable for w in r.literals})
    if not usable:
        return spark.createDataFrame([], "file string, line int, rule string, severity string, msg string, snippet string")
    index = F.broadcast(spark.createDataFrame([(w, r.id, r.pattern, r.language, r.severity, r.msg) for r in usable for w in r.literals], "literal string, id string, pattern string, language string, severity string, msg string"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    lines = files.select(F.col("path").alias("file"), suffix.alias("suffix"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]")).alias("line", "x"))
    held = F.filter(F.array(*map(F.lit, literals)), lambda w: F.contains(F.col("x"), w))
    tried = lines.select("*", F.explode(held).alias("literal")).join(index, "literal").where((F.col("language") == "all") | (F.col("language") == F.col("suffix")))
    hits = tried.where(F.rlike("x", F.col("pattern")))
    first = hits.groupBy("file", F.col("id").alias("rule")).agg(F.min(F.struct((F.col("line") + 1).alias("line"), F.substring(F.trim("x"), 1, SNIPPET).alias("snippet"), "severity", "msg")).alias("f"))
    return first.select("file", "f.line", "rule", "f.severity", "f.msg", "f.snippet")
