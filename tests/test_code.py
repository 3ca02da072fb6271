"""Taint across calls, detectors of careless code, line diffs and rule packs: fixtures, properties and plain loops."""

import difflib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weftwork.operators import code_quality, line_diff, rule_pack, taint


def frame(spark, files):
    return spark.createDataFrame([(p, t) for p, t in files.items()], "path string, text string")


# --- taint


def flows_of(spark, files, **kw):
    return {(r.file, r.fn, r.line, r.sink): r.depth for r in taint.taint_findings(frame(spark, files), **kw).collect()}


def test_taint_goes_through_three_files_and_a_ring(spark):
    files = {
        "a.py": "def handler(args):\n    path = args.get('file')\n    return middle(1, path)\n",
        "b.py": "def middle(n, p):\n    moved = p\n    middle(n, 'x' + moved)\n    return deep(where=moved)\n",
        "c.py": "def deep(what=None, where=None):\n    again = f'{where}.txt'\n    ring(again)\n    open(what)\n    return open(again)\n\ndef ring(x):\n    deep(x)\n    log(x)\n",
        "d.py": "def bystander(p):\n    return open(p)\n\ndef fixed():\n    p = 'x'\n    return deep2(p)\n",
    }
    assert flows_of(spark, files) == {("c.py", "deep", 5, "open"): 2, ("c.py", "deep", 4, "open"): 4}


def test_taint_within_a_function_and_without_a_source(spark):
    files = {"a.py": "import os\ndef h(args):\n    c = args.get('cmd')\n    os.system(c)\n    d = 1\n    eval(d)\n", "b.py": "def sink(p):\n    return open(p)\ndef caller(q):\n    return sink(q)\n", "broken.py": "def (", "empty.py": None}
    assert flows_of(spark, files) == {("a.py", "h", 4, "system"): 0}
    # where parameters are not trusted, a function that passes its own on is enough
    assert flows_of(spark, files, trust_parameters=False) == {("a.py", "h", 4, "system"): 0, ("b.py", "sink", 2, "open"): 1}


def test_a_name_is_resolved_in_its_own_file_first(spark):
    files = {
        "z.py": "def run(p):\n    return open(p)\ndef h():\n    p = input()\n    return run(p)\n",
        "a.py": "def run(p):\n    return eval(p)\n",
        "m.py": "def h():\n    p = input()\n    run(p, p)\n    obj.run(p)\n    deep.er.run(p)\n",
    }
    assert flows_of(spark, files) == {("z.py", "run", 2, "open"): 1, ("a.py", "run", 2, "eval"): 1}


def test_the_first_definition_counts_and_long_chains_end(spark):
    n = 25
    text = "".join(f"def f{k}(p):\n    return f{k + 1}(p)\n" for k in range(n)) + f"def f{n}(p):\n    open(p)\ndef f{n}(p):\n    pass\ndef go():\n    x = input()\n    f0(x)\n"
    assert flows_of(spark, {"a.py": text}) == {("a.py", f"f{n}", 2 * n + 2, "open"): n + 1}


# --- careless code


def quality(spark, files):
    return {(r.file, r.line, r.rule, r.severity, r.subject) for r in code_quality.code_quality(frame(spark, files)).collect()}


def test_python_detectors(spark):
    text = "\n".join([
        "from __future__ import annotations", "import os.path as p, sys", "class Base:", "    @abstractmethod", "    def hook(self): pass", "    def _private_(self): return {}", '    def later(self):', '        """由子类 provides."""',
        "        return None", "async def fetch(): return []", "def run():", "    try:", "        go()", "    except ValueError:", "        # known", "        pass", "    try:", "        go()", "    except (A, B):", "        log.warning('x')",
        "    try: go()", "    finally: stop()", "    return run, sys",
    ])
    # the comment stands within the handler's lines, so its pass is meant
    assert quality(spark, {"src/mod.py": text}) == {
        ("src/mod.py", 1, "DEAD-001", "Critical", "annotations"), ("src/mod.py", 2, "DEAD-001", "Critical", "p"), ("src/mod.py", 5, "DEAD-001", "Warning", "hook"), ("src/mod.py", 7, "DEAD-001", "Warning", "later"),
        ("src/mod.py", 10, "DEAD-001", "Warning", "fetch"), ("src/mod.py", 6, "DEAD-003", "Blocker", "_private_"), ("src/mod.py", 12, "DEAD-007", "Warning", "try"), ("src/mod.py", 19, "DEAD-008", "Critical", "warning"),
    }


def test_tests_may_have_empty_functions_and_broken_python_is_read_by_lines(spark):
    assert {x[2] for x in quality(spark, {"test_a.py": "def helper(): pass\nhelper()\n"})} == set()
    assert quality(spark, {"b.py": "def (:\n    x = 'TODO 假数据'\n# 假数据\n"}) == {("b.py", 2, "DEAD-002", "Critical", "TODO"), ("b.py", 2, "DEAD-002", "Critical", "假数据"), ("b.py", 2, "DEAD-003", "Blocker", "假数据"), ("b.py", 3, "DEAD-002", "Critical", "假数据")}


def test_other_languages_line_ends_and_unknown_suffixes(spark):
    files = {
        "a.go": 'import (\r\n  "a/yaml.v2"\r\n  "b/io"\r\n)\r\nyaml.v2.Load(io_x)\r\n', "b.rs": "use a::{B};\nuse c::D;\nuse e::F as F;\nlet x: F = 1;", "c.JS": "import { a as b, c } from 'x'\nc(1)\ncatch (e) {\n  console.log(e)\n}",
        "d.txt": "TODO", "e.h": None, "f.cc": "try\ntry\n\ntry\ncatch\nif a == 1\nif b == 1", "g.ts": "const databar = '// return'; // return\nlet foo_ = bar;",
    }
    assert quality(spark, files) == {
        ("a.go", 3, "DEAD-001", "Critical", "b/io"), ("b.rs", 2, "DEAD-001", "Critical", "c::D"), ("c.JS", 1, "DEAD-001", "Critical", "b"), ("c.JS", 4, "DEAD-008", "Critical", "catch and print"), ("g.ts", 2, "DEAD-005", "Warning", "bar"),
    }


def test_the_report_weighs_findings(spark):
    files = frame(spark, {"a/x.py": "import os\n", "a/y.c": "int foo;\n", "b/z.c": "f() {}\n" * 5, "c/n.txt": "TODO"})
    got = {r.part: (r.files, r.findings, r.blocker, r.critical, r.warning, r.score, r.passed) for r in code_quality.quality_report(files, code_quality.code_quality(files), F.split_part(F.col("path"), F.lit("/"), F.lit(1))).collect()}
    assert got == {"a": (2, 2, 0, 1, 1, 20, False), "b": (1, 5, 5, 0, 0, 100, False)}


# --- line diff


def rebuild(old, new, ops):
    return [x for tag, i1, i2, j1, j2 in ops for x in (old[i1:i2] if tag == "equal" else new[j1:j2])]


def well_formed(old, new, ops):
    at = (0, 0)
    for k, (tag, i1, i2, j1, j2) in enumerate(ops):
        assert (i1, j1) == at and (i2 > i1, j2 > j1) == {"equal": (True, True), "replace": (True, True), "delete": (True, False), "insert": (False, True)}[tag]
        assert not k or (tag == "equal") != (ops[k - 1][0] == "equal")
        assert tag != "equal" or old[i1:i2] == new[j1:j2]
        at = (i2, j2)
    return at == (len(old), len(new))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcde"), max_size=30))
def test_opcodes_rebuild_the_new_text(old, new):
    ops = line_diff.opcodes(old, new)
    assert well_formed(old, new, ops) and rebuild(old, new, ops) == new


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(25)), st.integers(0, 25), st.integers(0, 25), st.integers(0, 25))
def test_opcodes_of_unique_lines_with_edits_are_difflibs(lines, cut, put, size):
    old = [str(x) for x in lines]
    new = [x for k, x in enumerate(old) if not cut <= k < cut + size % 5]
    new[put:put] = [f"new {k}" for k in range(size % 3)]
    assert line_diff.opcodes(old, new) == difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()


def test_lines_that_repeat_very_often_cost_no_square(monkeypatch):
    monkeypatch.setattr(line_diff, "MOST_MATCHES", 1000)
    old, new = ["{", "}"] * 3000 + ["x"], ["y", "}"] + ["{", "}"] * 2500 + ["{"]
    ops = line_diff.opcodes(old, new)
    assert well_formed(old, new, ops) and rebuild(old, new, ops) == new
    assert sum(i2 - i1 for tag, i1, i2, _, _ in ops if tag == "equal") > 4000


def test_what_follows_from_the_opcodes(spark):
    pairs = [("a\nb\nc\n", "a\nX\nc\nd"), (None, "a\r\nb"), ("a\nb", ""), ("same\n", "same"), ("gone\nkept", "kept")]
    d = spark.createDataFrame([(k, *p, "t") for k, p in enumerate(pairs)], "k int, before string, after string, ops string").drop("ops")
    ops, old, new = F.col("ops"), F.col("old"), F.col("new")
    out = line_diff.line_diff(d, "before", "after").select("k", line_diff.added(ops).alias("added"), line_diff.removed(ops, old).alias("removed"), line_diff.previews(ops, old, new).alias("previews"), line_diff.rebuilt(ops, old, new).alias("rebuilt"), "new")
    got = {r.k: r for r in out.collect()}
    assert all(r.rebuilt == r.new for r in got.values())
    for k, (a, b) in enumerate(pairs):
        x, y = (a or "").splitlines(), (b or "").splitlines()
        want = [o for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
        assert got[k].added == [n for _, _, _, j1, j2 in want for n in range(j1 + 1, j2 + 1)]
        assert [tuple(r) for r in got[k].removed] == [(j1, x[i]) for _, i1, i2, j1, _ in want for i in range(i1, i2)]
        assert [tuple(p) for p in got[k].previews] == [(max(1, j1 + 1 if j2 > j1 else j1), x[i1:i2][:3], y[j1:j2][:3]) for _, i1, i2, j1, j2 in want]


# --- rule packs


@pytest.mark.parametrize(
    ("pattern", "reason"),
    [
        ("(a+)+", "nested quantifier"), ("(a|aa)+$", "alternatives under a quantifier"), ("(a{1,3}){2,}$", "nested quantifier"), ("((ab))+", "group in a quantified group"), ("a{2}{3}", "quantified quantifier"), ("(a?)*", "nested quantifier"),
        (r"\(a+\)+", None), ("[(a+)]+", None), ("(ab)+", None), ("(a+)b", None), ("(a+)?", None), ("a{,3}", None), ("a{x}", None), ("(?i)abc", None), (r"(?:a|b)c", None), (r"(?=a+)b", None), ("(", "not a pattern"), ("a)", "not a pattern"), ("[", "not a pattern"),
        ("a" * 200, None), ("a" * 201, "too long"), ("\\", "not a pattern"), ("(?P<n>x(y|z))*", "alternatives under a quantifier"),
    ],
)
def test_the_screen(pattern, reason):
    assert rule_pack.screen(pattern) == reason


def test_the_packs_own_rules_pass_the_screen():
    assert all(rule_pack.screen(p) is None for _, p, *_ in rule_pack.PACK)
    assert all(rule_pack.required(p) != [""] for _, p, *_ in rule_pack.PACK)


@pytest.mark.parametrize(("pattern", "literals"), [("abc+d", ["abc"]), ("ab?c", ["a"]), (r"x\.y|zz", ["x.y", "zz"]), ("(foo|ba)r", ["ba", "foo"]), ("a*", [""]), ("(?i)abc", [""]), (r"\d+", [""]), ("(?!ab)cd", ["cd"]), ("(ab)*c", ["c"]), ("a|b*", [""])])
def test_required_literals(pattern, literals):
    assert rule_pack.required(pattern) == literals


def test_every_match_holds_a_required_literal():
    rng = random.Random(4)
    atoms = ["a", "b", "ab", ".", "[ab]", "(a|b)", "(ab|c)", "(?:bc)", r"\w", "(a(b|c))", "c"]
    for _ in range(3000):
        p = "|".join("".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([1, 1, 2])))
        if rule_pack.screen(p) is not None:
            continue
        for _ in range(20):
            s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
            if re.search(p, s):
                assert any(w in s for w in rule_pack.required(p)), (p, s)


def test_first_hits_are_those_of_plain_loops(spark):
    rules = [*rule_pack.PACK, ("any", "TODO|FIX(ME)?", None, None, "m" * 200), ("bad", "(a+)+", ".py", "error", ""), (None, "x", "all", "error", ""), ("lone", "^\\s+$", "all", "info", "blank"), ("long" * 20, "zip", ".PY", "info", "")]
    rng = random.Random(8)
    pieces = ["pickle.loads(x)", "z = zipfile.open", "FIX", "http.Get(u)", "include $x", "   ", "e.innerHTML = a", "eval (q)", "prototype = 1", "# TODO eval('x')", ""]
    files = {f"f{k}{rng.choice(['.py', '.js', '.go', '.php', '', '.Py'])}": rng.choice(["\n", "\r\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for k in range(60)} | {"null.py": None}
    got = {(r.file, r.rule): (r.line, r.severity, r.snippet) for r in rule_pack.first_hits(frame(spark, files), rule_pack.pack(spark, rules)).collect()}
    want = {}
    for path, text in files.items():
        suffix = re.search(r"(\.[^./]*)?$", path)[0].lower()
        for i, p, lang, sev, *_ in rules:
            if i is None or rule_pack.screen(p):
                continue
            for n, line in enumerate(re.split(r"\r\n|\n", text or ""), 1):
                if (lang or "all") in ("all", suffix) and re.search(p, line):
                    want[path, i[:40]] = (n, sev or "warning", line.strip(" ")[:80])
                    break
    assert got == want
    refused = {r.id: r.reason for r in rule_pack.screened(rule_pack.pack(spark, rules)).where("reason IS NOT NULL").collect()}
    assert refused == {"bad": "nested quantifier", None: "no id or pattern"}
    assert rule_pack.first_hits(frame(spark, files), rule_pack.pack(spark, rules).where("id = 'bad'")).count() == 0
