"""The rule pack on files of five suffixes, and the screen on patterns made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import rule_pack as P
from weftwork.plans.registry import query, table
from weftwork.plans.slots import expected, slot_files, slot_keys

_LINES = {
    "py": [
        ["cursor.execute('SELECT * FROM t WHERE id=' + u)", "cursor.execute('SELECT * FROM t WHERE id=%s', (u,))"], ["urlopen(url)", "urlopen('http://x')", "urlopen( target )"], ["z = zipfile.ZipFile(f)", "z = ZipFiles(f)"],
        ["logging.info(f'x {y}')", "logging.info('x')", "log('{x}')"], ["tree = ET.parse(f)", "tree = parse(f)", "tree = etree . parse(f)"], ["subprocess.getoutput(c)", "os.popen (c)", "open(c)"],
        ["pickle.loads(data)", "pickle.loads(b'x')", "pickle.loads( 'x')", "pickle.load(f)"], "pickle.loads(again)",
    ],
    "js": [["a.__proto__ = b", "Foo.prototype = {}", "Foo.prototype.x"], ["db.query(`SELECT ${x}`)", "db.query('SELECT 1')"], ["eval(x)", "eval('1')", "evaluate(x)", "medieval (x)"], ["e.innerHTML = value;", "e.innerHTML = '<b>';"]],
    "php": [["include($f);", "require 'x.php';", "require $f;"], "urlopen(url)"],
    "go": [["go func() { m[k] = 1 }", "m[k] = 1"], ["http.Get(url)", 'http.Get("x")']],
    "rb": ["urlopen(url)", "pickle.loads(data)"],
}
_EXPECTED = [
    ("py", "q % 2 = 0", 1, "sql_injection", "warning"), ("py", "q % 3 <> 1", 2, "ssrf_open_url", "warning"), ("py", "q % 2 = 0", 3, "zip_slip", "info"), ("py", "q % 3 = 0", 4, "log_injection", "info"),
    ("py", "q % 3 <> 1", 5, "xxe_unsafe", "info"), ("py", "q % 3 <> 2", 6, "command_var_subprocess", "warning"), ("py", "q % 2 = 0", 7, "py_pickle_untrusted", "error"), ("py", "q % 2 = 1", 8, "py_pickle_untrusted", "error"),
    ("js", "q % 3 <> 2", 1, "proto_pollution", "warning"), ("js", "q % 2 = 0", 2, "sql_injection_js", "warning"), ("js", "q % 4 = 0", 3, "js_dynamic_eval", "error"), ("js", "q % 2 = 0", 4, "js_innerhtml_untrusted", "warning"),
    ("php", "q % 3 <> 1", 1, "php_file_include", "warning"), ("go", "q % 2 = 0", 1, "go_race_shared", "info"), ("go", "q % 2 = 0", 2, "go_http_var_url", "warning"),
]


@query("rule_pack_hits", f"WITH {slot_keys(_LINES)} {expected(_EXPECTED)}")
def rule_pack_hits(spark, sf_dir):
    return P.first_hits(slot_files(spark, sf_dir, _LINES), P.pack(spark)).select("file", "line", "rule", "severity")


#: Patterns around a part's number, and why they are refused.
_PATTERNS = [
    ("(a+)+%d", "nested quantifier"), ("(a|aa)+$%d", "alternatives under a quantifier"), ("(a{2,3})+%d", "nested quantifier"), ("x{2}{%d}", "quantified quantifier"), ("((ab))*%d", "group in a quantified group"), ("ok[(+*)]+%d", None),
    (r"\(a+\)+%d", None), ("(?:ab)+%d", None), ("(open%d", "not a pattern"), ("a(b|c)?%d", None), ("(a|b){2,}%d", "alternatives under a quantifier"), (r"(\(a*)+%d", "nested quantifier"), ("[a%d", "not a pattern"), ("y" * 200 + "%d", "too long"),
]
_REASONS = ", ".join("NULL" if r is None else f"'{r}'" for _, r in _PATTERNS)


@query("rule_pack_screen", f"SELECT 'r' || p_partkey AS id, ([{_REASONS}])[1 + p_partkey % {len(_PATTERNS)}] AS reason FROM part")
def rule_pack_screen(spark, sf_dir):
    k = F.col("p_partkey")
    made = F.element_at(F.array(*(F.replace(F.lit(p), F.lit("%d"), k.cast("string")) for p, _ in _PATTERNS)), (k % len(_PATTERNS) + 1).cast("int"))
    return P.screened(table(spark, sf_dir, "part").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), made.alias("pattern"))).select("id", "reason")
