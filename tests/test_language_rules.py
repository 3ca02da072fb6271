"""Rules by suffix against plain loops, states of pointers and maps, and text without comments and strings."""

import random
import re

import pytest

from pyspark.sql import functions as F

from weftwork.operators import language_rules as L


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_every_rule_finds_what_a_plain_loop_finds(spark):
    rng = random.Random(2)
    pieces = [
        "fmt.Print(", "panic (", "go f(", "recover() x", "a, _ := f(", "console.log(", "any)", "eval(", "a == b", "a === b", "setTimeout('", "dangerouslySetInnerHTML", ".innerHTML =", "var x", "parseInt(x)", "print(", "get_node(a).", "free(", "printf(",
        "goto e;", "strcat(", "gets(", "x = realloc(", "std::cout <<", "Console.WriteLine(", "(int) x", "async void F(", "os.execute(", "loadstring(", "eval '", "rm -rf / ", "curl a | sh", "System.out.println(", ".printStackTrace(", "s == 'a'", "s.equals(",
        "x!!", "as T)", "println(", "x!.y", "as! T", "try! f", "echo 1", "$_POST[", "puts 1", "p x", "system(", "Write-Host x", "Invoke-Expression $x", "Remove-Item a -Recurse", "dynamic x", "as Y;", "é中", "",
    ]
    files = {f"d.x/f{k}{rng.choice([*L.RULES, *L.ALIASES, '.txt', '', '.GO'])}": rng.choice(["\n", "\r\n"]).join(" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 2))) for _ in range(12)) for k in range(150)}
    found = {(r.file, r.line): (r.col, r.rule, r.severity) for r in L.language_findings(frame(spark, files)).where("rule NOT IN ('null_deref', 'nil_map_write')").collect()}
    want = {}
    for path, text in files.items():
        own = re.search(r"(\.[^./]*)?$", path)[0].lower()
        for i, line in enumerate(text.splitlines(), 1):
            for p, rule, severity in L.RULES.get(L.ALIASES.get(own, own), ()):
                if m := re.search(p, line):
                    want[path, i] = (m.start() + 1, rule, severity)
                    break
    assert found == want and len({r for _, r, _ in want.values()}) > 25


def test_null_pointers_and_nil_maps(spark):
    files = {
        "a.c": "int *p = NULL;\nint x = 0;\nint *p = 0; *p = 1;\n*p = 2; q->x;\nx->y; mul = 2*p;\nptrs = 0;\nptrs->a; p->b;",
        "b.go": "var m map[string]int\nm[\"a\"] = 1\nvar n map[int]int\nn = make(map[int]int)\nn[1] = 2\nvar n map[int]int\nvar o map[int]int = make(map[int]int)\no[1] = 1\nmm[1] = 2\nm[2] == 3",
        "c.cc": "T* t = NULL;\nuse(t);\nt ->go();",
        "d.js": "int *p = NULL;\n*p = 1;",
        "e.c": None,
    }
    got = {(r.file, r.line, r.col, r.rule) for r in L.language_findings(frame(spark, files)).where("rule IN ('null_deref', 'nil_map_write')").collect()}
    assert got == {("a.c", 4, 2, "null_deref"), ("a.c", 1, 6, "null_deref"), ("a.c", 7, 1, "null_deref"), ("b.go", 2, 1, "nil_map_write"), ("b.go", 5, 1, "nil_map_write"), ("b.go", 10, 1, "nil_map_write"), ("c.cc", 3, 1, "null_deref")}


@pytest.mark.parametrize(
    ("suffix", "marked"),
    [
        (".go", 'a «/* eval(\n b */» "«eval(»" «// x»\nc'), (".js", "x = '«it\\'s»' + `«a\nb»`; y"), (".py", "a = '«#x»' «# c»\n'«''d\ne''»' + f"), (".lua", 'a «-- "x»\nb = "«--»" «--[[ c\nd ]]» e - f'),
        (".c", "char q = '«\"»'; f(\"«//»\", 2 / 3)"), (".c", 'open "string\nnext /* never closed'), (".rb", "x = \"«a\\\"#b»\" «# 'c»\n'd"), (".txt", None),
    ],
)
def test_code_without_comments_and_strings(spark, suffix, marked):
    """What stands between « and » is to be blank, line ends but for."""
    text = (marked or "// x").translate({ord("«"): None, ord("»"): None})
    want = marked and re.sub("«(.*?)»", lambda m: re.sub(r"[^\n]", " ", m[1]), marked, flags=re.S)
    d = spark.createDataFrame([(text, suffix)], "t string, s string")
    assert d.select(L.code_only(F.col("t"), F.col("s")).alias("x")).first().x == want


def test_findings_of_a_rule_and_file_are_capped_in_order(spark):
    files = {"a.py": "x = 1234\n" * 70, "b.rs": "Val::Px(20)\nwidth: 500 height: 600\n// placeholder\n"}
    rows = L.text_rules(frame(spark, files)).collect()
    assert sorted(r.line for r in rows if r.file == "a.py") == list(range(1, 51))
    assert {(r.line, r.rule, r.what) for r in rows if r.file == "b.rs"} == {(1, "ui_hardcode", "Val::Px(20"), (2, "ui_hardcode", "width: 500"), (2, "ui_hardcode", "height: 600"), (2, "magic_number", "500")}
