"""Detectors of careless code, on files written from parts: five languages by number, each line one of a few by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import code_quality as Q
from weftwork.plans.registry import query
from weftwork.plans.slots import expected, slot_files, slot_keys

#: Lines of each language; of a list, file k has the line (k div 5) mod its length.
_LINES = {
    "py": [
        ["import os", "import json as js"], "from re import compile as pattern", "", "class Tools:", "    @staticmethod", "    def first(value):", "        return value + 1",
        ["    @staticmethod", "    # plain", "    # plain"], "    def second(self):", ["        return self.total", "        return None"], "", "def load_rows(path):",
        ["    rows = [path]", '    """TODO: 模拟数据"""', "    # 假数据 in a comment", "    rows = '假数据'"], "    try:", "        rows = open(path)", "    except OSError:",
        ["        pass", "        pass  # best effort", "        print(path)"], ["    data1, temp = 1, 'data2 foo temp'", "    metadata1, temporary = 1, 2"],
        ["    rows.push(1)", "    rows.length()", "    rows.append(1)", "    rows.append(2)", "    len(rows)"], ["    return os.js(js)", "    return rows", "    return rows"],
        ["load_rows(pattern)", "load_rows(1)", "load_rows(1)", "print(1)"], ["", "def make_a(): return Box(1)", ""], ["", "def build_b(): return Box(2)", ""], ["", "def create_c(): return Box(3)", ""],
    ],
    "go": ["import (", '    "net/http"', '    "fmt"', ")", ["    fmt.Println(1)", "    http.Get(1)"], ["strings.ContainsAny(a)", "strings.ContainsAny(a, b)", "strings.Contains(a)"]],
    "rs": ["use std::fs;", ["use std::io::{Read};", "use std::io::Read;"], "fn a() {}", ["    fs::read(1);", "    other(1);", "    other(2);"], "fn b() { return None; }"],
    "ts": [
        "import { one, two as three } from 'm';", ["const x = one(1);", "const x = three;"], ["try { go(); } catch (e) {}", "try { go(); } catch (e) {", "if (x == 1) go();"],
        ["let y = {};", "  console.log(e);", "if (x == 2) go();"], ["go();", "}", "if (x == 3) go();"], "function f() { return null; }",
        ["list.contains(1);", "list.includes(1);", "list.includes(2);", "list.includes(3);"], *([["// for loop", "go();", "go();", "go();", "go();"]] * 7),
        ["aB, cD, eF, gH, iJ, a_b, c_d, e_f, g_h, i_j", "aB, cD, eF, gH, a_b, c_d, e_f, g_h, i_j"],
    ],
    "c": ['#include "stub.h"', ["int database;", "int temp3 = 0; int data = temp3; /* data */"], ["try_a();", "run();", "run();"], ["try_b();", "run();", "run();"], ["try_c();", "run();", "run();"]],
}
#: (language, condition on q = k div 5, line, rule, severity, subject) that the lines above must give.
_EXPECTED = [
    ("py", "q % 2 = 0 AND q % 3 <> 0", 1, "001", "Critical", "os"), ("py", "q % 2 = 1 AND q % 3 <> 0", 1, "001", "Critical", "js"), ("py", "q % 4 <> 0", 2, "001", "Critical", "pattern"),
    ("py", "true", 6, "001", "Warning", "first"), ("py", "true", 9, "001", "Warning", "second"), ("py", "q % 4 = 3", 12, "001", "Warning", "load_rows"),
    ("py", "q % 3 = 1", 22, "001", "Warning", "make_a"), ("py", "q % 3 = 1", 23, "001", "Warning", "build_b"), ("py", "q % 3 = 1", 24, "001", "Warning", "create_c"),
    ("py", "q % 4 = 1", 13, "002", "Critical", "TODO"), ("py", "q % 4 = 1", 13, "002", "Critical", "模拟数据"), ("py", "q % 4 IN (2, 3)", 13, "002", "Critical", "假数据"),
    ("py", "q % 2 = 1", 9, "003", "Blocker", "second"), ("py", "q % 4 = 3", 13, "003", "Blocker", "假数据"),
    ("py", "q % 2 = 0", 18, "005", "Warning", "data1"), ("py", "q % 2 = 0", 18, "005", "Warning", "temp"), ("py", "q % 2 = 0", 18, "005", "Warning", "data2"), ("py", "q % 2 = 0", 18, "005", "Warning", "foo"),
    ("py", "q % 3 = 0", 4, "006", "Warning", "Tools"), ("py", "q % 3 = 1", 1, "006", "Warning", "Box"), ("py", "q % 3 = 0", 16, "008", "Critical", "pass"), ("py", "q % 3 = 2", 16, "008", "Critical", "print"),
    ("py", "q % 5 = 0", 19, "009", "Blocker", r"\.push\("), ("py", "q % 5 = 1", 19, "009", "Blocker", r"\.length\(\)"),
    ("go", "q % 2 = 0", 2, "001", "Critical", "net/http"), ("go", "q % 2 = 1", 3, "001", "Critical", "fmt"), ("go", "q % 3 = 0", 6, "009", "Blocker", r"strings\.ContainsAny\([^,]*\)"),
    ("rs", "q % 3 <> 0", 1, "001", "Critical", "std::fs"), ("rs", "q % 2 = 1", 2, "001", "Critical", "std::io::Read"), ("rs", "true", 3, "003", "Blocker", "{}"), ("rs", "true", 5, "003", "Blocker", "return"),
    ("ts", "q % 2 = 0", 1, "001", "Critical", "three"), ("ts", "q % 2 = 1", 1, "001", "Critical", "one"), ("ts", "q % 3 = 0", 3, "003", "Blocker", "{}"), ("ts", "q % 3 = 0", 3, "008", "Critical", "catch"),
    ("ts", "q % 3 = 1", 4, "008", "Critical", "catch and print"), ("ts", "q % 3 = 2", 3, "007", "Warning", "if-eq"), ("ts", "true", 6, "003", "Blocker", "return"), ("ts", "q % 4 = 0", 7, "009", "Blocker", r"\.contains\("),
    *(("ts", "q % 5 = 0", n, "004", "Warning", "comment") for n in range(8, 15)), ("ts", "q % 2 = 0", 1, "010", "Warning", "5 and 5"),
    ("c", "true", 1, "002", "Critical", "stub"), ("c", "q % 2 = 1", 2, "005", "Warning", "temp3"), ("c", "q % 2 = 1", 2, "005", "Warning", "data"), ("c", "q % 3 = 0", 3, "007", "Warning", "try"),
]
_FOUND = expected([(lang, when, line, f"DEAD-{rule}", severity, ("subject", subject)) for lang, when, line, rule, severity, subject in _EXPECTED])
_K = slot_keys(_LINES)


def files(spark, sf_dir):
    return slot_files(spark, sf_dir, _LINES)


@query("code_quality", f"WITH {_K} {_FOUND}")
def code_quality(spark, sf_dir):
    return Q.code_quality(files(spark, sf_dir))


@query(
    "code_quality_report",
    f"""
    WITH {_K}, f AS ({_FOUND}),
    c AS (SELECT lang, count(*) AS findings, count(*) FILTER (severity = 'Blocker') AS blocker, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Warning') AS warning FROM f JOIN k USING (file) GROUP BY lang)
    SELECT lang AS part, files, findings, blocker, critical, warning, least(25 * blocker + 15 * critical + 5 * warning, 100) AS score, blocker = 0 AND critical = 0 AS passed
    FROM (SELECT lang, count(*) AS files FROM k GROUP BY lang) JOIN c USING (lang)""",
)
def code_quality_report(spark, sf_dir):
    f = files(spark, sf_dir)
    return Q.quality_report(f, Q.code_quality(f), F.regexp_extract("path", r"\.(\w+)$", 1))
