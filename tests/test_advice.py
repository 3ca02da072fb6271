"""Depths of loops, caps, folders that are passed over, and tests of changed files."""

from pyspark.sql import functions as F

from weftwork.operators import advice


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_loops_calls_and_caps(spark):
    files = {
        "a.py": "def f():\n  while x:\n    if y:\n      for a in b:\n        pass\n    else:\n      for c in d:\n        for e in f: pass\nsorted(open(x))\nz = [i for i in a for j in i]\n",
        "b.py": "for a in b: pass\n" * 3 + "def (", "c.js": "open(x)", "many.py": "sorted(x)\n" * 30, "none.py": None,
    }
    rows = advice.performance(frame(spark, files), "response < 5ms").collect()
    assert [(r.kind, r.line, r.depth) for r in sorted((r for r in rows if r.file == "a.py"), key=lambda r: r["rank"])] == [("complexity", 2, 3), ("hotspot", 9, None), ("complexity", 7, 2), ("io_in_hot_path", 9, None)]
    assert {r.file for r in rows} == {"a.py", "many.py"} and sum(r.file == "many.py" for r in rows) == 15
    assert {r.kind for r in advice.performance(frame(spark, files), "less Memory").collect()} == {"complexity", "hotspot", "memory"}


def test_folders(spark):
    files = {"p/a.py": "sorted(x)", "p/node_modules/b.py": "sorted(x)", "q/.git/c.py": "sorted(x)", "q/d.py": "", "q/e.PY": "sorted(sorted(x))", "p/f.rs": "sorted(x)"}
    n, first = advice.performance_report(frame(spark, files), "fast", F.split_part(F.col("path"), F.lit("/"), F.lit(1)), most=1)
    assert {r.root: (r.files, r.findings) for r in n.collect()} == {"p": (1, 1), "q": (2, 2)}
    assert sorted((r.root, r.file, r["rank"]) for r in first.collect()) == [("p", "p/a.py", 1), ("q", "q/e.PY", 1)]


def test_tests_of_changed_files(spark):
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    listing = table(["test_a.py", "tests/a_test.rs", "lib/test_b.py", "tests/lib/b_test.py", "lib/tests/test_b.rs", "lib/test_c.py", "test_.hidden.py", "lib/test_b.py"])
    words = lambda *m: spark.createDataFrame([(x,) for x in m], "message string")
    got = {(r.test, r.reason, r.priority) for r in advice.affected_tests(table(["a.py", "lib/b.py", "lib/b.rs", ".hidden"]), listing, words("docs only")).collect()}
    assert got == {("test_a.py", "a.py", 1), ("tests/a_test.rs", "a.py", 1), ("lib/test_b.py", "lib/b.py", 1), ("tests/lib/b_test.py", "lib/b.py", 1), ("lib/tests/test_b.rs", "lib/b.py", 1), ("test_.hidden.py", ".hidden", 1)}
    assert {r.priority for r in advice.affected_tests(table(["a.py"]), listing, words("x", None, "fix: a bug")).collect()} == {0}
    assert advice.affected_tests(table(["a.py"]), table([]), words("x")).count() == 0
