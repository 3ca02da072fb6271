"""Goals of speed on Python files, and tests of changed files, made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import advice as A
from weftwork.plans.registry import query, table
from weftwork.plans.slots import slot_files, slot_keys

_LINES = {
    "py": [
        ["for a in x:", "while x:", "if x:"], "    for b in y:", ["        for c in z: pass", "        z = sorted(b)", "        pass"], ["data = open(p)", "data = reopen(p)", "data = f.read ()"], ["m = [a for a in x for b in a]", "m = [a for a in x]"],
        ["", "def broken(:"] + [""] * 5,
    ],
    "js": ["for (;;) { for (;;) { open(x) } }"],
}
_BAD = "q % 7 = 1"


@query(
    "performance_findings",
    f"""
    WITH {slot_keys(_LINES)}, ok AS (SELECT * FROM k WHERE lang = 'py' AND NOT ({_BAD})),
    f AS (SELECT file, 'complexity' AS kind, 1 AS line, CASE WHEN q % 3 = 0 THEN 3 ELSE 2 END AS depth FROM ok WHERE q % 3 <> 2
          UNION ALL SELECT file, 'complexity', 2, 2 FROM ok WHERE q % 3 = 0
          UNION ALL SELECT file, 'hotspot', 3, NULL FROM ok WHERE q % 3 = 1
          UNION ALL SELECT file, 'io_in_hot_path', 4, NULL FROM ok WHERE q % 3 <> 1
          UNION ALL SELECT file, 'memory', 5, 2 FROM ok WHERE q % 2 = 0)
    SELECT file, kind, line, depth FROM f""",
)
def performance_findings(spark, sf_dir):
    return A.performance(slot_files(spark, sf_dir, _LINES), "response < 10ms, little memory").select("file", "kind", "line", "depth")


@query("performance_folders", f"WITH {slot_keys(_LINES)} SELECT k % 10 AS root, count(*) AS files, CAST(sum(CASE WHEN {_BAD} THEN 0 ELSE ([2, 2, 0])[1 + q % 3] END) AS BIGINT) AS findings FROM k WHERE lang = 'py' GROUP BY k % 10")
def performance_folders(spark, sf_dir):
    number = F.regexp_extract("path", r"q(\d+)\.", 1).cast("int")
    return A.performance_report(slot_files(spark, sf_dir, _LINES), "fast", number % 10)[0].select("root", "files", "findings")


@query(
    "affected_tests",
    """
    WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part),
    t AS (SELECT k, CASE k % 4 WHEN 0 THEN 'src/a/test_m' || k || '.py' WHEN 1 THEN 'tests/src/a/m' || k || '_test.rs' WHEN 2 THEN 'src/a/tests/test_m' || k || '.py' ELSE 'other/test_m' || k || '.py' END AS test FROM p)
    SELECT test, 'src/a/m' || k || '.py' AS reason, CASE WHEN (SELECT count(*) FROM p WHERE s = 1) > 0 THEN 0 ELSE 1 END AS priority FROM t JOIN p USING (k) WHERE k % 4 <> 3 AND s % 3 = 0""",
)
def affected_tests(spark, sf_dir):
    """Every third size is changed; a message speaks of a fix for each part of size 1."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("src/a/m"), k, F.lit(".py"))
    m = F.col("p_partkey") % 4
    test = F.when(m == 0, F.concat(F.lit("src/a/test_m"), k, F.lit(".py"))).when(m == 1, F.concat(F.lit("tests/src/a/m"), k, F.lit("_test.rs"))).when(m == 2, F.concat(F.lit("src/a/tests/test_m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("other/test_m"), k, F.lit(".py")))
    message = F.when(F.col("p_size") == 1, F.concat(F.lit("fix: bug of "), k)).otherwise("words")
    return A.affected_tests(p.where("p_size % 3 = 0").select(path.alias("path")), p.select(test.alias("path")), p.select(message.alias("message")))
