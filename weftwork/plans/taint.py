"""Taint across calls, on files written from parts: file k hands a value on to file k div 2, the first to the third (a ring)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import taint as T
from weftwork.plans.registry import query, table


def files(spark, sf_dir):
    """run_k passes its k mod 2-th parameter on, at another place and by keyword in turn; some files open or evaluate it, some take values from outside."""
    k = F.col("p_partkey")
    of = lambda *cases: F.element_at(F.array(*map(F.lit, cases)), (F.lit(1) + k % len(cases)).cast("int"))
    after = F.when(k == 1, 3).otherwise(F.floor(k / 2)).cast("string")
    call = F.concat(F.lit("    return run_"), after, of("(moved, 1)", "(1, moved)", "(1, second=moved)"))
    sink = of("    open(moved)", "    eval('x' + first)", "    print(second)", "    log = 'open(first)'  # open(first)", "    opened = [first]")
    run = F.concat(F.lit("def run_"), k.cast("string"), F.lit("(first, second):\n"), of("    moved = first\n", "    moved = f'{second}!'\n"), sink, F.lit("\n"), call)
    serve = F.concat(F.lit("\n\ndef serve(args):\n    path = args.get('file')\n"), F.when(k % 21 == 3, "    os.system(path)\n").otherwise("    path_of = 1\n"), F.lit("    return run_"), k.cast("string"), F.when(k % 14 == 3, "(0, second=path)\n").otherwise("(path, 0)\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/t"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(run, F.when(k % 7 == 3, serve).otherwise("\n")).alias("text"))


_REACHED = """
    WITH RECURSIVE k AS (SELECT p_partkey AS k FROM part),
    step AS (SELECT k, k % 2 AS pos, CASE k WHEN 1 THEN 3 ELSE k // 2 END AS next, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS next_pos FROM k),
    t AS (SELECT k, CASE WHEN k % 14 = 3 THEN 1 ELSE 0 END AS pos, 1 AS depth FROM k WHERE k % 7 = 3
          UNION SELECT next, next_pos, depth + 1 FROM t JOIN step USING (k, pos) WHERE depth < 40)"""


@query("cross_call_taint", _REACHED + """,
    low AS (SELECT k, pos, min(depth) AS depth FROM t WHERE k IN (SELECT k FROM k) GROUP BY ALL)
    SELECT 'src/t' || k || '.py' AS file, 'run_' || k AS fn, 3 AS line, CASE k % 5 WHEN 0 THEN 'open' ELSE 'eval' END AS sink, depth
    FROM low WHERE (k % 5 = 0 AND pos = k % 2) OR (k % 5 = 1 AND pos = 0)
    UNION ALL SELECT 'src/t' || k || '.py', 'serve', 8, 'system', 0 FROM k WHERE k % 7 = 3 AND k % 21 = 3""")
def cross_call_taint(spark, sf_dir):
    return T.taint_findings(files(spark, sf_dir))


@query("taint_depths", _REACHED + " SELECT depth, count(*) AS n FROM (SELECT k, pos, min(depth) AS depth FROM t WHERE k IN (SELECT k FROM k) GROUP BY ALL) GROUP BY depth")
def taint_depths(spark, sf_dir):
    return T.tainted(T.flows(T.facts(files(spark, sf_dir)))).groupBy("depth").agg(F.count("*").alias("n"))
