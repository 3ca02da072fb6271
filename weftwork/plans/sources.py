"""Queries over source code, on files written from parts: each defines f_(k mod 50) and g_k."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import code as P
from weftwork.plans.registry import query, table


def _files(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.format_string(
        "import os\nimport re\n\ndef f_%d(x=[]):\n    try:\n        return x / 0\n    except:\n        pass\n\ndef g_%d():\n    total = f_%d(os.sep)\n    for step in range(10):\n        total = total + step * step\n    return total\n\ndef h():\n    pass\n", k % 50, k, (k + 1) % 50
    )
    return table(spark, sf_dir, "part").select(F.format_string("src/m%d.py", k).alias("path"), text.alias("text"))


_PATH = "'src/m' || p_partkey || '.py'"


@query("code_scan", f"SELECT {_PATH} AS file, line, rule, severity FROM part, (VALUES (4, 'mutable_default_arg', 'Warning'), (6, 'divide_by_zero', 'Critical'), (7, 'bare_except', 'Warning'), (7, 'swallowed_exception', 'Warning')) r(line, rule, severity)")
def code_scan(spark, sf_dir):
    return P.findings(_files(spark, sf_dir)).select("file", "line", "rule", "severity")


@query("code_scan_annotated", f"SELECT {_PATH} AS file, rule, 'f_' || (p_partkey % 50) AS symbol FROM part, (VALUES ('mutable_default_arg'), ('divide_by_zero'), ('bare_except'), ('swallowed_exception')) r(rule)")
def code_scan_annotated(spark, sf_dir):
    f = _files(spark, sf_dir)
    return P.annotate(P.findings(f), P.symbols(f)).select("file", "rule", "symbol")


@query("dead_definitions", f"SELECT {_PATH} AS file, 10 AS line, 'g_' || p_partkey AS name FROM part UNION ALL SELECT {_PATH}, 16, 'h' FROM part")
def dead_definitions(spark, sf_dir):
    return P.dead_definitions(P.symbols(_files(spark, sf_dir)))


@query("unused_imports", f"SELECT {_PATH} AS file, 2 AS line, 're' AS name FROM part")
def unused_imports(spark, sf_dir):
    return P.unused_imports(P.symbols(_files(spark, sf_dir)))


@query("duplicate_definitions", "SELECT 'f_' || (p_partkey % 50) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT 'h', count(*) FROM part")
def duplicate_definitions(spark, sf_dir):
    return P.duplicate_definitions(P.symbols(_files(spark, sf_dir)))


@query("duplicate_bodies", "SELECT count(*) AS n FROM part GROUP BY (p_partkey + 1) % 50 HAVING count(*) > 1")
def duplicate_bodies(spark, sf_dir):
    return P.duplicate_bodies(P.symbols(_files(spark, sf_dir))).select("n")


@query("incomplete_bodies", f"SELECT {_PATH} AS file, 'h' AS name FROM part")
def incomplete_bodies(spark, sf_dir):
    return P.symbols(_files(spark, sf_dir)).where("kind = 'incomplete'").select("file", "name")
