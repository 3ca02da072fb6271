"""Reports over findings made from lineitem: a supplier is a file, a quantity's remainder a rule, flag and status are the severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import reports as R
from weftwork.plans.registry import query, table

_F = """f AS (SELECT 'src/s' || l_suppkey || ([ '.py', '.go', '.RS', '' ])[1 + l_suppkey % 4] AS file, 'rule_' || (CAST(l_quantity AS INTEGER) % 9) AS rule, CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'Warning' ELSE CASE WHEN l_linenumber = 1 THEN 'odd' ELSE 'info' END END AS severity,
           CASE WHEN l_linenumber > 5 THEN NULL ELSE 'f' || l_linenumber END AS symbol FROM lineitem)"""


def _findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".go", ".RS", ""))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    severity = F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "N", "Warning").when(F.col("l_linenumber") == 1, "odd").otherwise("info")
    return li.select(F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), suffix).alias("file"), F.concat(F.lit("rule_"), (F.col("l_quantity").cast("int") % 9).cast("string")).alias("rule"), severity.alias("severity"), F.when(F.col("l_linenumber") <= 5, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("symbol"))


@query(
    "scan_report",
    f"""
    WITH {_F}, t AS (SELECT count(*) AS findings, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'Warning') AS n_warn, count(*) FILTER (severity IN ('odd', 'info')) AS n_info FROM f),
    a AS (SELECT file, count(*) AS n FROM f GROUP BY file ORDER BY n DESC, file LIMIT 1), b AS (SELECT rule, count(*) AS n FROM f GROUP BY rule ORDER BY n DESC, rule LIMIT 1)
    SELECT findings, n_error, n_warn, n_info, round(n_info / findings, 3) AS noise_ratio, a.file AS worst_file, a.n AS worst_n, b.rule AS top_rule, b.n AS top_n FROM t, a, b""",
)
def scan_report(spark, sf_dir):
    return R.scan_report(_findings(spark, sf_dir))


@query("file_rules", f"WITH {_F} SELECT file, string_agg(rule || '=' || n, ',' ORDER BY rule) AS rules FROM (SELECT file, rule, count(*) AS n FROM f GROUP BY ALL) GROUP BY file")
def file_rules(spark, sf_dir):
    text = F.array_join(F.transform(F.map_entries("rules"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return R.file_rules(_findings(spark, sf_dir)).select("file", text.alias("rules"))


@query(
    "annotation_rollup",
    f"""
    WITH {_F}
    SELECT 'file' AS kind, file AS key, count(*) AS n FROM f GROUP BY file UNION ALL SELECT 'rule', rule, count(*) FROM f GROUP BY rule
    UNION ALL SELECT 'severity', CASE severity WHEN 'odd' THEN 'unknown' ELSE lower(severity) END, count(*) FROM f GROUP BY ALL
    UNION ALL (SELECT 'symbol', file || '#' || coalesce(symbol, '<unknown>') AS key, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, key LIMIT 50)
    UNION ALL SELECT 'language', ([ 'py', 'go', 'rs' ])[1 + l_suppkey % 4], count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey % 4 < 3 GROUP BY ALL""",
)
def annotation_rollup(spark, sf_dir):
    return R.rollup(_findings(spark, sf_dir))


@query(
    "scan_trend_report",
    """
    WITH e AS (SELECT event_type AS tool, CASE WHEN user_id % 3 = 0 THEN ['r' || (user_id % 17), 'r' || (event_id % 13)] WHEN user_id % 3 = 1 THEN [] END AS rules, ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) AS inside FROM events),
    c AS (SELECT 'tool' AS kind, tool AS key, count(*) AS n FROM e WHERE inside GROUP BY tool UNION ALL SELECT 'rule', rule, count(*) FROM (SELECT unnest(rules) AS rule FROM e WHERE inside) GROUP BY rule),
    t AS (SELECT coalesce(sum(len(rules)) FILTER (inside), 0) AS now, coalesce(sum(len(rules)) FILTER (NOT inside), 0) AS before FROM e)
    SELECT kind, key, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS rank FROM c) WHERE rank <= 10
    UNION ALL SELECT 'trend', CASE WHEN before = 0 THEN CASE WHEN now = 0 THEN 'flat' ELSE 'up' END WHEN now > before * 1.2 THEN 'up' WHEN now < before * 0.8 THEN 'down' ELSE 'flat' END, now, 0 FROM t""",
)
def scan_trend_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    e = e.join(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("cut"))))
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    rules = F.when(F.col("user_id") % 3 == 0, F.array(name(F.col("user_id") % 17), name(F.col("event_id") % 13))).when(F.col("user_id") % 3 == 1, F.array().cast("array<string>"))
    return R.trend_report(e.withColumnRenamed("event_type", "tool"), rules, F.col("ts") >= F.col("cut"))


@query(
    "std_summary",
    """
    WITH f AS (SELECT p_brand AS rule, CASE p_size % 3 WHEN 0 THEN 'Suggestion' WHEN 1 THEN 'Warning' ELSE 'Critical' END AS severity FROM part),
    w AS (SELECT p_brand AS rule, avg(CASE WHEN p_size > 30 THEN 1.0 ELSE 0.0 END) AS weight FROM part WHERE p_size <> 7 GROUP BY p_brand)
    SELECT 'before' AS at, severity, count(*) AS n FROM f GROUP BY severity
    UNION ALL SELECT 'after', CASE WHEN severity = 'Suggestion' AND weight < 0.3 THEN 'Info' ELSE severity END AS s, count(*) FROM f LEFT JOIN w USING (rule) GROUP BY s""",
)
def std_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = F.col("p_size") % 3
    f = p.select(F.col("p_brand").alias("rule"), F.when(m == 0, "Suggestion").when(m == 1, "Warning").otherwise("Critical").alias("severity"))
    weights = p.where("p_size <> 7").groupBy(F.col("p_brand").alias("rule")).agg(F.avg(F.when(F.col("p_size") > 30, 1.0).otherwise(0.0)).alias("weight"))
    before, after = R.severity_counts(f), R.severity_counts(R.demoted(f, weights))
    return before.select(F.lit("before").alias("at"), "severity", "n").unionByName(after.select(F.lit("after").alias("at"), "severity", "n"))
