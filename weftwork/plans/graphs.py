"""Graph queries; edges are customer -> supplier by orders, or customers and suppliers -> their nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import graph as G
from weftwork.plans.registry import query, table

_EDGES = "SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1000000).alias("dst"))
    return o.join(li, o.o_orderkey == li.l_orderkey).select("src", "dst").distinct()


@query("impact_bfs", f"""
    WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
    w AS (SELECT CAST(1000001 AS BIGINT) AS id, 0 AS depth UNION SELECT u.src, depth + 1 FROM w JOIN u ON u.dst = w.id WHERE depth < 3)
    SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0""")
def impact_bfs(spark, sf_dir):
    e = _edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.impact(both, spark.createDataFrame([(1000001,)], "id long"), 3)


@query("callers", f"WITH e AS ({_EDGES}) SELECT src FROM e WHERE dst = 1000005 ORDER BY src LIMIT 50")
def callers(spark, sf_dir):
    return _edges(spark, sf_dir).where("dst = 1000005").select("src").orderBy("src").limit(50)


@query("in_degree_hubs", f"WITH e AS ({_EDGES}) SELECT dst, count(*) AS degree FROM e GROUP BY dst ORDER BY degree DESC, dst LIMIT 20")
def in_degree_hubs(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "dst").limit(20)


_FILES = "SELECT c_custkey AS src, 1000000 + c_nationkey AS dst FROM customer UNION ALL SELECT 2000000 + s_suppkey, 1000000 + s_nationkey FROM supplier"
_WALK = f"""
    WITH RECURSIVE e AS ({_FILES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT src AS id FROM u),
    w AS (SELECT id, id AS seen FROM v UNION SELECT w.id, u.dst FROM w JOIN u ON u.src = w.seen),
    c AS (SELECT id, min(seen) AS component FROM w GROUP BY id)
"""


def _files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + F.lit(1000000)).cast("long").alias("dst"))
    return c.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2000000).alias("src"), (F.col("s_nationkey") + F.lit(1000000)).cast("long").alias("dst")))


@query("connected_components", _WALK + "SELECT id, component FROM c")
def connected_components(spark, sf_dir):
    return G.components(_files(spark, sf_dir))


@query("community_density", _WALK + """, s AS (SELECT component, count(*) AS size FROM c GROUP BY 1), i AS (SELECT component, count(*) AS internal FROM e JOIN c ON c.id = e.src GROUP BY 1)
    SELECT component, size, internal, least(internal / (size * (size - 1)), 1.0) AS density FROM s JOIN i USING (component)""")
def community_density(spark, sf_dir):
    return G.communities(_files(spark, sf_dir))


@query("graph_edges", """
    WITH sym AS (SELECT 'f' || (p_partkey % 20) AS file, 's' || (p_partkey % 97) AS name, max('f' || (p_partkey % 20) || '::s' || (p_partkey % 97)) AS id FROM part GROUP BY 1, 2),
    call AS (SELECT DISTINCT 'f' || (s_suppkey % 20) AS file, 's' || (s_suppkey % 101) AS name, 'f' || (s_suppkey % 20) || '::s' || (s_suppkey % 13) AS src FROM supplier),
    j AS (SELECT src, coalesce(l.id, (SELECT min(g.id) FROM sym g WHERE g.name = call.name), '?::' || call.name) AS dst FROM call LEFT JOIN sym l ON l.file = call.file AND l.name = call.name)
    SELECT DISTINCT src, dst FROM j WHERE src <> dst""")
def graph_edges(spark, sf_dir):
    at = lambda c, n: F.concat(F.lit("f"), F.col(c) % n)
    name = lambda c, n: F.concat(F.lit("s"), F.col(c) % n)
    sym = table(spark, sf_dir, "part").select(at("p_partkey", 20).alias("file"), name("p_partkey", 97).alias("name")).distinct().withColumn("id", F.concat_ws("::", "file", "name"))
    call = table(spark, sf_dir, "supplier").select(at("s_suppkey", 20).alias("file"), name("s_suppkey", 101).alias("name"), F.concat_ws("::", at("s_suppkey", 20), name("s_suppkey", 13)).alias("src"))
    return G.resolve_calls(call, sym)


@query("symbol_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1_3%' ORDER BY p_partkey LIMIT 40")
def symbol_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%1_3%")).select("p_partkey", "p_name").orderBy("p_partkey").limit(40)


@query("graph_stats", f"WITH e AS ({_EDGES}) SELECT count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(*) AS edges FROM e")
def graph_stats(spark, sf_dir):
    return _edges(spark, sf_dir).agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.count("*").alias("edges"))


@query("predict_impact", "SELECT l_partkey, count(DISTINCT l_suppkey) AS refs, CASE WHEN count(DISTINCT l_suppkey) > 5 THEN 'high' WHEN count(DISTINCT l_suppkey) > 1 THEN 'medium' ELSE 'low' END AS risk FROM lineitem GROUP BY 1")
def predict_impact(spark, sf_dir):
    n = F.col("refs")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("refs")).withColumn("risk", F.when(n > 5, "high").when(n > 1, "medium").otherwise("low"))
