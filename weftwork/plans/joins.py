"""Joins, ordered picks, set operations and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import relations as R
from weftwork.plans.registry import query, table


@query("asof_last_signup", """
    SELECT e.event_id, s.event_id AS asof_event_id, s.value AS asof_value FROM (SELECT * FROM events WHERE event_type <> 'signup') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_last_signup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    signups = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return R.asof_join(e.where("event_type <> 'signup'"), signups, ["user_id"], "ts", "ts", ["event_id", "value"]).select("event_id", "asof_event_id", "asof_value")


@query("hubs", "SELECT p_partkey, p_brand, count(*) AS degree FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_brand ORDER BY degree DESC, p_partkey LIMIT 20")
def hubs(spark, sf_dir):
    degree = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("degree"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return degree.join(part, degree.l_partkey == part.p_partkey).select("p_partkey", "p_brand", "degree").orderBy(F.desc("degree"), "p_partkey").limit(20)


@query("left_lookup", "SELECT c_custkey, coalesce(n_name, '') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def left_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("unused_definitions", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unused_definitions(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("unused_in_same_file", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)")
def unused_in_same_file(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(uses, ["o_orderkey", "o_custkey"], "left_anti")


@query("snapshot_diff", """
    WITH o AS (SELECT o_orderkey, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 <> 3),
    n AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 10 <> 4)
    SELECT o_orderkey, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS status
    FROM o FULL JOIN n USING (o_orderkey) WHERE o.h IS DISTINCT FROM n.h""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 10 <> 3").select("o_orderkey", F.md5("o_orderstatus").alias("h"))
    new = o.where("o_orderkey % 10 <> 4").select("o_orderkey", F.md5(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))).alias("h"))
    return R.snapshot_diff(old, new, "o_orderkey", "h")


@query("unscanned_signatures", "SELECT doc_id, md5(text) AS sig FROM documents WHERE NOT (doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id AND d.doc_id % 3 = 0))")
def unscanned_signatures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sig"))
    seen = d.where("doc_id % 6 = 0")
    return d.join(seen, ["doc_id", "sig"], "left_anti")


@query("similar_line_sets", """
    WITH l AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS x FROM documents),
    n AS (SELECT id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS sig FROM l GROUP BY id),
    r AS (SELECT min(id) AS id FROM n GROUP BY sig),
    s AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM l a JOIN l b USING (x) JOIN r ra ON ra.id = a.id JOIN r rb ON rb.id = b.id WHERE a.id < b.id GROUP BY 1, 2)
    SELECT a, b, k / (p.n + q.n - k) AS jaccard FROM s JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8 AND k / (p.n + q.n - k) < 1""")
def similar_line_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.jaccard_pairs(lines, "doc_id", "line", 0.8)


@query("similar_line_links", """
    WITH l AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS x FROM documents),
    n AS (SELECT id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS sig FROM l GROUP BY id),
    s AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM l a JOIN l b USING (x) WHERE a.id <> b.id GROUP BY 1, 2),
    j AS (SELECT a, count(*) AS links FROM s JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8 GROUP BY a)
    SELECT id, min(id) OVER (PARTITION BY sig) AS rep, coalesce(links, 0) AS links FROM n LEFT JOIN j ON j.a = n.id""")
def similar_line_links(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.jaccard_links(lines, "doc_id", "line", 0.8)


@query("compare_sets", """
    WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05),
    j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k),
    c AS (SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS "both", count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b FROM j)
    SELECT "both", only_a, only_b, only_a + only_b AS symmetric, CASE WHEN only_a = 0 AND only_b = 0 THEN 'same' WHEN "both" = 0 THEN 'disjoint' ELSE 'overlap' END AS verdict FROM c""")
def compare_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return R.compare_sets(li.where("l_quantity > 40"), li.where("l_discount > 0.05"), "l_partkey")


@query("tagged_union", """
    SELECT * FROM (SELECT 'event' AS source, event_id AS id, ts AS t FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders) ORDER BY t DESC, source, id LIMIT 100""")
def tagged_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("t"))
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"))
    return e.unionByName(o).orderBy(F.desc("t"), "source", "id").limit(100)


@query("exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("idempotent_append", "SELECT left(sha256(text), 16) AS hash, min(doc_id) AS doc_id FROM documents WHERE doc_id >= 500 AND left(sha256(text), 16) NOT IN (SELECT left(sha256(text), 16) FROM documents WHERE doc_id < 500) GROUP BY 1")
def idempotent_append(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    return R.append_new(d.where("doc_id < 500"), d.where("doc_id >= 500"), ["hash"], [F.col("doc_id")])


@query("best_per_key", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def best_per_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.first_by(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]).drop("l_partkey")


@query("first_per_key", "SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def first_per_key(spark, sf_dir):
    return R.first_by(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], [F.col("c_custkey")])


@query("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_k_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.first_by(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("priority_ranking", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus <> 'O', o_orderpriority LIKE '1%' DESC, o_totalprice DESC, o_orderkey LIMIT 40")
def priority_ranking(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.orderBy(F.col("o_orderstatus") != "O", F.desc(F.col("o_orderpriority").startswith("1")), F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("frequency_ranking", "SELECT l_suppkey, count(*) AS n, (list_sort(list(l_orderkey)))[1:6] AS first_orders FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 30")
def frequency_ranking(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("l_orderkey")), 1, 6).alias("first_orders"))
    return g.orderBy(F.desc("n"), "l_suppkey").limit(30)


@query("lead_pairs", "SELECT event_id, next_id FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events) WHERE next_id IS NOT NULL")
def lead_pairs(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next_id")).where("next_id IS NOT NULL")


@query("claim_evidence", """
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'refuted' WHEN o_totalprice > 200000 THEN 'unverifiable' ELSE 'verified' END AS verdict
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def claim_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.when(F.col("there").isNull(), "refuted").when(F.col("o_totalprice") > 200000, "unverifiable").otherwise("verified").alias("verdict"))


@query("interval_overlap", """
    SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand AND a.p_type = b.p_type
    AND a.p_retailprice <= b.p_retailprice + b.p_size AND b.p_retailprice <= a.p_retailprice + a.p_size""")
def interval_overlap(spark, sf_dir):
    return R.overlap_pairs(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size"))


@query("grouping_report", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())""")
def grouping_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey")
    return li.groupingSets([["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("files"))


@query("severity_report", """
    SELECT o_orderpriority AS rule, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 3) AS noise_ratio, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1""")
def severity_report(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("rule")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.round(F.count_if(F.col("o_orderstatus") == "O") / F.count("*"), 3).alias("noise_ratio"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst")
    )


@query("rule_matrix", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey")
def rule_matrix(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return g.select("o_custkey", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("demoted_severity", """
    WITH w AS (SELECT p_brand, avg(p_size) AS weight FROM part GROUP BY p_brand)
    SELECT p_partkey, CASE WHEN weight < 25 THEN 'Info' ELSE 'Suggestion' END AS severity FROM part JOIN w USING (p_brand)""")
def demoted_severity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    w = p.groupBy("p_brand").agg(F.avg("p_size").alias("weight"))
    return p.join(w, "p_brand").select("p_partkey", F.when(F.col("weight") < 25, "Info").otherwise("Suggestion").alias("severity"))


@query("mean_median", "SELECT l_returnflag, avg(l_quantity) AS mean, median(l_quantity) AS median FROM lineitem GROUP BY l_returnflag")
def mean_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median"))
