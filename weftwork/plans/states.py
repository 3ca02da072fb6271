"""State folds over ``events`` (per user, in order of ts and event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import state as S
from weftwork.operators.relations import first_by
from weftwork.plans.registry import query, table


def _deltas(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", ((F.col("value") - 60) / 100).alias("delta"))


@query("lesson_fold", """
    WITH RECURSIVE e AS (SELECT user_id, (value - 60) / 100 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, 0 AS k, 0.5::DOUBLE AS u, false AS gone FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL SELECT f.user_id, f.k + 1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, u + d)), gone OR greatest(0.0::DOUBLE, least(1.0::DOUBLE, u + d)) < 0.1::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, round(arg_max(u, k), 9) AS utility, CAST(max(k) AS BIGINT) AS recall, arg_max(gone, k) AS archived FROM f GROUP BY user_id""")
def lesson_fold(spark, sf_dir):
    return S.lesson_utility(_deltas(spark, sf_dir), "user_id", ["ts", "event_id"], "delta").withColumn("utility", F.round("utility", 9))


@query("rule_weight_fold", """
    WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN (value - 60) / 100 ELSE -abs((value - 60) / 100) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, 0 AS k, 1.0::DOUBLE AS w FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL SELECT f.user_id, f.k + 1, greatest(0.0::DOUBLE, least(3.0::DOUBLE, w + d)) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, round(arg_max(w, k), 9) AS weight FROM f GROUP BY user_id""")
def rule_weight_fold(spark, sf_dir):
    return S.rule_weight(_deltas(spark, sf_dir), "user_id", ["ts", "event_id"], "delta", F.col("event_type") == "purchase").withColumn("weight", F.round("weight", 9))


@query("ucb_backprop", "SELECT user_id, round(sum(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 60) / 100))), 9) AS reward_sum, count(*) AS visits FROM events GROUP BY user_id")
def ucb_backprop(spark, sf_dir):
    return S.backprop(_deltas(spark, sf_dir), "user_id", "delta").withColumn("reward_sum", F.round("reward_sum", 9))


@query("ucb_select", """
    WITH n AS (SELECT c_custkey AS id, c_nationkey AS parent, c_acctbal / 1000 AS reward_sum, c_custkey % 17 AS visits FROM customer),
    t AS (SELECT parent, greatest(1, sum(visits)) AS total FROM n GROUP BY parent),
    s AS (SELECT id, parent, CASE WHEN visits = 0 THEN 'infinity'::DOUBLE ELSE reward_sum / visits + 1.414::DOUBLE * sqrt(ln(total)) / sqrt(visits) END AS score FROM n JOIN t USING (parent))
    SELECT parent, id, score FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) AS rn FROM s) WHERE rn = 1""")
def ucb_select(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.ucb_select(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), (F.col("c_acctbal") / 1000).alias("reward_sum"), (F.col("c_custkey") % 17).alias("visits")), "parent")


@query("experience_upsert", "SELECT user_id || '-' || event_type AS key, arg_max(left(props, 200), (ts, event_id)) AS summary FROM events GROUP BY user_id, event_type")
def experience_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), "ts", "event_id", F.substring("props", 1, 200).alias("summary"))
    return first_by(e, ["key"], [F.desc("ts"), F.desc("event_id")]).select("key", "summary")


@query("recall_order", "SELECT id, hub FROM (SELECT c_custkey AS id, abs(c_acctbal) / 10000 AS u, c_custkey % 23 AS r, abs(c_acctbal) / 10000 + least(c_custkey % 23, 10) * 0.015::DOUBLE AS hub FROM customer WHERE c_custkey % 9 <> 0) ORDER BY hub DESC, u DESC, id LIMIT 30")
def recall_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 10000).alias("utility"), (F.col("c_custkey") % 23).alias("recall"), (F.col("c_custkey") % 9 == 0).alias("archived"))
    return S.recall_order(c, 30).select("id", "hub")
