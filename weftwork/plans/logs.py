"""Queries over call logs, on the ``events`` table (event_type is the tool, value its milliseconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import relations, telemetry
from weftwork.operators.telemetry import tool_summary
from weftwork.plans.registry import query, table


@query(
    "telemetry_status",
    """
    WITH e AS (SELECT event_type AS tool, value, ts, event_id, CAST(round(value * 1000.0) AS BIGINT) AS us FROM events)
    SELECT tool, count(*) AS calls, count(*) FILTER (WHERE tool = 'error') AS errors,
           count(*) FILTER (WHERE tool = 'error') / count(*) AS error_rate,
           round(avg(us / 1000.0::DOUBLE), 6) AS avg_ms,
           (list_sort(list(us)))[CAST(round((count(us) - 1) * 0.95::DOUBLE) AS INT) + 1] / 1000.0::DOUBLE AS p95_ms,
           max(value) AS max_ms, arg_max(ts, event_id) AS last_ts
    FROM e GROUP BY tool
    """,
)
def telemetry_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    return tool_summary(e, "event_type", "value", F.col("event_type") == "error", "ts", "event_id")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_ERR = "event_type = 'error'"


@query("telemetry_overall", """
    SELECT count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate,
           (list_sort(list(CAST(round(value * 1000.0) AS BIGINT))))[CAST(round((count(value) - 1) * 0.95::DOUBLE) AS INT) + 1] / 1000.0::DOUBLE AS p95_ms FROM events""")
def telemetry_overall(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", "value")
    p95 = telemetry.nearest_rank_by(e.select(F.lit(1).alias("k"), "value"), ["k"], telemetry.micros(F.col("value")), 0.95, "us")
    a = e.agg(F.count("*").alias("calls"), F.count_if(F.expr(_ERR)).alias("errors")).withColumn("k", F.lit(1))
    return a.join(p95, "k").select("calls", "errors", F.round(F.col("errors") / F.col("calls"), 6).alias("error_rate"), (F.col("us") / F.lit(1000.0)).alias("p95_ms"))


@query("tail_records", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def tail_records(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("query_logs", "SELECT event_id, ts, value FROM events WHERE event_type = 'purchase' AND user_id = 17 ORDER BY ts DESC, event_id DESC LIMIT 200")
def query_logs(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'purchase' AND user_id = 17").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts", "value")


@query("telemetry_query_tail_then_filter", "SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE event_type = 'error'")
def telemetry_query_tail_then_filter(spark, sf_dir):
    last = _events(spark, sf_dir).select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return last.where(_ERR).select("event_id", "ts")


@query("recent_errors", "SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 80) WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_errors(spark, sf_dir):
    newest = (F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).select("event_id", "ts", "event_type").orderBy(*newest).limit(80).where(_ERR).orderBy(*newest).limit(20).select("event_id", "ts")


@query("time_window", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type")
def time_window(spark, sf_dir):
    e = _events(spark, sf_dir)
    end = e.agg(F.max("ts").alias("end"))
    return e.join(F.broadcast(end)).where(F.col("ts") >= F.col("end") - F.expr("INTERVAL 1 DAY")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("stats_by_tool", "SELECT event_type AS tool, count(*) AS n, round(avg(value), 3) AS avg_ms FROM events GROUP BY event_type ORDER BY n DESC, tool LIMIT 30")
def stats_by_tool(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("avg_ms")).orderBy(F.desc("n"), "tool").limit(30)


@query("telemetry_snapshot", """
    WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 300)
    SELECT event_id, event_type, value, (SELECT round(count(*) FILTER (WHERE event_type = 'error') / count(*), 3) FROM t) AS error_rate FROM t ORDER BY value DESC, event_id LIMIT 8""")
def telemetry_snapshot(spark, sf_dir):
    t = _events(spark, sf_dir).select("event_id", "ts", "event_type", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(300)
    rate = t.agg(F.round(F.count_if(F.expr(_ERR)) / F.count("*"), 3).alias("error_rate"))
    return t.orderBy(F.desc("value"), "event_id").limit(8).join(F.broadcast(rate)).select("event_id", "event_type", "value", "error_rate")


@query("heartbeat_freshness", "SELECT user_id, date_diff('microsecond', max(ts), TIMESTAMP '2100-01-01') / 1e6 > 900 AS stale FROM events WHERE event_type = 'view' GROUP BY user_id")
def heartbeat_freshness(spark, sf_dir):
    last = _events(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.max_by("ts", F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", (telemetry.seconds(F.lit("2100-01-01")) - telemetry.seconds(F.col("last")) > 900).alias("stale"))


@query("alarm_rules", """
    WITH s AS (SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, (list_sort(list(CAST(round(value * 1000.0) AS BIGINT))))[CAST(round((count(value) - 1) * 0.95::DOUBLE) AS INT) + 1] / 1000.0 AS p95 FROM events GROUP BY 1)
    SELECT 'tool_p95_slow' AS rule, tool AS target, 'WARN' AS level FROM s WHERE p95 > 130
    UNION ALL SELECT 'tool_err_rate', tool, 'WARN' FROM s WHERE calls >= 3 AND errors / calls > 0.5
    UNION ALL SELECT 'daemon_stale', CAST(user_id AS VARCHAR), 'CRITICAL' FROM events GROUP BY user_id HAVING date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 1e6 > 900
    UNION ALL SELECT 'overall_err_rate', '*', 'WARN' FROM events HAVING count(*) >= 10 AND count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.5""")
def alarm_rules(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ts")).first()[0]
    beats = e.groupBy(F.col("user_id").cast("string").alias("loop")).agg(F.max("ts").alias("last_ts"))
    overall = e.agg(F.count("*").alias("calls"), F.count_if(F.expr(_ERR)).alias("errors"))
    return telemetry.alarms(tool_summary(e, "event_type", "value", F.expr(_ERR), "ts", "event_id"), overall, beats, F.lit(now), p95_slow_ms=130)


@query("alarm_suppression", """
    WITH RECURSIVE t AS (SELECT event_type, epoch(ts) AS t0 FROM events),
    kept AS (SELECT event_type, min(t0) AS t0 FROM t GROUP BY event_type
             UNION ALL SELECT k.event_type, (SELECT min(t.t0) FROM t WHERE t.event_type = k.event_type AND t.t0 - k.t0 >= 1800) FROM kept k WHERE k.t0 IS NOT NULL)
    SELECT event_type, t0 FROM kept WHERE t0 IS NOT NULL""")
def alarm_suppression(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_type", telemetry.seconds(F.col("ts")).alias("t0"))
    return telemetry.suppress(rows, ["event_type"], "t0", 1800)


@query("rate_limited", """
    WITH RECURSIVE t AS (SELECT user_id, epoch(ts) AS t0 FROM events),
    kept AS (SELECT user_id, min(t0) AS t0 FROM t GROUP BY user_id
             UNION ALL SELECT k.user_id, (SELECT min(t.t0) FROM t WHERE t.user_id = k.user_id AND t.t0 - k.t0 >= 86400) FROM kept k WHERE k.t0 IS NOT NULL)
    SELECT user_id, t0 FROM kept WHERE t0 IS NOT NULL""")
def rate_limited(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", telemetry.seconds(F.col("ts")).alias("t0"))
    return telemetry.suppress(rows, ["user_id"], "t0", 86400)


@query("scan_trend", """
    WITH m AS (SELECT max(ts) - INTERVAL 3 DAY AS cut FROM events)
    SELECT event_type, count(*) FILTER (WHERE ts >= cut) AS recent, count(*) FILTER (WHERE ts < cut) AS before,
           CASE WHEN count(*) FILTER (WHERE ts >= cut) > count(*) FILTER (WHERE ts < cut) * 1.2::DOUBLE THEN 'up' WHEN count(*) FILTER (WHERE ts >= cut) < count(*) FILTER (WHERE ts < cut) * 0.8::DOUBLE THEN 'down' ELSE 'flat' END AS trend
    FROM events, m GROUP BY event_type""")
def scan_trend(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", "ts")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 3 DAY")).alias("cut"))
    return telemetry.trend(e.join(F.broadcast(cut)), "event_type", F.col("ts") >= F.col("cut"))


@query("bigram_transitions", """
    WITH p AS (SELECT event_type AS tool, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
    c AS (SELECT tool, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY tool, next)
    SELECT tool, next, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY n DESC, next) AS rank FROM c) WHERE rank <= 3""")
def bigram_transitions(spark, sf_dir):
    return telemetry.successors(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("most_active_root", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY n DESC, user_id LIMIT 1")
def most_active_root(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "user_id").limit(1)


@query("heartbeat_mean", "SELECT user_id, count(*) AS n, avg(value) AS mean, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE event_type = 'click' GROUP BY user_id")
def heartbeat_mean(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("tiered_query", """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    t AS (SELECT event_id, ts, CASE WHEN rn <= 500 THEN 'hot' WHEN rn <= 5500 THEN 'warm' ELSE 'cold' END AS tier FROM r WHERE event_type = 'error')
    SELECT event_id, ts, tier FROM t ORDER BY ts DESC, event_id DESC LIMIT 300""")
def tiered_query(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "ts", "event_type")
    newest = (F.desc("ts"), F.desc("event_id"))
    hot, upto_warm = e.orderBy(*newest).limit(500), e.orderBy(*newest).limit(5500)
    warm_ids = upto_warm.select("event_id", F.lit(1).alias("in_warm"))
    hot_ids = hot.select("event_id", F.lit(1).alias("in_hot"))
    tier = F.when(F.col("in_hot") == 1, "hot").when(F.col("in_warm") == 1, "warm").otherwise("cold")
    return e.where(_ERR).join(warm_ids, "event_id", "left").join(hot_ids, "event_id", "left").select("event_id", "ts", tier.alias("tier")).orderBy(*newest).limit(300)


_TOKENS_SQL = "CASE WHEN length(left(text, 200000)) > 0 THEN length(left(text, 200000)) - length(regexp_replace(left(text, 200000), '[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]', '', 'g')) + greatest(1, length(regexp_replace(left(text, 200000), '[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]', '', 'g')) // 4) ELSE 0 END"


@query("token_estimate", f"SELECT doc_id, CAST({_TOKENS_SQL} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", telemetry.estimated_tokens(F.col("text")).alias("tokens"))


@query("code_cost", f"SELECT doc_id, round(({_TOKENS_SQL}) * 0.27::DOUBLE / 1e6, 9) AS cost_usd FROM documents")
def code_cost(spark, sf_dir):
    t = telemetry.estimated_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(telemetry.cost_usd(t, F.lit(0)), 9).alias("cost_usd"))


@query("cost_summary", f"""
    WITH r AS (SELECT role AS tool, 'day' || (turn % 3) AS day, 'p' || (conv_id % 5) AS project, CASE WHEN role <> 'assistant' THEN {_TOKENS_SQL} ELSE 0 END AS ti, CASE WHEN role = 'assistant' THEN {_TOKENS_SQL} ELSE 0 END AS tou FROM conversations),
    g AS (SELECT 'tool' AS "by", tool AS key, ti, tou FROM r UNION ALL SELECT 'day', day, ti, tou FROM r UNION ALL SELECT 'project', project, ti, tou FROM r UNION ALL SELECT 'all', '*', ti, tou FROM r)
    SELECT "by", key, count(*) AS calls, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tou) AS BIGINT) AS tokens_out, round(sum(ti) * 0.27::DOUBLE / 1e6 + sum(tou) * 1.1::DOUBLE / 1e6, 6) AS cost_usd FROM g GROUP BY "by", key""")
def cost_summary(spark, sf_dir):
    t, says = telemetry.estimated_tokens(F.col("text")), F.col("role") == "assistant"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("tool"), F.concat(F.lit("day"), F.col("turn") % 3).alias("day"), F.concat(F.lit("p"), F.col("conv_id") % 5).alias("project"),
        F.when(says, 0).otherwise(t).alias("tokens_in"), F.when(says, t).otherwise(0).alias("tokens_out"),
    )
    return telemetry.cost_summary(rows)


@query("key_fallbacks", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), CASE WHEN event_id % 2 = 0 THEN 'action' END, '?') AS tool FROM events")
def key_fallbacks(spark, sf_dir):
    tool = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", F.coalesce(F.nullif(tool, F.lit("")), F.when(F.col("event_id") % 2 == 0, "action"), F.lit("?")).alias("tool"))


@query("props_json", "SELECT count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS valid FROM events")
def props_json(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("histogram_max_merge", "SELECT event_type, max(n) AS n FROM (SELECT event_type, user_id % 4 AS part, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def histogram_max_merge(spark, sf_dir):
    parts = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 4).alias("part")).agg(F.count("*").alias("n"))
    return parts.groupBy("event_type").agg(F.max("n").alias("n"))
