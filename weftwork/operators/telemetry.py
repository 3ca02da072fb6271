"""Telemetry aggregates: per-tool counts, error rates and exact nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ms: Column) -> Column:
    """Milliseconds as whole microseconds."""
    return F.round(ms * F.lit(1000.0)).cast("long")


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, of times with or without a zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def nearest_rank_by(df: DataFrame, keys: list[str], value: Column, p: float, out: str) -> DataFrame:
    """Exact nearest-rank percentile ``sorted[round((n-1)*p)]`` of each group.

    Rows are first folded to (key, value, count) so that what is ordered per key is the number of
    distinct values, not of rows; the rank is then found on running counts.
    """
    folded = df.where(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    run = by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = folded.select(*keys, "_v", F.sum("_n").over(run).alias("_upto"), F.sum("_n").over(by).alias("_all"))
    at = F.round((F.col("_all") - 1) * F.lit(float(p))).cast("long")
    return ranked.where(F.col("_upto") > at).groupBy(*keys).agg(F.min("_v").alias(out))


def tool_summary(calls: DataFrame, tool: str, ms: str, is_error: Column, ts: str, seq: str) -> DataFrame:
    """Per tool: calls, errors, error rate, mean and p95 on whole microseconds, raw maximum, last seen."""
    base = calls.groupBy(F.col(tool).alias("tool")).agg(
        F.count("*").alias("calls"),
        F.count_if(is_error).alias("errors"),
        F.avg(micros(F.col(ms)) / F.lit(1000.0)).alias("avg_ms"),
        F.max(ms).alias("max_ms"),
        F.max_by(ts, seq).alias("last_ts"),
    )
    p95 = nearest_rank_by(calls.select(F.col(tool).alias("tool"), ms), ["tool"], micros(F.col(ms)), 0.95, "p95_us")
    return base.join(p95, "tool", "left").select(
        "tool", "calls", "errors", (F.col("errors") / F.col("calls")).alias("error_rate"),
        F.round("avg_ms", 6).alias("avg_ms"), (F.coalesce("p95_us", F.lit(0)) / F.lit(1000.0)).alias("p95_ms"), "max_ms", "last_ts",
    )


def alarms(summary: DataFrame, overall: DataFrame, heartbeats: DataFrame, now: Column, p95_slow_ms: float = 5000, error_rate: float = 0.5, stale_s: float = 900) -> DataFrame:
    """(rule, target, level) of slow tools, failing tools, stale loops and a failing whole.

    summary: what ``tool_summary`` gives; overall: one row (calls, errors); heartbeats: (loop, last_ts).
    """
    row = lambda rule, target, level: (F.lit(rule).alias("rule"), target.alias("target"), F.lit(level).alias("level"))
    slow = summary.where(F.col("p95_ms") > p95_slow_ms).select(*row("tool_p95_slow", F.col("tool"), "WARN"))
    bad = summary.where((F.col("calls") >= 3) & (F.col("errors") / F.col("calls") > error_rate)).select(*row("tool_err_rate", F.col("tool"), "WARN"))
    age = F.greatest(F.lit(0.0), seconds(now) - seconds(F.col("last_ts")))
    stale = heartbeats.where(age > stale_s).select(*row("daemon_stale", F.col("loop"), "CRITICAL"))
    whole = overall.where((F.col("calls") >= 10) & (F.col("errors") / F.col("calls") > error_rate)).select(*row("overall_err_rate", F.lit("*"), "WARN"))
    return slow.unionByName(bad).unionByName(stale).unionByName(whole)


def suppress(rows: DataFrame, keys: list[str], at: str, gap_s: float) -> DataFrame:
    """Rows at least ``gap_s`` seconds after the last row of their key that was kept.

    What counts is the last row kept, so this is a fold over each key's times and not a window.
    """
    times = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("_t"))
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("kept"))
    step = lambda a, t: F.when(t - a["last"] >= gap_s, F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a)
    return times.select(*keys, F.explode(F.aggregate("_t", start, step)["kept"]).alias(at))


def trend(rows: DataFrame, key: str, inside: Column, share: float = 0.2) -> DataFrame:
    """Per key: rows in the window, rows before it, and whether the key goes up, down or stays, at +-``share``."""
    counts = rows.groupBy(key).agg(F.count_if(inside).alias("recent"), F.count_if(~inside).alias("before"))
    way = F.when(F.col("recent") > F.col("before") * (1 + share), "up").when(F.col("recent") < F.col("before") * (1 - share), "down").otherwise("flat")
    return counts.select(key, "recent", "before", way.alias("trend"))


def successors(rows: DataFrame, by: list[str], order: list[str], tool: str, top: int = 3) -> DataFrame:
    """For each tool, its ``top`` most frequent successors with counts and ranks (ties by name)."""
    w = Window.partitionBy(*by).orderBy(*order)
    pairs = rows.select(F.col(tool).alias("tool"), F.lead(tool).over(w).alias("next")).where("next IS NOT NULL").groupBy("tool", "next").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("n"), "next"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top)


#: US dollars for a million tokens in and out.
PRICES = {
    "deepseek-chat": (0.27, 1.10), "deepseek-reasoner": (0.55, 2.19), "claude-sonnet": (3.00, 15.00), "claude-opus": (15.00, 75.00),
    "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "qwen-max": (1.60, 6.40), "qwen-plus": (0.40, 1.20), "default": (1.00, 4.00),
}
USD_CNY = 7.2


def estimated_tokens(text: Column) -> Column:
    """CJK characters one by one, others by four, of the first 200 000 characters; an empty text has none."""
    t = F.substring(text, 1, 200_000)
    other = F.length(F.regexp_replace(t, "[一-鿿　-〿＀-￯]", ""))
    return F.when(F.length(t) > 0, F.length(t) - other + F.greatest(F.lit(1), F.floor(other / 4))).otherwise(0).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, model: str = "deepseek-chat") -> Column:
    a, b = PRICES.get(model, PRICES["default"])
    return tokens_in * F.lit(a) / F.lit(1e6) + tokens_out * F.lit(b) / F.lit(1e6)


def cost_summary(rows: DataFrame, model: str = "deepseek-chat") -> DataFrame:
    """Calls, tokens and cost by tool, by day, by project and in all, from one pass with grouping sets.

    rows: (tool, day, project, tokens_in, tokens_out).
    """
    sets = rows.groupingSets([["tool"], ["day"], ["project"], []], "tool", "day", "project").agg(
        F.grouping_id().alias("g"), F.count("*").alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out")
    )
    by = F.when(F.col("g") == 3, "tool").when(F.col("g") == 5, "day").when(F.col("g") == 6, "project").otherwise("all")
    return sets.select(by.alias("by"), F.coalesce(F.col("tool"), F.col("day").cast("string"), F.col("project"), F.lit("*")).alias("key"), "calls", "tokens_in", "tokens_out", F.round(cost_usd(F.col("tokens_in"), F.col("tokens_out"), model), 6).alias("cost_usd"))
