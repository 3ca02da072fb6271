"""Reports over findings (file, line, rule, severity, ...): what a scan found, where, how it changes, and what weights demote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.relations import first_by

# Severities that are known, how many symbols and names a report lists, and the weight under which a rule's suggestions become remarks.
SEVERITIES = ("error", "warning", "warn", "info", "suggestion")
TOP_SYMBOLS, TOP_NAMES, LEAST_WEIGHT, LONGEST_RULE = 50, 10, 0.3, 40


def _suffix(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./\\]*)$", 1))


def scan_report(findings: DataFrame) -> DataFrame:
    """One row: findings, errors, warnings, the rest, the rest's share, and the file and the rule with the most (ties: the smallest name)."""
    level = F.lower("severity")
    kind = F.when(level.isin("warn", "warning"), "warn").when(level == "error", "error").otherwise("info")
    # one pass to counts by file and rule, from which all else follows
    cells = findings.groupBy("file", "rule").agg(F.count("*").alias("n"), *(F.count_if(kind == k).alias(k) for k in ("error", "warn", "info")))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), *(F.coalesce(F.sum(k), F.lit(0)).alias(f"n_{k}") for k in ("error", "warn", "info")))
    most = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(c).alias("name"))).alias(f"top_{c}"))
    j = total.join(F.broadcast(most("file"))).join(F.broadcast(most("rule")))
    share = F.when(F.col("findings") > 0, F.round(F.col("n_info") / F.col("findings"), 3)).otherwise(0.0)
    return j.select(
        "findings", "n_error", "n_warn", "n_info", share.alias("noise_ratio"), F.col("top_file.name").alias("worst_file"), (-F.col("top_file.less")).alias("worst_n"), F.col("top_rule.name").alias("top_rule"), (-F.col("top_rule.less")).alias("top_n")
    )


def file_rules(findings: DataFrame) -> DataFrame:
    """(file, rules): how often each rule was found in a file, as a map."""
    cells = findings.groupBy("file", "rule").agg(F.count("*").alias("n"))
    return cells.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rules"))


def rollup(findings: DataFrame) -> DataFrame:
    """(kind, key, n) of annotated findings (with ``symbol``): by file, rule, severity (others than the known ones together) and symbol of a file, TOP_SYMBOLS of those; languages count files."""
    rule = F.substring(F.coalesce("rule", F.lit("unknown")), 1, LONGEST_RULE)
    level = F.lower(F.coalesce("severity", F.lit("")))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(entry("file", F.col("file")), entry("rule", rule), entry("severity", F.when(level.isin(*SEVERITIES), level).otherwise("unknown")), entry("symbol", F.concat("file", F.lit("#"), F.coalesce("symbol", F.lit("<unknown>")))))
    counts = findings.select(F.inline(keys)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    languages = findings.select("file").distinct().groupBy(_suffix(F.col("file")).alias("key")).agg(F.count("*").alias("n")).where("key <> ''").select(F.lit("language").alias("kind"), "key", "n")
    symbols = counts.where("kind = 'symbol'").orderBy(F.desc("n"), "key").limit(TOP_SYMBOLS)
    return counts.where("kind <> 'symbol'").unionByName(symbols).unionByName(languages)


def trend_report(calls: DataFrame, findings: Column, inside: Column, share: float = 0.2, top: int = TOP_NAMES) -> DataFrame:
    """(kind, key, n, rank): the window's most used tools and most found rules, and one row of kind ``trend``: up, down or flat at +-``share`` of the findings before it.

    calls: (tool, ...); ``findings``: the rules that a call found, an array; a tie goes to the smaller name.
    """
    rows = calls.select("tool", F.coalesce(findings, F.array().cast("array<string>")).alias("rules"), inside.alias("inside"))
    recent = rows.where("inside")
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.concat(F.array(entry("tool", F.col("tool"))), F.transform(F.filter("rules", lambda r: r.isNotNull()), lambda r: entry("rule", r)))
    counts = recent.select(F.inline(keys)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    first = first_by(counts, ["kind"], [F.desc("n"), F.col("key")], top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key")))
    n = F.size("rules")
    both = rows.agg(F.coalesce(F.sum(F.when(F.col("inside"), n)), F.lit(0)).alias("now"), F.coalesce(F.sum(F.when(~F.col("inside"), n)), F.lit(0)).alias("before"))
    way = (
        F.when(F.col("before") == 0, F.when(F.col("now") == 0, "flat").otherwise("up"))
        .when(F.col("now") > F.col("before") * (1 + share), "up").when(F.col("now") < F.col("before") * (1 - share), "down").otherwise("flat")
    )
    return ranked.unionByName(both.select(F.lit("trend").alias("kind"), way.alias("key"), F.col("now").alias("n"), F.lit(0).alias("rank")))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n), before anything is demoted."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def demoted(findings: DataFrame, weights: DataFrame, least: float = LEAST_WEIGHT) -> DataFrame:
    """The findings with suggestions of rules that weigh less than ``least`` made remarks (Info); a rule without a weight keeps its own."""
    light = weights.where(F.col("weight") < least).select("rule", F.lit(True).alias("_light")).distinct()
    j = findings.join(light, "rule", "left")
    return j.withColumn("severity", F.when((F.col("severity") == "Suggestion") & F.col("_light"), "Info").otherwise(F.col("severity"))).select(*findings.columns)
