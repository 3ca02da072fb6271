"""Folds over ordered events, and bandit selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators.relations import first_by


def ordered_fold(events: DataFrame, key: str, order: list[str], value: Column, start: Column, step) -> DataFrame:
    """(key, state) of a fold over each key's values in order. Order matters where steps clamp, so no sum can stand for it."""
    rows = events.select(key, F.struct(*order, value.alias("_v")).alias("_e")).groupBy(key).agg(F.array_sort(F.collect_list("_e")).alias("_es"))
    return rows.select(key, F.aggregate("_es", start, lambda s, e: step(s, e["_v"])).alias("state"))


def lesson_utility(events: DataFrame, key: str, order: list[str], delta: str, archive_below: float = 0.1) -> DataFrame:
    """(key, utility, recall, archived): from 0.5, each delta added and clamped to 0..1; archived once below the bound, for good."""
    start = F.struct(F.lit(0.5).alias("u"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("gone"))

    def step(s, d):
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["u"] + d))
        return F.struct(u.alias("u"), (s["n"] + 1).alias("n"), (s["gone"] | (u < archive_below)).alias("gone"))

    return ordered_fold(events, key, order, F.col(delta).cast("double"), start, step).select(key, F.col("state.u").alias("utility"), F.col("state.n").alias("recall"), F.col("state.gone").alias("archived"))


def rule_weight(events: DataFrame, key: str, order: list[str], delta: str, adopted: Column) -> DataFrame:
    """(key, weight): from 1, plus the delta when adopted and minus its size when ignored, clamped to 0..3."""
    change = F.when(adopted, F.col(delta)).otherwise(-F.abs(F.col(delta))).cast("double")
    clamp = lambda s, d: F.greatest(F.lit(0.0), F.least(F.lit(3.0), s + d))
    return ordered_fold(events, key, order, change, F.lit(1.0), clamp).withColumnRenamed("state", "weight")


def backprop(rewards: DataFrame, node: str, reward: str) -> DataFrame:
    """(node, reward_sum, visits) with rewards clamped to -1..1."""
    return rewards.groupBy(node).agg(F.sum(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(reward)))).alias("reward_sum"), F.count("*").alias("visits"))


def ucb_select(nodes: DataFrame, parent: str, c: float = 1.414) -> DataFrame:
    """The child to visit of each parent: unvisited first, then reward mean plus bonus; ties by id.

    nodes: (id, parent, reward_sum, visits).
    """
    total = nodes.groupBy(parent).agg(F.greatest(F.lit(1), F.sum("visits")).alias("total"))
    v = F.col("visits")
    score = F.when(v == 0, F.lit(float("inf"))).otherwise(F.col("reward_sum") / v + F.lit(c) * F.sqrt(F.log("total")) / F.sqrt(v))
    return first_by(nodes.join(total, parent).withColumn("score", score), [parent], [F.desc("score"), F.col("id")]).select(parent, "id", "score")


def recall_order(lessons: DataFrame, limit: int) -> DataFrame:
    """Lessons that are not archived, by utility plus a bonus for recalls, then utility, then id."""
    hub = F.col("utility") + F.least(F.col("recall"), F.lit(10)) * F.lit(0.015)
    return lessons.where("NOT archived").withColumn("hub", hub).orderBy(F.desc("hub"), F.desc("utility"), "id").limit(limit)
