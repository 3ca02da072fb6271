"""Graph questions over (src, dst) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.lineage import cut
from weftwork.operators.relations import hot_share, join_split


#: Rows of a search's front that are broadcast; more are joined by a shuffle.
MOST_FRONT = 1_000_000


def impact(edges: DataFrame, starts: DataFrame, depth: int = 3, most_depth: int = 6) -> DataFrame:
    """(id, depth): all that reach the starts against the edges' direction, with the least depth; the starts are left out.

    The edges are worked out once. Each round counts its front: a small one is broadcast to the edges, which then stay
    where they are.
    """
    back = cut(edges.select(F.col("dst").alias("id"), "src"))
    seen = cut(starts.select(F.col("id"), F.lit(0).alias("depth")).distinct())
    front, size = seen, seen.count()
    for d in range(1, min(depth, most_depth) + 1):
        own = front.select("id")
        step = back.join(F.broadcast(own) if size <= MOST_FRONT else own, "id").select(F.col("src").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        size = front.count()
        seen = seen.unionByName(front)
        if not size:
            break
    return seen.where("depth > 0")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) by alternating star contraction; a component is named by its smallest id, isolated ids are absent.

    Minima are aggregated before they are shuffled. They are held for the round that uses them; only where a
    vertex has a large share of the edges are they joined by ``join_split``, so that a hub's edges stay where they are.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    tally = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    lowest = lambda x: x.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    state = tally(e)
    for _ in range(most_rounds):
        most = 2 * state[0]

        def lowered(rows: DataFrame, low: DataFrame) -> DataFrame:
            hub = (low.agg(F.max("n")).first()[0] or 0) > hot_share(most)  # noqa: B023
            return join_split(rows, low, "a", "n", most) if hub else rows.join(low, "a")  # noqa: B023

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both).select("a", F.least("a", "m").alias("m"), "n").persist()
        large = lowered(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().persist()
        next_low = lowest(large).persist()
        small = lowered(large, next_low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(next_low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tally(e)
        for held in (low, large, next_low):
            held.unpersist()
        if now == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def communities(edges: DataFrame) -> DataFrame:
    """(component, size, internal, density): density is internal edges over n(n-1), 1 at most; larger ones first by size, then name."""
    c = components(edges)
    size = c.groupBy("component").agg(F.count("*").alias("size"))
    inside = edges.join(c.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("internal"))
    n = F.col("size")
    return size.join(inside, "component", "left").select("component", "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.least(F.coalesce("internal", F.lit(0)) / (n * (n - 1)), F.lit(1.0)).alias("density"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): a called name is the symbol of its own file, else the smallest id of any file, else ``?::`` and the name. No self loops."""
    local = symbols.select("file", "name", F.col("id").alias("own"))
    anywhere = symbols.groupBy("name").agg(F.min("id").alias("any"))
    j = calls.join(local, ["file", "name"], "left").join(anywhere, "name", "left")
    return j.select("src", F.coalesce("own", "any", F.concat(F.lit("?::"), F.col("name"))).alias("dst")).where("src <> dst").distinct()
