"""Pairs of intervals: as brute force gives them, and made by more tasks than the few that read the table."""

import random

from pyspark.sql import functions as F

from weftwork.operators.relations import SLICE_PARTS, overlap_pairs


def test_overlaps_by_brute_force_in_many_tasks(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice("xy"), float(rng.randint(0, 60)), rng.randint(0, 5)) for k in range(300)] + [(300, None, "x", 1.0, 2), (301, "a", "x", None, 2), (302, "a", "x", 60.0, 0), (302, "a", "x", 60.0, 0)]
    df = spark.createDataFrame(rows, "k int, g string, h string, at double, size int").coalesce(1)
    got = overlap_pairs(df, "k", ["g", "h"], F.col("at"), F.col("at") + F.col("size"))
    whole = [r for r in rows if r[1] and r[3] is not None]
    want = sorted((a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1:3] == b[1:3] and a[3] <= b[3] + b[4] and b[3] <= a[3] + a[4])
    assert sorted(map(tuple, got.collect())) == want and want
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 10 and got.rdd.getNumPartitions() >= SLICE_PARTS
