"""Meshes at size: work that grows faster than its rows is dealt to many tasks, and nothing that was multiplied is shuffled."""

import itertools
import random

from pyspark.sql import functions as F

from weftwork.operators import mesh as M
from weftwork.operators.relations import SLICE_PARTS
from weftwork.plans.meshes import FACES


def test_box_overlaps_by_brute_force_in_many_tasks(spark):
    rng = random.Random(3)
    lows = [[float(rng.randint(-30, 60)) for _ in "xyz"] for _ in range(250)]
    rows = [(k, *(v for x in low for v in (x, x + rng.randint(0, 40)))) for k, low in enumerate(lows)]
    df = spark.createDataFrame(rows, "mesh_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double").coalesce(1)
    got = M.box_overlaps(df, 7.0)
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and all(p[k] <= q[k + 1] and q[k] <= p[k + 1] for k in (1, 3, 5)))
    assert sorted(map(tuple, got.collect())) == want and want
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 10 and got.rdd.getNumPartitions() >= SLICE_PARTS


def test_surface_voxels_by_brute_force_over_blocks(spark):
    sizes = {1: (70, 3, 4), 2: (2, 66, 3), 3: (1, 1, 1), 4: (5, 4, 6), 5: (65, 65, 3)}
    bits = [(n & 1, n >> 1 & 1, n >> 2 & 1) for n in range(8)]
    at = {1: (60, 0, 0), 2: (-3, -65, -2), 3: (0, 0, 0), 4: (62, 61, 5), 5: (-1, -1, 0)}
    v = [(m, n, *(float(at[m][x] + bits[n][x] * sizes[m][x]) for x in range(3))) for m in sizes for n in range(8)]
    # a box within box 4 makes it hollow, so that its columns have two runs
    v += [(4, 8 + n, *(float(at[4][x] + 1 + bits[n][x] * (sizes[4][x] - 2)) for x in range(3))) for n in range(8)]
    f = [(m, k, *t) for m in sizes for k, t in enumerate(FACES)] + [(4, 12 + k, *(8 + n for n in t)) for k, t in enumerate(FACES)]
    vertices, faces = spark.createDataFrame(v, "mesh_id int, vid int, x double, y double, z double"), spark.createDataFrame(f, "mesh_id int, fid int, a int, b int, c int")
    cells = {(m, *(at[m][x] + c[x] for x in range(3))) for m in sizes for c in itertools.product(*map(range, sizes[m]))}
    cells -= {(4, *(at[4][x] + c[x] for x in range(3))) for c in itertools.product(*(range(1, n - 1) for n in sizes[4]))}
    assert {tuple(r) for r in M.voxels(vertices, faces, 1.0).collect()} == cells
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    want = sorted((m, i, j, k) for m, i, j, k in cells if not all((m, i + x, j + y, k + z) in cells for x, y, z in steps))
    got = M.surface_voxels(vertices, faces, 1.0)
    assert sorted(map(tuple, got.collect())) == want and len(want) < len(cells)
    # the last that is shuffled are faces, dealt to blocks: neither columns nor cells
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert next(x for x in plan[plan.index("AdaptiveSparkPlan") :].splitlines() if "Exchange" in x).count("REPARTITION_BY_NUM") == 1
