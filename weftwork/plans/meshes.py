"""Mesh queries on boxes made from parts: part p is a box of p_size x (p mod 7 + 1) x 2, in 8 vertices and 12 faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import mesh as M
from weftwork.plans.registry import query, table

#: Faces of a box over vertices numbered by the bits z, y, x.
FACES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def _boxes(spark, sf_dir, height=2.0):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 7 + 1).cast("double").alias("d"), (F.col("p_partkey") % 500 * 3.0).alias("o"))
    bit = lambda k: F.shiftright("vid", k) % 2
    v = p.withColumn("vid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    v = v.select("mesh_id", "vid", (F.col("o") + bit(0) * F.col("w")).alias("x"), (bit(1) * F.col("d")).alias("y"), (bit(2) * F.lit(height)).alias("z"))
    f = p.select("mesh_id", F.posexplode(F.array(*(F.struct(*(F.lit(n).alias(k) for k, n in zip("abc", t, strict=True))) for t in FACES))).alias("fid", "t")).select("mesh_id", "fid", "t.*")
    return v, f


@query("mesh_bounds", "SELECT p_partkey AS mesh_id, p_partkey % 500 * 3.0::DOUBLE AS min_x, p_partkey % 500 * 3.0::DOUBLE + p_size AS max_x, round(sqrt(p_size * p_size + (p_partkey % 7 + 1) * (p_partkey % 7 + 1) + 4) / 2, 9) AS radius FROM part")
def mesh_bounds(spark, sf_dir):
    return M.bounds(_boxes(spark, sf_dir)[0]).select("mesh_id", "min_x", "max_x", F.round("radius", 9).alias("radius"))


@query("mesh_mass", "SELECT p_partkey AS mesh_id, round(p_size * (p_partkey % 7 + 1) * 2.0::DOUBLE, 6) AS volume, round(2.0::DOUBLE * (p_size * (p_partkey % 7 + 1) + 2 * p_size + 2 * (p_partkey % 7 + 1)), 6) AS area, round(p_partkey % 500 * 3.0::DOUBLE + p_size / 2, 6) AS cx FROM part")
def mesh_mass(spark, sf_dir):
    return M.mass(*_boxes(spark, sf_dir)).select("mesh_id", *(F.round(c, 6).alias(c) for c in ("volume", "area", "cx")))


_CORNER = ", ".join(f"o + {'w' if n & 1 else '0'} AS x{n}, {'d' if n & 2 else '0'} AS y{n}, {'2.0' if n & 4 else '0'} AS z{n}" for n in range(8))
_MOMENTS = {"ixx": "yy + zz", "iyy": "xx + zz", "izz": "xx + yy", "ixy": "xy", "ixz": "xz", "iyz": "yz"}


def _sum(c: str, d: str, t: tuple) -> str:
    return "(" + " + ".join(f"{c}{n} * {d}{n}" for n in t) + ")"


_DETS = " UNION ALL ".join(
    f"SELECT k, x{a} * (y{b} * z{c} - z{b} * y{c}) - y{a} * (x{b} * z{c} - z{b} * x{c}) + z{a} * (x{b} * y{c} - y{b} * x{c}) AS det, " + ", ".join(f"{_sum(c1, c2, (a, b, c))} AS {c1}{c2}" for c1, c2 in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM v"
    for a, b, c in FACES
)


@query(
    "mesh_inertia",
    f"""
    WITH v AS (SELECT k, {_CORNER} FROM (SELECT p_partkey AS k, p_partkey % 500 * 3.0::DOUBLE AS o, p_size::DOUBLE AS w, (p_partkey % 7 + 1)::DOUBLE AS d FROM part)), t AS ({_DETS})
    SELECT k AS mesh_id, {", ".join(f"round(sign(sum(det)) * sum(det * ({m}) / 24), 4) AS {n}" for n, m in _MOMENTS.items())} FROM t GROUP BY k""",
)
def mesh_inertia(spark, sf_dir):
    return M.inertia(*_boxes(spark, sf_dir)).select("mesh_id", *(F.round(c, 4).alias(c) for c in _MOMENTS))


@query("mesh_check", "SELECT p_partkey AS mesh_id, 18::BIGINT AS n_edges, 0::BIGINT AS boundary, 0::BIGINT AS non_manifold, 0::BIGINT AS isolated, true AS closed, 2::BIGINT AS euler FROM part")
def mesh_check(spark, sf_dir):
    return M.check(*_boxes(spark, sf_dir)).select("mesh_id", "n_edges", "boundary", "non_manifold", "isolated", "closed", "euler")


@query("mesh_overlaps", """
    WITH b AS (SELECT p_partkey AS id, p_partkey % 500 * 3.0::DOUBLE AS lo, p_partkey % 500 * 3.0::DOUBLE + p_size AS hi FROM part)
    SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND p.lo <= q.hi AND q.lo <= p.hi""")
def mesh_overlaps(spark, sf_dir):
    return M.box_overlaps(M.bounds(_boxes(spark, sf_dir)[0]), 50.0)


@query("mesh_half_edges", "SELECT p_partkey AS mesh_id, 36::BIGINT AS n, 0::BIGINT AS boundary FROM part")
def mesh_half_edges(spark, sf_dir):
    return M.half_edges(_boxes(spark, sf_dir)[1]).groupBy("mesh_id").agg(F.count("*").alias("n"), F.count_if("boundary").alias("boundary"))


@query("mesh_pattern", "SELECT p_partkey AS mesh_id, 48::BIGINT AS n, round(p_partkey % 500 * 3.0::DOUBLE + p_size + 20, 9) AS max_x FROM part")
def mesh_pattern(spark, sf_dir):
    return M.array_pattern(_boxes(spark, sf_dir)[0], (3, 2, 1), (10.0, 5.0, 1.0)).groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.max("x"), 9).alias("max_x"))


@query("mesh_splats", "SELECT p_partkey AS mesh_id, 12::BIGINT AS n, round(2.0::DOUBLE * (p_size * (p_partkey % 7 + 1) + 2 * p_size + 2 * (p_partkey % 7 + 1)), 6) AS area, 0.0::DOUBLE AS sum_nx FROM part")
def mesh_splats(spark, sf_dir):
    s = M.splats(*_boxes(spark, sf_dir))
    return s.groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("nx"), 6).alias("sum_nx"))


@query("mesh_rays", "SELECT p_partkey AS ray_id, round(p_partkey % 500 * 3.0::DOUBLE + 10, 9) AS t FROM part")
def mesh_rays(spark, sf_dir):
    v, f = _boxes(spark, sf_dir)
    rays = v.where("vid = 0").select(F.col("mesh_id").alias("ray_id"), "mesh_id", F.lit(-10.0).alias("ox"), F.lit(0.31).alias("oy"), F.lit(0.77).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return M.ray_hits(rays, v, f).select("ray_id", F.round("t", 9).alias("t"))


@query("mesh_voxels", "SELECT p_partkey AS mesh_id, CAST(p_size * (p_partkey % 7 + 1) * 2 AS BIGINT) AS n FROM part")
def mesh_voxels(spark, sf_dir):
    return M.voxels(*_boxes(spark, sf_dir), 1.0).groupBy("mesh_id").agg(F.count("*").alias("n"))


@query("mesh_surface_voxels", "SELECT p_partkey AS mesh_id, CAST(p_size * (p_partkey % 7 + 1) * 3 - greatest(p_size - 2, 0) * greatest(p_partkey % 7 - 1, 0) AS BIGINT) AS n FROM part")
def mesh_surface_voxels(spark, sf_dir):
    return M.surface_voxels(*_boxes(spark, sf_dir, 3.0), 1.0).groupBy("mesh_id").agg(F.count("*").alias("n"))


@query("mesh_skin", "SELECT p_partkey AS mesh_id, round(p_partkey % 500 * 3.0::DOUBLE + p_size + 2.5, 6) AS max_x FROM part")
def mesh_skin(spark, sf_dir):
    v, _ = _boxes(spark, sf_dir)
    w = v.select("mesh_id", "vid", F.explode(F.array(F.struct(F.lit(1).alias("bone"), F.lit(1.0).alias("w")), F.struct(F.lit(2).alias("bone"), F.lit(3.0).alias("w")))).alias("p")).select("mesh_id", "vid", "p.*")
    bones = spark.createDataFrame([(1, 10.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "bone int, tx double, ty double, tz double")
    return M.skin(v, w, bones).groupBy("mesh_id").agg(F.max("x").alias("max_x"))
