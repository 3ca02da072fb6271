"""Collisions of tetrahedra made from parts: on a lattice, of sizes 1 to 7 and some of 40; some share a face's plane with their neighbour."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import collide as C
from weftwork.operators import mesh as M
from weftwork.plans.registry import query, table

_FACES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
#: Corner n of part k, as SQL over k, the size s and the lattice place.
_BASE = """
    p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN 40.0 ELSE p_partkey % 7 + 1.0 END::DOUBLE AS s, (p_partkey % 20) * 4.0::DOUBLE AS x, (p_partkey // 20 % 20) * 4.0::DOUBLE AS y, (p_partkey // 400) * 4.0::DOUBLE AS z FROM part),
    v AS (SELECT k, [[x, y, z], [x + s, y, CASE WHEN k % 3 = 0 THEN z ELSE z + 1 END], [x, y + s, z], [x + (k % 2), y + (k % 5), z + s]] AS c FROM p)"""
_SAT = f"""
    WITH {_BASE},
    f AS (SELECT k, unnest([0, 1, 2, 3]) AS fid, unnest([[c[1], c[2], c[3]], [c[1], c[2], c[4]], [c[1], c[3], c[4]], [c[2], c[3], c[4]]]) AS t FROM v),
    b AS (SELECT *, list_min([p[1] for p in t]) AS x0, list_max([p[1] for p in t]) AS x1, list_min([p[2] for p in t]) AS y0, list_max([p[2] for p in t]) AS y1, list_min([p[3] for p in t]) AS z0, list_max([p[3] for p in t]) AS z1,
          [[t[i % 3 + 1][1] - t[i][1], t[i % 3 + 1][2] - t[i][2], t[i % 3 + 1][3] - t[i][3]] for i in [1, 2, 3]] AS e FROM f),
    n AS (SELECT *, list_cross_product(e[1]::DOUBLE[3], e[2]::DOUBLE[3])::DOUBLE[] AS n FROM b),
    q AS (SELECT a.k AS a, b.k AS b, a.fid AS fa, b.fid AS fb, a.t AS p, b.t AS q,
          [a.n, b.n] || [array_cross_product(a.n::DOUBLE[3], x::DOUBLE[3])::DOUBLE[] for x in a.e] || [array_cross_product(b.n::DOUBLE[3], x::DOUBLE[3])::DOUBLE[] for x in b.e]
          || flatten([[array_cross_product(x::DOUBLE[3], y::DOUBLE[3])::DOUBLE[] for y in b.e] for x in a.e]) AS d
          FROM n a JOIN n b ON a.k < b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1
          WHERE list_dot_product(a.n, a.n) >= 1e-30 AND list_dot_product(b.n, b.n) >= 1e-30),
    h AS (SELECT a, b, fa, fb FROM q WHERE len(list_filter(d, lambda x: list_max([list_dot_product(c, x) for c in p]) < list_min([list_dot_product(c, x) for c in q]) OR list_max([list_dot_product(c, x) for c in q]) < list_min([list_dot_product(c, x) for c in p]))) = 0)""".replace("list_cross_product", "array_cross_product")


def _meshes(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.when(k % 97 == 0, 40.0).otherwise(k % 7 + 1.0)
    p = table(spark, sf_dir, "part").select(k.alias("mesh_id"), s.alias("s"), (k % 20 * 4.0).alias("x"), (F.floor(k / 20) % 20 * 4.0).alias("y"), (F.floor(k / 400) * 4.0).alias("z"))
    x, y, z, s, k = (F.col(c) for c in ("x", "y", "z", "s", "mesh_id"))
    at = [(x, y, z), (x + s, y, F.when(k % 3 == 0, z).otherwise(z + 1)), (x, y + s, z), (x + k % 2, y + k % 5, z + s)]
    v = p.select("mesh_id", F.posexplode(F.array(*(F.struct(*(c.cast("double").alias(n) for c, n in zip(q, "xyz", strict=True))) for q in at))).alias("vid", "c")).select("mesh_id", "vid", "c.*")
    f = p.select("mesh_id", F.posexplode(F.array(*(F.struct(*(F.lit(n).alias(c) for c, n in zip("abc", t, strict=True))) for t in _FACES))).alias("fid", "t")).select("mesh_id", "fid", "t.*")
    return v, f


@query("mesh_collisions", _SAT + " SELECT a, b, count(*) AS hits, min_by(fa, fa * 4 + fb) AS fa, min_by(fb, fa * 4 + fb) AS fb FROM h GROUP BY a, b")
def mesh_collisions(spark, sf_dir):
    return C.collisions(*_meshes(spark, sf_dir))


@query(
    "mesh_points_inside",
    f"""
    WITH {_BASE}
    SELECT CAST(k AS BIGINT) AS point_id, k % 4 <> 3 AND NOT (s = 1 AND k % 3 <> 0 AND k % 2 = 1) AS inside FROM p""",
)
def mesh_points_inside(spark, sf_dir):
    """The centre of each tetrahedron's corners, or for every fourth the mirror of it at a corner, which lies outside; flat ones hold nothing."""
    v, f = _meshes(spark, sf_dir)
    mean = v.groupBy("mesh_id").agg(*(F.avg(c).alias(c) for c in "xyz"), *(F.min_by(c, "vid").alias(f"o{c}") for c in "xyz"))
    outside = F.col("mesh_id") % 4 == 3
    return C.points_inside(mean.select(F.col("mesh_id").cast("long").alias("point_id"), "mesh_id", *(F.when(outside, 2 * F.col(f"o{c}") - F.col(c)).otherwise(F.col(c)).alias(c) for c in "xyz")), v, f)


@query("mesh_box_meets", f"WITH {_BASE} SELECT k AS mesh_id, list_min([p[1] for p in c]) <= 30 AND list_max([p[1] for p in c]) >= 10 AND list_min([p[2] for p in c]) <= 20 AND list_max([p[2] for p in c]) >= 5 AND list_min([p[3] for p in c]) <= 9 AND list_max([p[3] for p in c]) >= 2 AS colliding FROM v")
def mesh_box_meets(spark, sf_dir):
    return C.boxes_meet(M.bounds(_meshes(spark, sf_dir)[0]), ((10, 5, 2), (30, 20, 9)))
