"""Clipping, union and relations of the boxes of ``plans/meshes``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import mesh as M
from weftwork.operators import mesh_cut as K
from weftwork.operators.lineage import cut, shuffled
from weftwork.plans.meshes import _boxes
from weftwork.plans.registry import query, table


def _planes(spark, sf_dir):
    """By number: across the first quarter of the width, along the diagonal of width and height, or beside the box."""
    k, w, o = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_partkey") % 500 * 3.0
    of = lambda *x: F.element_at(F.array(*(F.lit(v) if isinstance(v, float) else v for v in x)), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("mesh_id"), of(1.0, 2.0, 0.0).alias("pa"), F.lit(0.0).alias("pb"), of(0.0, -w, 1.0).alias("pc"), of(-(o + w / 4), -2 * o, 1.0).alias("pd"))


@query(
    "mesh_clip_volumes",
    """
    SELECT p_partkey AS mesh_id, round(v * ([0.75, 0.5, 1.0])[1 + p_partkey % 3], 6) AS kept, round(v * ([0.25, 0.5, 0.0])[1 + p_partkey % 3], 6) AS rest, true AS closed
    FROM (SELECT p_partkey, p_size * (p_partkey % 7 + 1) * 2.0::DOUBLE AS v FROM part)""",
)
def mesh_clip_volumes(spark, sf_dir):
    """Volumes of both parts, closed by caps; whether every edge of both has two faces."""
    v, f = _boxes(spark, sf_dir)
    planes = _planes(spark, sf_dir)
    sides = []
    for name, keep in (("kept", True), ("rest", False)):
        cv, cf = map(cut, K.clip(v, f, planes, keep, cap=True))
        size = M.mass(cv, cf).select("mesh_id", F.round("volume", 6).alias(name))
        sides.append(size.join(shuffled(M.check(cv, cf).select("mesh_id", F.col("closed").alias(f"{name}_closed"))), "mesh_id"))
    j = planes.select("mesh_id").join(shuffled(sides[0]), "mesh_id", "left").join(shuffled(sides[1]), "mesh_id", "left")
    return j.select("mesh_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("kept", "rest")), (F.coalesce("kept_closed", F.lit(True)) & F.coalesce("rest_closed", F.lit(True))).alias("closed"))


@query("mesh_clip_counts", "SELECT p_partkey AS mesh_id, CAST(([8, 2, 0])[1 + p_partkey % 3] AS BIGINT) AS split_vertices, CAST(([10, 8, 0])[1 + p_partkey % 3] AS BIGINT) AS cut_faces FROM part")
def mesh_clip_counts(spark, sf_dir):
    return K.clip_counts(*_boxes(spark, sf_dir), _planes(spark, sf_dir)).select("mesh_id", "split_vertices", "cut_faces")


@query(
    "mesh_union",
    """
    WITH p AS (SELECT p_partkey AS k, p_partkey // 500 * 500 + p_partkey % 500 // 5 * 5 AS g, p_partkey % 500 * 3.0::DOUBLE AS o, p_size::DOUBLE AS w, p_partkey % 7 + 1 AS d FROM part),
    v AS (SELECT DISTINCT g, o + x * w AS x, y * d AS y, z * 2 AS z FROM p, (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z))
    SELECT g AS mesh_id, n_vertices, n_faces FROM (SELECT g, count(*) AS n_vertices FROM v GROUP BY g) JOIN (SELECT g, count(*) * 12 AS n_faces FROM p GROUP BY g) USING (g)""",
)
def mesh_union(spark, sf_dir):
    """Five neighbouring boxes each become one mesh; corners that meet become one."""
    k = F.col("p_partkey")
    groups = table(spark, sf_dir, "part").select(k.alias("mesh_id"), (F.floor(k / 500) * 500 + F.floor(k % 500 / 5) * 5).alias("into"))
    v, f = K.union(*_boxes(spark, sf_dir), groups)
    return v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")).join(shuffled(f.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))), "mesh_id")


@query(
    "mesh_relations",
    """
    WITH p AS (SELECT p_partkey AS k, p_partkey % 500 * 3.0::DOUBLE AS lo, p_partkey % 500 * 3.0::DOUBLE + p_size AS hi, p_partkey % 7 + 1 AS d FROM part),
    j AS (SELECT a.k AS a, b.k AS b, a.lo AS al, a.hi AS ah, a.d AS ad, b.lo AS bl, b.hi AS bh, b.d AS bd FROM p a JOIN p b ON b.k = a.k + 1)
    SELECT a, b, CASE WHEN al > bh OR bl > ah THEN 'separate' WHEN (al <= bl AND bh <= ah AND bd <= ad) OR (bl <= al AND ah <= bh AND ad <= bd) THEN 'contained' ELSE 'overlapping' END AS relation FROM j""",
)
def mesh_relations(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    pairs = parts.select(k.alias("a"), (k + 1).alias("b")).join(shuffled(parts.select(k.alias("b"))), "b", "left_semi")
    return K.relations(*_boxes(spark, sf_dir), pairs).select("a", "b", "relation")
