"""Clipping of meshes by planes, union with welding, and how the boxes and faces of two meshes lie to each other.

A face is clipped by a fold over its three corners. A new vertex is named by the edge that it lies on and worked
out from that edge's lower end, so both faces of the edge give the same vertex without being joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators import collide, lineage
from weftwork.operators.lineage import shuffled
from weftwork.operators.mesh import bounds, corners

_XYZ = "xyz"
_POINT = "struct<vid:bigint,x:double,y:double,z:double,on:boolean>"


def _sided(vertices: DataFrame, faces: DataFrame, planes: DataFrame, sign: float) -> DataFrame:
    """Faces with corners a, b, c as structs (vid, x, y, z, s): s is positive on the side that is kept. ``base`` is above every vertex number."""
    finite = F.lit(True)
    for c in ("pa", "pb", "pc", "pd"):
        finite &= F.abs(F.col(c)) < F.lit(float("inf"))
    good = planes.where(finite)
    s = F.lit(sign) * (F.col("pa") * F.col("x") + F.col("pb") * F.col("y") + F.col("pc") * F.col("z") + F.col("pd"))
    v = vertices.join(shuffled(good), "mesh_id").select("mesh_id", F.struct(F.col("vid").cast("long").alias("vid"), *(F.col(c).cast("double").alias(c) for c in _XYZ), s.cast("double").alias("s")).alias("v"))
    base = vertices.groupBy("mesh_id").agg((F.max("vid").cast("long") + 1).alias("base"))
    out = faces.join(shuffled(base), "mesh_id")
    for k in "abc":
        out = out.join(shuffled(v.select("mesh_id", F.col("v.vid").alias(k), F.col("v").alias(f"_{k}"))), ["mesh_id", k])
    return out.select("mesh_id", "fid", "base", *(F.col(f"_{k}").alias(k) for k in "abc"))


def _point(v: Column) -> Column:
    return F.struct(v["vid"].alias("vid"), *(v[c].alias(c) for c in _XYZ), (v["s"] == 0).alias("on")).cast(_POINT)


def _between(u: Column, v: Column, base: Column) -> Column:
    """The vertex at which the edge of u and v meets the plane."""
    turned = u["vid"] > v["vid"]
    low, high = ({c: F.when(turned, q[c]).otherwise(p[c]) for c in ("vid", "s", *_XYZ)} for p, q in ((u, v), (v, u)))
    t = low["s"] / (low["s"] - high["s"])
    return F.struct((base + low["vid"] * base + high["vid"]).alias("vid"), *((low[c] + t * (high[c] - low[c])).alias(c) for c in _XYZ), F.lit(True).alias("on")).cast(_POINT)


def clip(vertices: DataFrame, faces: DataFrame, planes: DataFrame, keep_positive: bool = True, cap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of what lies on one side of each mesh's plane: planes (mesh_id, pa, pb, pc, pd), pa x + pb y + pc z + pd = 0.

    Vertices on the plane count as kept and split nothing. Face f becomes faces 2f and 2f+1; the new vertex of
    edge u < v is number N + uN + v, where N is one more than the mesh's largest. With ``cap`` the hole is closed by a
    fan around the mean of its rim (vertex -1, faces of negative numbers), so that a closed mesh stays closed. Meshes without a plane, and
    planes with a coefficient that is not finite, give nothing.
    """
    t = _sided(vertices, faces, planes, 1.0 if keep_positive else -1.0)
    ring = []
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        u, v = F.col(p), F.col(q)
        crosses = ((u["s"] > 0) & (v["s"] < 0)) | ((u["s"] < 0) & (v["s"] > 0))
        ring += [F.when(u["s"] >= 0, F.array(_point(u))).otherwise(F.array().cast(f"array<{_POINT}>")), F.when(crosses, F.array(_between(u, v, F.col("base")))).otherwise(F.array().cast(f"array<{_POINT}>"))]
    cut = lineage.cut(t.select("mesh_id", "fid", F.concat(*ring).alias("p")).where(F.size("p") >= 3))
    fan = F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda j: F.struct((F.col("fid").cast("long") * 2 + j - 1).alias("fid"), F.col("p")[0]["vid"].alias("a"), F.get("p", j)["vid"].alias("b"), F.get("p", j + 1)["vid"].alias("c")))
    new_faces = cut.select("mesh_id", F.inline(fan))
    new_vertices = cut.select("mesh_id", F.inline("p")).groupBy("mesh_id", "vid").agg(*(F.first(c).alias(c) for c in _XYZ))
    if not cap:
        return new_vertices, new_faces
    n = F.size("p")
    rim = cut.select("mesh_id", F.explode(F.transform("p", lambda x, i: F.struct(x.alias("u"), F.get("p", (i + 1) % n).alias("v")))).alias("e")).where("e.u.on AND e.v.on")
    rim = rim.select("mesh_id", F.col("e.u.vid").alias("u"), F.col("e.v.vid").alias("v"), *(((F.col(f"e.u.{c}") + F.col(f"e.v.{c}")) / 2).alias(c) for c in _XYZ))
    # an edge in the plane with kept faces on both sides is no rim
    rim = rim.join(shuffled(rim.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")).distinct()), ["mesh_id", "u", "v"], "left_anti")
    middle = rim.groupBy("mesh_id").agg(*(F.avg(c).alias(c) for c in _XYZ)).select("mesh_id", F.lit(-1).cast("long").alias("vid"), *_XYZ)
    base = vertices.groupBy("mesh_id").agg((F.max("vid").cast("long") + 1).alias("base"))
    number = -(F.col("u") * (F.col("base") * (F.col("base") + 1)) + F.col("v") + 1)
    lids = rim.join(shuffled(base), "mesh_id").select("mesh_id", number.alias("fid"), F.col("v").alias("a"), F.col("u").alias("b"), F.lit(-1).cast("long").alias("c"))
    return new_vertices.unionByName(middle), new_faces.unionByName(lids)


def clip_counts(vertices: DataFrame, faces: DataFrame, planes: DataFrame, keep_positive: bool = True) -> DataFrame:
    """(mesh_id, faces, split_vertices, cut_faces): faces that result, new vertices, and faces that lost something or went."""
    t = _sided(vertices, faces, planes, 1.0 if keep_positive else -1.0)
    s = F.array(*(F.col(k)["s"] for k in "abc"))
    cut = t.groupBy("mesh_id").agg(F.count_if(F.array_min(s) < 0).alias("cut_faces"))
    v, f = clip(vertices, faces, planes, keep_positive)
    base = vertices.groupBy("mesh_id").agg((F.max("vid").cast("long") + 1).alias("base"))
    new = v.join(shuffled(base), "mesh_id").groupBy("mesh_id").agg(F.count_if(F.col("vid") >= F.col("base")).alias("split_vertices"))
    left = f.groupBy("mesh_id").agg(F.count("*").alias("faces"))
    j = cut.join(shuffled(new), "mesh_id", "left").join(shuffled(left), "mesh_id", "left").na.fill(0)
    return j.select("mesh_id", "faces", "split_vertices", "cut_faces")


def union(vertices: DataFrame, faces: DataFrame, groups: DataFrame, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one mesh for each group of ``groups`` (mesh_id, into): vertices at one place (rounded) become one, whatever mesh they come from.

    A vertex is named by the smallest (mesh, vertex) at its place and stands where that one stands; faces keep their mesh and number as ``part``.
    """
    place = [F.round(c, digits).alias(f"_{c}") for c in _XYZ]
    at = vertices.join(shuffled(groups), "mesh_id").select("into", "mesh_id", F.col("vid"), *_XYZ, *place)
    key = F.struct("mesh_id", "vid")
    low = at.groupBy("into", "_x", "_y", "_z").agg(F.min(F.struct(key.alias("id"), *_XYZ)).alias("v"))
    move = at.join(shuffled(low), ["into", "_x", "_y", "_z"]).select("mesh_id", F.col("vid"), "into", F.col("v.id").alias("to"))
    out = faces
    for k in "abc":
        out = out.join(shuffled(move.select("mesh_id", F.col("vid").alias(k), "into", F.col("to").alias(f"_{k}"))), ["mesh_id", k] if k == "a" else ["mesh_id", k, "into"])
    return (
        low.select(F.col("into").alias("mesh_id"), F.col("v.id").alias("vid"), *(F.col(f"v.{c}").alias(c) for c in _XYZ)),
        out.select(F.col("into").alias("mesh_id"), F.struct("mesh_id", "fid").alias("part"), *(F.col(f"_{k}").alias(k) for k in "abc")),
    )


def relations(vertices: DataFrame, faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, relation, faces_inside) of pairs (a, b): separate, contained or overlapping by their boxes; of those that overlap, how many of a's faces have their centre in b."""
    box = bounds(vertices)
    side = lambda k: box.select(F.col("mesh_id").alias(k), *(F.col(f"{m}_{c}").alias(f"{k}_{m}_{c}") for m in ("min", "max") for c in _XYZ))
    j = pairs.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b")
    every = lambda f: f("x") & f("y") & f("z")
    meets = every(lambda c: (F.col(f"a_min_{c}") <= F.col(f"b_max_{c}")) & (F.col(f"b_min_{c}") <= F.col(f"a_max_{c}")))
    holds = lambda p, q: every(lambda c: (F.col(f"{p}_min_{c}") <= F.col(f"{q}_min_{c}")) & (F.col(f"{q}_max_{c}") <= F.col(f"{p}_max_{c}")))
    related = j.select("a", "b", F.when(~meets, "separate").when(holds("a", "b") | holds("b", "a"), "contained").otherwise("overlapping").alias("relation"))
    centre = [((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(c) for c in _XYZ]
    own = corners(vertices, faces).select(F.col("mesh_id").alias("a"), "fid", *centre)
    asked = related.where("relation = 'overlapping'").join(shuffled(own), "a").select(F.struct("a", "b", "fid").alias("point_id"), F.col("b").alias("mesh_id"), *_XYZ)
    inside = collide.points_inside(asked, vertices, faces).groupBy(F.col("point_id.a").alias("a"), F.col("point_id.b").alias("b")).agg(F.count_if("inside").alias("faces_inside"))
    return related.join(shuffled(inside), ["a", "b"], "left").select("a", "b", "relation", F.coalesce("faces_inside", F.lit(0)).alias("faces_inside"))
