"""Collision of meshes: which triangles of different meshes meet, points inside meshes, and boxes that meet.

Broad phase: a triangle lies on a level by its size, where it covers at most eight cells of a grid as coarse as
itself, and is dealt to the cells it covers on that level and all coarser ones that occur. A pair is tried on the
coarser of its two levels, in the one cell that holds the lower corner of both boxes' common part, so it
is tried once and sizes may differ as they like. Narrow phase, as column expressions: two triangles are
apart just if some direction separates them, and the normals, the products of their edges and the edges' normals in
their planes are all the directions that need trying. Triangles that touch meet; one without area meets nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators.lineage import shuffled
from weftwork.operators.mesh import corners

#: Squared length of a normal below which a triangle has no area.
FLAT = 1e-30

_XYZ = "xyz"


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _minus(p: Column, q: Column) -> Column:
    return _vector(*(p[c] - q[c] for c in _XYZ))


def _cross(p: Column, q: Column) -> Column:
    return _vector(p["y"] * q["z"] - p["z"] * q["y"], p["z"] * q["x"] - p["x"] * q["z"], p["x"] * q["y"] - p["y"] * q["x"])


def _dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, p, lo_x .. hi_z): the corners as an array, and the box; triangles without area are left out."""
    c = corners(vertices, faces)
    p = F.array(*(_vector(*(F.col(k + x).cast("double") for x in _XYZ)) for k in "abc"))
    t = c.select("mesh_id", "fid", p.alias("p"))
    t = t.withColumn("n", _cross(*(_minus(F.col("p")[(k + 1) % 3], F.col("p")[k]) for k in range(2)))).where(_dot(F.col("n"), F.col("n")) >= FLAT)
    side = lambda f, x: f(*(F.col("p")[k][x] for k in range(3)))
    return t.select("mesh_id", "fid", "p", *(side(f, x).alias(f"{name}_{x}") for name, f in (("lo", F.least), ("hi", F.greatest)) for x in _XYZ))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _directed(t: Column) -> Column:
    """A row of ``triangles`` with its edges e and own directions d (normal, edges' normals in the plane): worked out where pairs are tried, so that they aren't shuffled."""
    edges = F.array(*(_minus(t["p"][(k + 1) % 3], t["p"][k]) for k in range(3)))
    own = lambda e, n: F.struct(t["p"].alias("p"), e.alias("e"), F.array(n, *(_cross(n, e[k]) for k in range(3))).alias("d"))
    return _let(edges, lambda e: _let(_cross(e[0], e[1]), lambda n: own(e, n)))


def meet(a: Column, b: Column) -> Column:
    """Whether two rows of ``triangles`` have a point in common."""
    return _let(_directed(a), lambda p: _let(_directed(b), lambda q: _meet(p, q)))


def _meet(a: Column, b: Column) -> Column:
    def apart(d: Column) -> Column:
        p, q = ([_dot(t["p"][k], d) for k in range(3)] for t in (a, b))
        return (F.greatest(*p) < F.least(*q)) | (F.greatest(*q) < F.least(*p))

    products = F.array(*(_cross(a["e"][i], b["e"][j]) for i in range(3) for j in range(3)))
    return ~(F.exists(a["d"], apart) | F.exists(b["d"], apart) | F.exists(products, apart))


def _dealt(t: DataFrame, levels: list[int]) -> DataFrame:
    """The triangles in every cell that they cover on their own level and coarser ones."""
    size = F.greatest(*(F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in _XYZ))
    own = F.ceil(F.log2(size)).cast("int")
    t = t.withColumn("own", own).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("own"))))
    edge = F.pow(F.lit(2.0), F.col("level"))
    for x in _XYZ:
        t = t.withColumn(f"c_{x}", F.explode(F.sequence(F.floor(F.col(f"lo_{x}") / edge), F.floor(F.col(f"hi_{x}") / edge))))
    return t


def box_pairs(t: DataFrame) -> DataFrame:
    """(a, b): structs of triangles of different meshes whose boxes meet, each pair once, that of the smaller mesh first."""
    size = F.greatest(*(F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in _XYZ))
    levels = sorted(r[0] for r in t.select(F.ceil(F.log2(size)).cast("int").alias("own")).distinct().collect())  # powers of two in the data: some tens
    if not levels:
        empty = F.struct(*t.columns)
        return t.select(empty.alias("a"), empty.alias("b"))
    dealt = _dealt(t, levels)
    cell = ["level", *(f"c_{x}" for x in _XYZ)]
    side = lambda rows, name: rows.select(*cell, F.struct("own", *t.columns).alias(name))
    # a lies on the pair's level, b there or on a finer one
    a, b = side(dealt.where("own = level"), "a"), side(dealt, "b")
    edge = F.pow(F.lit(2.0), F.col("level"))
    on = (F.col("a.mesh_id") < F.col("b.mesh_id")) | ((F.col("a.mesh_id") > F.col("b.mesh_id")) & (F.col("b.own") < F.col("level")))
    for x in _XYZ:
        on &= (F.col(f"a.lo_{x}") <= F.col(f"b.hi_{x}")) & (F.col(f"b.lo_{x}") <= F.col(f"a.hi_{x}"))
        on &= F.floor(F.greatest(f"a.lo_{x}", f"b.lo_{x}") / edge) == F.col(f"c_{x}")
    turned = F.col("a.mesh_id") > F.col("b.mesh_id")
    return a.join(shuffled(b), cell).where(on).select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def triangle_hits(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(a, b, fa, fb): faces of meshes a < b that meet."""
    pairs = box_pairs(triangles(vertices, faces)).where(meet(F.col("a"), F.col("b")))
    return pairs.select(F.col("a.mesh_id").alias("a"), F.col("b.mesh_id").alias("b"), F.col("a.fid").alias("fa"), F.col("b.fid").alias("fb"))


def collisions(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(a, b, hits, fa, fb): meshes that collide, the number of pairs of faces that meet, and the first such pair."""
    first = F.min(F.struct("fa", "fb"))
    return triangle_hits(vertices, faces).groupBy("a", "b").agg(F.count("*").alias("hits"), first.alias("f")).select("a", "b", "hits", "f.fa", "f.fb")


def points_inside(points: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(point_id, inside) of points (point_id, mesh_id, x, y, z): whether an odd number of faces of the closed mesh stands above the point.

    The point is moved by a tiny, fixed step on x and y, so that an edge that two faces share counts once.
    """
    px, py = F.col("x") + 1.1e-7, F.col("y") + 0.7e-7
    side = lambda p, q: (F.col(f"{q}x") - F.col(f"{p}x")) * (py - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (px - F.col(f"{p}x"))
    w = [side("b", "c"), side("c", "a"), side("a", "b")]
    over = ((w[0] > 0) & (w[1] > 0) & (w[2] > 0)) | ((w[0] < 0) & (w[1] < 0) & (w[2] < 0))
    z = F.try_divide(w[0] * F.col("az") + w[1] * F.col("bz") + w[2] * F.col("cz"), w[0] + w[1] + w[2])
    crossed = points.join(shuffled(corners(vertices, faces)), "mesh_id").where(over & (z > F.col("z"))).groupBy("point_id").agg(F.count("*").alias("n"))
    return points.select("point_id").join(shuffled(crossed), "point_id", "left").select("point_id", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def boxes_meet(boxes: DataFrame, query: tuple[tuple[float, float, float], tuple[float, float, float]]) -> DataFrame:
    """(mesh_id, colliding) of meshes' boxes (``mesh.bounds``) against one box."""
    lo, hi = query
    on = F.lit(True)
    for k, x in enumerate(_XYZ):
        on &= (F.col(f"min_{x}") <= F.lit(float(hi[k]))) & (F.col(f"max_{x}") >= F.lit(float(lo[k])))
    return boxes.select("mesh_id", on.alias("colliding"))
