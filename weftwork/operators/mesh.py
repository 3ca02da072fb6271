"""Measures of triangle meshes as tables: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.lineage import shuffled
from weftwork.operators.relations import SLICE_PARTS, SLICES


def bounds(vertices: DataFrame) -> DataFrame:
    """Box, extents and bounding radius of each mesh."""
    g = vertices.groupBy("mesh_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))
    size = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    return g.select("*", *(s.alias(f"size_{c}") for s, c in zip(size, "xyz", strict=True)), (F.sqrt(sum((s * s for s in size[1:]), size[0] * size[0])) / 2).alias("radius"))


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners (ax .. cz)."""
    out = faces
    for k in "abc":
        v = vertices.select("mesh_id", F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz"))
        out = out.join(shuffled(v), ["mesh_id", k])
    return out


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def mass(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Signed volume, area, their ratio and the centroid of the enclosed body."""
    a, b, c = ([F.col(k + x) for x in "xyz"] for k in "abc")
    n = _cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])
    bc = _cross(b, c)
    v6 = sum((p * q for p, q in zip(a[1:], bc[1:], strict=True)), a[0] * bc[0])
    area2 = F.sqrt(sum((p * p for p in n[1:]), n[0] * n[0]))
    t = corners(vertices, faces).groupBy("mesh_id").agg(F.sum(v6 / 6).alias("volume"), F.sum(area2 / 2).alias("area"), *(F.sum(v6 / 24 * (a[k] + b[k] + c[k])).alias(f"m{x}") for k, x in enumerate("xyz")))
    return t.select("mesh_id", "volume", "area", F.try_divide("area", F.abs("volume")).alias("ratio"), *(F.try_divide(f"m{x}", F.col("volume")).alias(f"c{x}") for x in "xyz"))


def inertia(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, ixx, iyy, izz, ixy, ixz, iyz): second moments about the origin at density 1, the squares taken at the corners of each face's tetrahedron with the origin.

    An approximation (a tetrahedron's exact moment has the products of different corners too); a mesh without volume has none.
    """
    p = {k: [F.col(k + x) for x in "xyz"] for k in "abc"}
    det = sum((u * v for u, v in zip(p["a"][1:], _cross(p["b"], p["c"])[1:], strict=True)), p["a"][0] * _cross(p["b"], p["c"])[0])
    over = lambda f: sum((f(p[k]) for k in "bc"), f(p["a"]))
    square, product = lambda i, j: over(lambda q: q[i] * q[i] + q[j] * q[j]), lambda i, j: over(lambda q: q[i] * q[j])
    parts = {"ixx": square(1, 2), "iyy": square(0, 2), "izz": square(0, 1), "ixy": product(0, 1), "ixz": product(0, 2), "iyz": product(1, 2)}
    t = corners(vertices, faces).groupBy("mesh_id").agg(F.sum(det).alias("v6"), *(F.sum(det * v / 24).alias(n) for n, v in parts.items()))
    return t.where(F.abs("v6") >= 1e-12).select("mesh_id", *((F.signum("v6") * F.col(n)).alias(n) for n in parts))


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, u, v, n): undirected edges and the faces at them."""
    e = faces.select("mesh_id", F.explode(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("e"))
    return e.groupBy("mesh_id", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count("*").alias("n"))


def check(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per mesh: boundary and non-manifold edges, isolated vertices, whether it is closed, and the Euler number."""
    e = edges(faces).groupBy("mesh_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold"))
    used = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    alone = vertices.join(shuffled(used), ["mesh_id", "vid"], "left_anti").groupBy("mesh_id").agg(F.count("*").alias("isolated"))
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    j = v.join(shuffled(e), "mesh_id", "left").join(shuffled(f), "mesh_id", "left").join(shuffled(alone), "mesh_id", "left").na.fill(0)
    return j.select("mesh_id", "n_vertices", "n_faces", "n_edges", "boundary", "non_manifold", "isolated", ((F.col("boundary") == 0) & (F.col("non_manifold") == 0)).alias("closed"), (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"))


def weld(vertices: DataFrame, faces: DataFrame, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Vertices at one place (rounded) become that of the smallest number; faces are remapped, and those that collapse go."""
    place = [F.round(c, digits).alias(f"_{c}") for c in "xyz"]
    at = vertices.select("mesh_id", "vid", *place)
    low = at.groupBy("mesh_id", "_x", "_y", "_z").agg(F.min("vid").alias("to"))
    move = at.join(shuffled(low), ["mesh_id", "_x", "_y", "_z"]).select("mesh_id", "vid", "to")
    out = faces
    for k in "abc":
        out = out.join(shuffled(move.select("mesh_id", F.col("vid").alias(k), F.col("to").alias(f"_{k}"))), ["mesh_id", k])
    out = out.select("mesh_id", "fid", *(F.col(f"_{k}").alias(k) for k in "abc")).where("a <> b AND b <> c AND c <> a")
    return vertices.join(shuffled(low.select("mesh_id", F.col("to").alias("vid"))), ["mesh_id", "vid"], "left_semi"), out


def half_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, u, v, boundary): directed edges; one without a twin in the other direction is boundary."""
    d = faces.select("mesh_id", "fid", F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("e")).select("mesh_id", "fid", "e.u", "e.v")
    twin = d.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("_t")).distinct()
    return d.join(shuffled(twin), ["mesh_id", "u", "v"], "left").select("mesh_id", "fid", "u", "v", F.col("_t").isNull().alias("boundary"))


def box_overlaps(boxes: DataFrame, cell: float, slices: int = SLICES) -> DataFrame:
    """(a, b) of meshes of ``bounds`` whose boxes meet on all axes: boxes are dealt to grid cells of size ``cell`` on x, and each is compared in the cell in which it begins with those that began before it, so each pair is made once.

    Pairs may be in proportion to the square of a cell's boxes, and the rows are few bytes: so a cell is made of slices, and
    these are dealt to a number of partitions that is not made smaller by their size. Pairs are neither shuffled nor stored.
    """
    parts = max(SLICE_PARTS, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = lambda c: F.floor(F.col(c) / cell)
    p = boxes.withColumn("cell", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("slice", F.pmod(F.xxhash64("mesh_id"), F.lit(slices)).cast("int"))
    q = boxes.withColumn("cell", at("min_x")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    p, q = (side.repartition(parts, "cell", "slice").alias(n) for side, n in ((p, "p"), (q, "q")))
    meets = (F.col("p.cell") == F.col("q.cell")) & (F.col("p.slice") == F.col("q.slice")) & (F.col("p.max_x") >= F.col("q.min_x")) & (F.col("p.mesh_id") != F.col("q.mesh_id"))
    meets &= (F.col("p.min_x") < F.col("q.min_x")) | ((F.col("p.min_x") == F.col("q.min_x")) & (F.col("p.mesh_id") < F.col("q.mesh_id")))
    for c in "yz":
        meets &= (F.col(f"p.min_{c}") <= F.col(f"q.max_{c}")) & (F.col(f"q.min_{c}") <= F.col(f"p.max_{c}"))
    return p.join(shuffled(q), meets).select(F.least("p.mesh_id", "q.mesh_id").alias("a"), F.greatest("p.mesh_id", "q.mesh_id").alias("b"))


def transform(vertices: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Vertices under a 4x4 matrix (rows, column vectors)."""
    x = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    row = lambda r: sum((F.lit(float(m)) * v for m, v in zip(r[1:], x[1:], strict=True)), F.lit(float(r[0])) * x[0])
    return vertices.select("mesh_id", "vid", *(row(matrix[k]).alias(c) for k, c in enumerate("xyz")))


def array_pattern(vertices: DataFrame, counts: tuple[int, int, int], step: tuple[float, float, float]) -> DataFrame:
    """Copies of the vertices on a grid, numbered by ``copy``."""
    nx, ny, nz = counts
    copies = F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1)))
    k = F.col("copy")
    shift = (k % nx, F.floor(k / nx) % ny, F.floor(k / (nx * ny)))
    return vertices.withColumn("copy", copies).select("mesh_id", "copy", "vid", *((F.col(c) + s * F.lit(float(d))).alias(c) for c, s, d in zip("xyz", shift, step, strict=True)))


def splats(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, x, y, z, nx, ny, nz, area): centre, unit normal and area of each face; a face without area has no normal."""
    a, b, c = ([F.col(k + x) for x in "xyz"] for k in "abc")
    n = _cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    centre = [((a[k] + b[k] + c[k]) / 3).alias(x) for k, x in enumerate("xyz")]
    return corners(vertices, faces).select("mesh_id", "fid", *centre, *(F.try_divide(m, length).alias(f"n{x}") for m, x in zip(n, "xyz", strict=True)), (length / 2).alias("area"))


def ray_hits(rays: DataFrame, vertices: DataFrame, faces: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(ray_id, fid, t): the nearest face of its mesh that each ray (ray_id, mesh_id, ox..oz, dx..dz) meets."""
    a, b, c = ([F.col(k + x) for x in "xyz"] for k in "abc")
    o, d = [F.col(f"o{x}") for x in "xyz"], [F.col(f"d{x}") for x in "xyz"]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    minus = lambda u, v: [p - q for p, q in zip(u, v, strict=True)]
    e1, e2 = minus(b, a), minus(c, a)
    h = _cross(d, e2)
    det = dot(e1, h)
    s = minus(o, a)
    q = _cross(s, e1)
    u, v, t = (F.try_divide(x, det) for x in (dot(s, h), dot(d, q), dot(e2, q)))
    hit = (F.abs(det) > eps) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0)
    met = rays.join(shuffled(corners(vertices, faces)), "mesh_id").where(hit).select("ray_id", "fid", t.alias("t"))
    return met.groupBy("ray_id").agg(F.min_by("fid", F.struct("t", "fid")).alias("fid"), F.min("t").alias("t"))


#: Columns of cells on a side of the blocks that meshes are dealt to.
BLOCK = 64


def _columns(vertices: DataFrame, faces: DataFrame, cell: float, rim: int) -> DataFrame:
    """(mesh_id, bi, bj, i, j, ks): the occupied cells of each column of cells, in each block of columns that the column is in or lies within ``rim`` of.

    Faces are dealt to the blocks that their shadow covers, and only then to columns: what is multiplied after that stays in its task.
    A shadow's edges count on one side alone (x and y are moved by a tiny, fixed step), so a shared edge counts once.
    """
    parts = max(SLICE_PARTS, int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = lambda x: F.least(F.col(f"a{x}"), F.col(f"b{x}"), F.col(f"c{x}"))
    most = lambda x: F.greatest(F.col(f"a{x}"), F.col(f"b{x}"), F.col(f"c{x}"))
    low, high = (lambda x: F.floor(least(x) / cell)), (lambda x: F.greatest(F.floor(most(x) / cell), F.floor(least(x) / cell)))
    t = corners(vertices, faces).where((least("x") < most("x")) & (least("y") < most("y"))).select("mesh_id", *(k + x for k in "abc" for x in "xyz"))
    for n, x in (("bi", "x"), ("bj", "y")):
        t = t.withColumn(n, F.explode(F.sequence(F.floor((low(x) - rim) / BLOCK), F.floor((high(x) + rim) / BLOCK))))
    t = t.repartition(parts, "mesh_id", "bi", "bj")
    for n, x in (("i", "x"), ("j", "y")):
        t = t.withColumn(n, F.explode(F.sequence(F.greatest(low(x), F.col(f"b{n}") * BLOCK - rim), F.least(high(x), F.col(f"b{n}") * BLOCK + (BLOCK - 1 + rim)))))
    px, py = (F.col("i") + 0.5 + 1.1e-7) * cell, (F.col("j") + 0.5 + 0.7e-7) * cell
    side = lambda p, q: (F.col(f"{q}x") - F.col(f"{p}x")) * (py - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (px - F.col(f"{p}x"))
    w = [side("b", "c"), side("c", "a"), side("a", "b")]
    inside = ((w[0] > 0) & (w[1] > 0) & (w[2] > 0)) | ((w[0] < 0) & (w[1] < 0) & (w[2] < 0))
    z = F.try_divide(w[0] * F.col("az") + w[1] * F.col("bz") + w[2] * F.col("cz"), w[0] + w[1] + w[2])
    column = ["mesh_id", "bi", "bj", "i", "j"]
    crossed = t.where(inside).select(*column, z.alias("z")).where("z IS NOT NULL")
    # windows in the order that the neighbours' want, where an aggregate would be made and sorted twice
    one = Window.partitionBy(*column).orderBy("z")
    zs = F.collect_list("z").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    crossed = crossed.select(*column, zs.alias("zs"), F.row_number().over(one).alias("nth")).where("nth = 1")
    above = lambda k: F.size(F.filter("zs", lambda v: v > (k + 0.5) * cell))
    ks = F.filter(F.sequence(F.floor(F.col("zs")[0] / cell), F.floor(F.element_at("zs", -1) / cell)), lambda k: above(k) % 2 == 1)
    return crossed.select(*column, ks.alias("ks"))


def voxels(vertices: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """(mesh_id, i, j, k): cells whose centre lies inside its closed mesh, by the parity of faces above the centre."""
    return _columns(vertices, faces, cell, 0).select("mesh_id", "i", "j", F.explode("ks").alias("k"))


def surface_voxels(vertices: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """(mesh_id, i, j, k): those of ``voxels`` with an empty one among their six neighbours.

    A column finds the four beside it in its block, whose rim is there too, so no cell is sent anywhere.
    """
    t = _columns(vertices, faces, cell, 1)
    beside = []
    for n, other in (("j", "i"), ("i", "j")):
        line = Window.partitionBy("mesh_id", "bi", "bj", other).orderBy(n)
        for name, f, step in ((f"{n}_before", F.lag, -1), (f"{n}_after", F.lead, 1)):
            t = t.withColumn(name, F.when(f(n).over(line) == F.col(n) + step, f("ks").over(line)))
            beside.append(F.col(name))
    own = F.col("ks")
    inner = own
    for other in (*beside, F.transform(own, lambda k: k + 1), F.transform(own, lambda k: k - 1)):
        inner = F.array_intersect(inner, other)
    closed = F.lit(True)
    for c in beside:
        closed &= c.isNotNull()
    t = t.where((F.floor(F.col("i") / BLOCK) == F.col("bi")) & (F.floor(F.col("j") / BLOCK) == F.col("bj")))
    return t.select("mesh_id", "i", "j", F.explode(F.when(closed, F.array_except(own, inner)).otherwise(own)).alias("k"))


def skin(vertices: DataFrame, weights: DataFrame, bones: DataFrame) -> DataFrame:
    """Vertices moved by the weighted mean of their bones' shifts: weights (mesh_id, vid, bone, w), bones (bone, tx, ty, tz).

    Weights are scaled to sum 1; a vertex with a negative or no weight in all stays where it is.
    """
    moved = weights.join(bones, "bone", "left").groupBy("mesh_id", "vid").agg(F.sum("w").alias("total"), F.min("w").alias("least"), *(F.sum(F.col("w") * F.col(f"t{x}")).alias(f"_{x}") for x in "xyz"))
    shift = moved.where("least >= 0 AND total > 0").select("mesh_id", "vid", *((F.col(f"_{x}") / F.col("total")).alias(f"_{x}") for x in "xyz"))
    return vertices.join(shuffled(shift), ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.round(F.col(x) + F.coalesce(f"_{x}", F.lit(0.0)), 6).alias(x) for x in "xyz"))
