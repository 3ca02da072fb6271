"""Collisions against exact rational arithmetic, clipping by volumes, unions and relations."""

import itertools
import random
from fractions import Fraction

import pytest

from weftwork.operators import collide, mesh, mesh_cut

CUBE = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
FACES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def tables(spark, meshes):
    """(vertices, faces) of {mesh: (points, faces)}."""
    v = [(m, k, *map(float, p)) for m, (points, _) in meshes.items() for k, p in enumerate(points)]
    f = [(m, k, *t) for m, (_, faces) in meshes.items() for k, t in enumerate(faces)]
    return spark.createDataFrame(v, "mesh_id long, vid int, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid int, a int, b int, c int")


def cube(shift=(0, 0, 0), size=1):
    return [tuple(size * c + s for c, s in zip(p, shift, strict=True)) for p in CUBE], FACES


# --- exact test of two triangles: an edge of one meets the other, or one holds a corner of the other in its plane


def sub(p, q):
    return tuple(a - b for a, b in zip(p, q, strict=True))


def cross(p, q):
    return (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])


def dot(p, q):
    return sum(a * b for a, b in zip(p, q, strict=True))


def holds(t, p):
    n = cross(sub(t[1], t[0]), sub(t[2], t[0]))
    if dot(n, sub(p, t[0])):
        return False
    return all(dot(n, cross(sub(t[(k + 1) % 3], t[k]), sub(p, t[k]))) >= 0 for k in range(3))


def edge_meets(p, q, t):
    n = cross(sub(t[1], t[0]), sub(t[2], t[0]))
    a, b = dot(n, sub(p, t[0])), dot(n, sub(q, t[0]))
    if a * b > 0:
        return False
    if a == b == 0:
        if holds(t, p) or holds(t, q):
            return True
        return any(segments_meet(p, q, t[k], t[(k + 1) % 3], n) for k in range(3))
    s = Fraction(a, a - b)
    return holds(t, tuple(x + s * (y - x) for x, y in zip(p, q, strict=True)))


def segments_meet(p, q, r, s, n):
    side = lambda a, b, c: dot(n, cross(sub(b, a), sub(c, a)))
    a, b, c, d = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
    if a == b == c == d == 0:
        return all(max(min(p[k], q[k]), min(r[k], s[k])) <= min(max(p[k], q[k]), max(r[k], s[k])) for k in range(3))
    return a * b <= 0 and c * d <= 0


def meet(t, u):
    return any(edge_meets(t[k], t[(k + 1) % 3], u) or edge_meets(u[k], u[(k + 1) % 3], t) for k in range(3))


def test_triangles_meet_as_exact_arithmetic_says(spark):
    rng = random.Random(6)
    meshes = {}
    for m in range(70):
        flat, big = m % 3 == 0, rng.choice([1, 1, 2, 8])
        point = lambda: (rng.randint(0, 3) * big, rng.randint(0, 3) * big, 1 if flat else rng.randint(0, 3))  # noqa: E731, B023
        meshes[m] = ([point() for _ in range(6)], [(0, 1, 2), (3, 4, 5)])
    got = {(r.a, r.fa, r.b, r.fb) for r in collide.triangle_hits(*tables(spark, meshes)).collect()}
    tri = {(m, k): [p[i] for i in f] for m, (p, faces) in meshes.items() for k, f in enumerate(faces)}
    tri = {k: t for k, t in tri.items() if any(cross(sub(t[1], t[0]), sub(t[2], t[0])))}
    want = {(*x, *y) for (x, t), (y, u) in itertools.combinations(sorted(tri.items()), 2) if x[0] != y[0] and meet(t, u)}
    assert got == want and len(want) > 300


def test_collisions_of_cubes(spark):
    meshes = {1: cube(), 2: cube((0.5, 0, 0)), 3: cube((3, 0, 0)), 4: cube((1, 1, 1)), 5: cube((0.25, 0.25, 0.25), 0.5), 6: cube((-50, -50, -50), 100)}
    got = {(r.a, r.b): r.hits for r in collide.collisions(*tables(spark, meshes)).collect()}
    # the fifth lies inside the first and the sixth holds all: their faces don't meet
    assert set(got) == {(1, 2), (1, 4), (2, 4), (2, 5)}
    assert collide.collisions(*tables(spark, {1: ([(0, 0, 0), (1, 1, 1), (2, 2, 2)], [(0, 1, 2)]), 2: cube()})).count() == 0


def test_points_and_boxes(spark):
    v, f = tables(spark, {1: cube()})
    points = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5), (2, 1, 9.0, 9.0, 9.0), (3, 1, 0.5, 0.5, -1.0), (4, 7, 0.5, 0.5, 0.5)], "point_id int, mesh_id long, x double, y double, z double")
    assert {r.point_id: r.inside for r in collide.points_inside(points, v, f).collect()} == {1: True, 2: False, 3: False, 4: False}
    meets = lambda lo, hi: collide.boxes_meet(mesh.bounds(v), (lo, hi)).first().colliding
    assert meets((0.2, 0.2, 0.2), (0.8, 0.8, 0.8)) and meets((1, 1, 1), (2, 2, 2)) and not meets((1.1, 0, 0), (2, 1, 1))


# --- clipping


def plane(spark, rows):
    return spark.createDataFrame([(m, *map(float, p)) for m, *p in rows], "mesh_id long, pa double, pb double, pc double, pd double")


def test_both_parts_make_the_whole(spark):
    rng = random.Random(3)
    meshes, planes = {}, []
    for m in range(40):
        size = rng.randint(1, 5)
        meshes[m] = cube((rng.randint(-3, 3), rng.randint(-3, 3), rng.randint(-3, 3)), size)
        centre = meshes[m][0][rng.randrange(8)] if m % 4 == 0 else [rng.uniform(-4, 6) for _ in range(3)]
        n = [rng.randint(-2, 2) for _ in range(3)]
        n = n if any(n) else [1, 0, 0]
        planes.append((m, *n, -dot(n, centre)))
    v, f = tables(spark, meshes)
    whole = {r.mesh_id: r.volume for r in mesh.mass(v, f).collect()}
    total = dict.fromkeys(meshes, 0.0)
    for keep in (True, False):
        cv, cf = mesh_cut.clip(v, f, plane(spark, planes), keep, cap=True)
        volume = {r.mesh_id: r.volume for r in mesh.mass(cv, cf).collect()}
        assert all(x > -1e-9 for x in volume.values())
        for m, x in volume.items():
            total[m] += x
        for r in mesh.check(cv, cf).collect():
            assert r.boundary == 0, r
        inside = {r.mesh_id: (r.a, r.b, r.c, r.d) for r in plane(spark, planes).toDF("mesh_id", "a", "b", "c", "d").collect()}
        for r in cv.where("vid >= 0").collect():
            a, b, c, d = inside[r.mesh_id]
            assert (a * r.x + b * r.y + c * r.z + d) * (1 if keep else -1) > -1e-9
    assert all(abs(total[m] - whole[m]) < 1e-6 for m in meshes)


def test_clip_of_a_tetrahedron_and_planes_that_miss_or_are_no_planes(spark):
    tet = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2)])
    v, f = tables(spark, {1: tet, 2: tet, 3: tet, 4: tet})
    planes = plane(spark, [(1, 0, 0, 1, -0.25), (2, 0, 0, 1, -2.0), (3, 0, 0, float("nan"), 1)])
    got = {r.mesh_id: (r.faces, r.split_vertices, r.cut_faces) for r in mesh_cut.clip_counts(v, f, planes).collect()}
    assert got == {1: (3, 3, 4), 2: (0, 0, 4)}
    cv, _ = mesh_cut.clip(v, f, planes.where("mesh_id = 1"))
    assert {(r.x, r.y, r.z) for r in cv.collect()} == {(0, 0, 1), (0, 0, 0.25), (0.75, 0, 0.25), (0, 0.75, 0.25)}


def test_union_welds_across_meshes(spark):
    a, b = ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)]), ([(0, 0, 0.00001), (0, 0, 1), (1, 0, 1)], [(0, 1, 2)])
    v, f = tables(spark, {1: a, 2: b, 3: a})
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "mesh_id long, into long")
    uv, uf = mesh_cut.union(v, f, groups)
    assert {m: sum(r.mesh_id == m for r in uv.collect()) for m in (10, 11)} == {10: 5, 11: 3}
    faces = {(r.mesh_id, tuple(r.part)): [tuple(r[k]) for k in "abc"] for r in uf.collect()}
    assert faces == {(10, (1, 0)): [(1, 0), (1, 1), (1, 2)], (10, (2, 0)): [(1, 0), (2, 1), (2, 2)], (11, (3, 0)): [(3, 0), (3, 1), (3, 2)]}


def test_relations(spark):
    v, f = tables(spark, {1: cube(), 2: cube((0.5, 0.25, 0.25)), 3: cube((3, 0, 0)), 4: cube((0.25, 0.25, 0.25), 0.5)})
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (4, 1)], "a long, b long")
    got = {(r.a, r.b): (r.relation, r.faces_inside) for r in mesh_cut.relations(v, f, pairs).collect()}
    assert {k: r for k, (r, _) in got.items()} == {(1, 2): "overlapping", (2, 1): "overlapping", (1, 3): "separate", (1, 4): "contained", (4, 1): "contained"}
    points = mesh_cut.corners(v, f).where("mesh_id = 1").collect()
    inside = sum(all(lo < sum(r[f"{k}{c}"] for k in "abc") / 3 < lo + 1 for c, lo in zip("xyz", (0.5, 0.25, 0.25), strict=True)) for r in points)
    assert got[1, 2][1] == inside


@pytest.mark.parametrize("keep", [True, False])
def test_neighbours_share_their_new_vertices(spark, keep):
    v, f = tables(spark, {1: cube()})
    cv, cf = mesh_cut.clip(v, f, plane(spark, [(1, 1, 2, 3, -2.5)]), keep)
    rim = mesh.edges(cf).where("n = 1").collect()
    on = {r.vid for r in cv.collect() if abs(r.x + 2 * r.y + 3 * r.z - 2.5) < 1e-12}
    assert rim and all(r.u in on and r.v in on for r in rim)
