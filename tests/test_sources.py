"""Mesh files and source-code findings."""

import struct

from pyspark.sql import functions as F

from weftwork.operators import code, mesh, recipes
from weftwork.plans.meshes import FACES
from weftwork.sources import meshes

CUBE = [(float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]


def test_mesh_files(spark, tmp_path):
    tri = [(CUBE[a], CUBE[b], CUBE[c]) for a, b, c in FACES]
    (tmp_path / "a.obj").write_text("".join("v %g %g %g\n" % p for p in CUBE) + "".join("f %d %d %d\n" % tuple(i + 1 for i in t) for t in FACES) + "f 1 2 99\n")
    (tmp_path / "b.stl").write_bytes(b" " * 80 + struct.pack("<I", 12) + b"".join(struct.pack("<12fH", 0, 0, 0, *a, *b, *c, 0) for a, b, c in tri))
    (tmp_path / "c.stl").write_text("solid c\n" + "".join("vertex %g %g %g\n" % p for t in tri for p in t))
    (tmp_path / "d.ply").write_text("ply\nformat ascii 1.0\nelement vertex 8\nelement face 12\nend_header\n" + "".join("%g %g %g\n" % p for p in CUBE) + "".join("3 %d %d %d\n" % t for t in FACES))
    (tmp_path / "bad.ply").write_text("ply\n")
    v, f = meshes.read_meshes(spark, str(tmp_path))
    v2, f2 = mesh.weld(v, f)
    got = {r.mesh_id[-5:]: (round(r.volume, 6), round(r.area, 6)) for r in mesh.mass(v2, f2).collect()}
    assert got == {n: (1.0, 6.0) for n in ("a.obj", "b.stl", "c.stl", "d.ply")}
    assert all(r.closed for r in mesh.check(v2, f2).collect())
    again = {r.mesh_id[-5:]: meshes.parse_obj(r.text) for r in meshes.obj_text(v2, f2).collect()}
    assert all(len(p) == 8 and len(t) == 12 for p, t in again.values())


def test_quads_become_fans():
    points, faces = meshes.parse_obj("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 -1\n")
    assert len(points) == 4 and faces == [(0, 1, 2), (0, 2, 3)]


SOURCE = '''import os, re, json
def run(cmd, seen={}):
    x = input()
    y = x + "!"
    os.system(y)
    x = "safe"
    os.system(x)
    subprocess.run(cmd, shell=True)
    return yaml.load(cmd), requests.get(cmd), pickle.loads(cmd), [1, 2][5]
def f():
    raise NotImplementedError
try:
    assert json
except Exception:
    eval("1")
re.compile("(a+)+")
'''


def test_code_findings(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken(:"), ("c.py", None)], "path string, text string")
    got = {(r.file, r.line, r.rule) for r in code.findings(files).collect()}
    want = {(2, "mutable_default_arg"), (5, "shell_injection"), (7, "shell_injection"), (5, "taint_flow"), (8, "shell_injection"), (9, "unsafe_yaml"), (9, "request_no_timeout"), (9, "unsafe_pickle"), (9, "index_out_of_range"), (13, "assert_validation"), (14, "overwide_except"), (15, "dynamic_exec"), (16, "regex_dos")}
    assert got == {("a.py", *w) for w in want} | {("b.py", 1, "syntax_error")}
    s = code.symbols(files)
    assert {r.name for r in code.unused_imports(s).collect()} == set()
    assert {r.name for r in code.dead_definitions(s).collect()} == {"f"}  # run is used as an attribute
    assert [r.name for r in s.where("kind = 'incomplete'").collect()] == ["f"]


def test_recipes(spark):
    r = recipes.Recipes()
    r.step("double", lambda rows: rows.withColumn("id", F.col("id") * 2))
    r.preset("twice", [("a", "double", {"rows": "${rows}"}), ("b", "double", {"rows": "${a}"})])
    assert [x.id for x in r.run([("z", "twice", {"rows": "${given}"})], given=spark.range(2))["z"].collect()] == [0, 4]
    try:
        r.preset("bad", [("a", "no such", {})])
    except ValueError as e:
        assert "no such" in str(e)
    else:
        raise AssertionError
    got = recipes.in_parallel({"ok": lambda: spark.range(3).count(), "bad": lambda: 1 / 0})
    assert got["ok"] == (True, 3) and got["bad"][0] is False
