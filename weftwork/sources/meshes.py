"""Mesh files as vertex and face tables: OBJ, STL (text and binary), text PLY and GLB (places and triangles of all its meshes); and OBJ text from tables.

Polygons become fans of triangles. Faces with a vertex that is not there, and vertices that are not finite,
are left out with what uses them. STL names no shared vertices; ``operators.mesh.weld`` joins them.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose rows are handed on together.
STEP_FILES = 32
ROWS = "mesh_id string, kind string, n int, x double, y double, z double, a int, b int, c int"


def _fan(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    for k in range(1, len(ids) - 1):
        yield ids[0], ids[k], ids[k + 1]


def parse_obj(text: str) -> tuple[list, list]:
    points, faces = [], []
    for line in text.splitlines():
        head, *rest = line.split() or [""]
        if head == "v":
            points.append(tuple(map(float, rest[:3])))
        elif head == "f":
            ids = [int(x.split("/")[0]) for x in rest]
            faces += _fan([i - 1 if i > 0 else len(points) + i for i in ids])
    return points, faces


def parse_stl(raw: bytes) -> tuple[list, list]:
    count = struct.unpack_from("<I", raw, 80)[0] if len(raw) >= 84 else -1
    if len(raw) == 84 + 50 * count:
        points = [p for k in range(count) for p in struct.iter_unpack("<3f", raw[96 + 50 * k : 132 + 50 * k])]
    else:
        points = [tuple(map(float, x.split()[1:4])) for x in raw.decode("utf-8", "replace").splitlines() if x.split()[:1] == ["vertex"]]
    return points, [(k, k + 1, k + 2) for k in range(0, len(points) - 2, 3)]


def parse_ply(text: str) -> tuple[list, list]:
    lines = text.splitlines()
    end = lines.index("end_header")
    size = {h.split()[1]: int(h.split()[2]) for h in lines[:end] if h.startswith("element ")}
    body = lines[end + 1 :]
    n = size.get("vertex", 0)
    points = [tuple(map(float, x.split()[:3])) for x in body[:n]]
    return points, [t for x in body[n : n + size.get("face", 0)] for t in _fan([int(v) for v in x.split()[1:]])]


#: Kinds of a GLB file's chunks, and of the numbers in its buffers.
_JSON, _BIN = 0x4E4F534A, 0x004E4942
_TYPES = {5121: "<u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}


def _view(gltf: dict, data: bytes, accessor: int, width: int) -> np.ndarray:
    """An accessor's rows as a typed view on the buffer; as many as the buffer has."""
    a = gltf["accessors"][accessor]
    v = gltf["bufferViews"][a["bufferView"]]
    kind = np.dtype(_TYPES[a["componentType"]])
    at, step = v.get("byteOffset", 0) + a.get("byteOffset", 0), v.get("byteStride", kind.itemsize * width)
    if step <= 0 or at < 0 or at > len(data):
        raise ValueError("a view without a stride, or outside its buffer")
    room = (len(data) - at - kind.itemsize * width) // step + 1
    return np.ndarray((max(0, min(a["count"], room)), width), kind, data, at, (step, kind.itemsize))


def parse_glb(raw: bytes) -> tuple[list, list]:
    """Places and triangles of a GLB file: of every mesh and primitive, each with its own vertices."""
    if len(raw) < 12 or raw[:4] != b"glTF":
        raise ValueError("no GLB file")
    at, chunks = 12, {}
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from("<II", raw, at)
        if at + 8 + size > len(raw):
            raise ValueError("a chunk that does not fit")
        chunks.setdefault(kind, raw[at + 8 : at + 8 + size])
        at += 8 + size
    gltf, data = json.loads(chunks.get(_JSON, b"").decode("utf-8", "replace")), chunks.get(_BIN, b"")
    points, faces = [], []
    for primitive in (p for m in gltf.get("meshes", ()) for p in m.get("primitives", ())):
        place = primitive.get("attributes", {}).get("POSITION")
        if place is None or gltf["accessors"][place].get("type") != "VEC3" or gltf["accessors"][place]["componentType"] != 5126 or primitive.get("mode", 4) != 4:
            continue
        own = _view(gltf, data, place, 3).astype(float)
        ids = _view(gltf, data, primitive["indices"], 1)[:, 0] if primitive.get("indices") is not None else np.arange(len(own))
        ids = ids[: len(ids) // 3 * 3].astype(np.int64).reshape(-1, 3)
        faces += [tuple(t) for t in (ids[(ids < len(own)).all(axis=1)] + len(points)).tolist()]
        points += [tuple(p) for p in own.tolist()]
    return points, faces


def _rows(path: str, raw: bytes) -> Iterator[tuple]:
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        points, faces = {"stl": parse_stl, "glb": parse_glb}[ext](raw) if ext in ("stl", "glb") else (parse_obj if ext == "obj" else parse_ply)(raw.decode("utf-8", "replace"))
    except (ValueError, IndexError, KeyError, TypeError, struct.error):
        return
    good = [all(map(math.isfinite, p)) and len(p) == 3 for p in points]
    for n, p in enumerate(points):
        if good[n]:
            yield path, "v", n, *p, None, None, None
    for n, t in enumerate(faces):
        if all(0 <= i < len(points) and good[i] for i in t):
            yield path, "f", n, None, None, None, *t


def meshes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of mesh files whose content is at hand: (path, content)."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), STEP_FILES):
                part = f.iloc[lo : lo + STEP_FILES]
                rows = [r for p, raw in zip(part["path"], part["content"], strict=True) for r in _rows(p, bytes(raw))]
                yield pd.DataFrame(rows, columns=names).astype({k: "Int32" for k in ("n", "a", "b", "c")})

    rows = files.select("path", "content").mapInPandas(parse, ROWS)
    return rows.where("kind = 'v'").select("mesh_id", F.col("n").alias("vid"), "x", "y", "z"), rows.where("kind = 'f'").select("mesh_id", F.col("n").alias("fid"), "a", "b", "c")


def read_meshes(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the mesh files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{obj,stl,ply,glb}").load(path)
    return meshes(files.where(F.col("length") <= most_bytes))


def obj_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, text): each mesh as OBJ text, vertices numbered anew in their order."""
    from pyspark.sql.window import Window

    numbered = vertices.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id").orderBy("vid")))
    f = faces
    for c in "abc":
        f = f.join(numbered.select("mesh_id", F.col("vid").alias(c), F.col("k").alias(f"k{c}")), ["mesh_id", c])
    v = numbered.select("mesh_id", F.lit(0).alias("part"), F.col("k").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    both = v.unionByName(f.select("mesh_id", F.lit(1).alias("part"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), "ka", "kb", "kc").alias("line")))
    return both.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "line"))).alias("rows")).select("mesh_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
