"""Binary files made from parts: GLB meshes and MP4 containers, whole and damaged."""

from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from weftwork.operators import mesh as M
from weftwork.plans.registry import query, table
from weftwork.sources import media, meshes


def _glb(points: list[tuple], ids: list[int], wide: bool = False, stride: int = 12) -> bytes:
    """A GLB file of one mesh, with numbers of two or four bytes."""
    kind = "I" if wide else "H"
    data = b"".join(struct.pack("<3f", *p) + b"\0" * (stride - 12) for p in points) + struct.pack(f"<{len(ids)}{kind}", *ids)
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": stride * len(points), "byteStride": stride}, {"buffer": 0, "byteOffset": stride * len(points), "byteLength": len(data) - stride * len(points)}]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3"}, {"bufferView": 1, "componentType": 5125 if wide else 5123, "count": len(ids), "type": "SCALAR"}]
    text = json.dumps({"accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(data)}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}]}).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data
    return b"glTF" + struct.pack("<II", 2, 12 + len(chunks)) + chunks


_TET = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
_FILES = [
    _glb(_TET, [0, 2, 1, 0, 1, 3, 0, 3, 2, 1, 2, 3]), _glb([(x * 2, y, z) for x, y, z in _TET], [0, 2, 1, 0, 1, 3, 0, 3, 2, 1, 2, 3], True, 16), _glb(_TET, [0, 2, 1, 0, 1, 9, 0, 3]), _glb(_TET, [0, 2, 1])[:-8], b"glTF",
]


@query("glb_meshes", "SELECT 'm' || p_partkey || '.glb' AS mesh_id, 4::BIGINT AS n_vertices, ([4, 4, 1])[1 + p_partkey % 5]::BIGINT AS n_faces, round(([1.0, 2.0, 0.0])[1 + p_partkey % 5]::DOUBLE / 6, 6) AS volume FROM part WHERE p_partkey % 5 < 3")
def glb_meshes(spark, sf_dir):
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".glb")).alias("path"), F.element_at(F.array(*map(F.lit, _FILES)), (k % 5 + 1).cast("int")).alias("content"))
    v, f = meshes.meshes(files)
    counts = v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")).join(f.groupBy("mesh_id").agg(F.count("*").alias("n_faces")), "mesh_id")
    return counts.join(M.mass(v, f).select("mesh_id", F.round("volume", 6).alias("volume")), "mesh_id")


def _box(kind: str, *payload):
    """A box as hexadecimal text."""
    body = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in payload))
    return F.concat(F.format_string("%08x", (F.length(body) / 2 + 8).cast("int")), F.lit(kind.encode().hex()), body)


def _movies(spark, sf_dir):
    k = F.col("p_partkey")
    word = lambda n: F.format_string("%08x", n.cast("int") if not isinstance(n, int) else F.lit(n))
    zeros = lambda n: "00" * n
    track = lambda n, kind, codec, w, h, samples: _box(
        "trak", _box("tkhd", zeros(12), word(n), zeros(60), word(w * 65536), word(h * 65536)),
        _box("mdia", _box("mdhd", zeros(24)), _box("hdlr", zeros(8), kind.encode().hex(), zeros(12)), _box("minf", _box("stbl", _box("stsd", zeros(4), word(1), _box(codec, zeros(78))), _box("stts", zeros(4), word(2), word(samples), word(1), word(5), word(20))))),
    )
    seconds = F.when(k % 7 == 1, 0).otherwise(F.col("p_size"))
    head = _box("mvhd", zeros(12), word(1000), word(seconds * 1000), zeros(80))
    video = track(1, "vide", "avc1", F.col("p_size") * 16, k % 5 * 9, F.col("p_size") * 25 - 5)
    sound = track(2, "soun", "mp4a", F.lit(0), F.lit(0), F.lit(95))
    moov = _box("moov", head, F.when(k % 7 != 2, video).otherwise(F.lit("")), F.when(k % 3 == 0, sound).otherwise(F.lit("")))
    start = F.concat(_box("ftyp", b"isom".hex(), zeros(4), b"isommp42".hex()), _box("free", zeros(5)))
    whole = F.when(k % 7 == 3, F.substring(F.concat(start, moov), F.lit(1), F.length(start) + F.length(moov) - 20)).when(k % 7 == 4, F.lit("00000001")).when(k % 7 == 5, start).otherwise(F.concat(start, moov))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("v"), k.cast("string"), F.lit(".mp4")).alias("path"), F.unhex(whole).alias("content"))


@query(
    "media_info",
    """
    SELECT 'v' || p_partkey || '.mp4' AS path, CASE WHEN d THEN NULL ELSE 'isom' END AS brand, CASE WHEN m IN (1, 3, 4, 5) THEN 0 ELSE p_size * 1000 END::BIGINT AS duration, CASE WHEN v THEN p_size * 16 END::BIGINT AS width, CASE WHEN v THEN p_partkey % 5 * 9 END::BIGINT AS height,
           CASE WHEN v THEN 'avc1' END AS codec, CASE WHEN v AND m <> 1 THEN 25.0::DOUBLE END AS fps, CASE WHEN m IN (3, 4, 5) THEN 0 ELSE v::INT + s::INT END::BIGINT AS n_tracks, CASE WHEN m IN (3, 4, 5) THEN false ELSE s END AS has_audio,
           CASE WHEN m = 4 THEN 'too short' WHEN m IN (3, 5) THEN 'no moov' WHEN m = 2 AND NOT s THEN 'no tracks' WHEN m = 1 THEN 'no duration' END AS reason
    FROM (SELECT *, p_partkey % 7 AS m, p_partkey % 7 = 4 AS d, p_partkey % 7 IN (0, 1, 6) AS v, p_partkey % 3 = 0 AS s FROM part)""",
)
def media_info(spark, sf_dir):
    return media.media_info(media.boxes(_movies(spark, sf_dir))).select("path", "brand", "duration", "width", "height", "codec", "fps", "n_tracks", "has_audio", "reason")
