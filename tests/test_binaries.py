"""GLB and MP4 files written by the test, whole and cut short at every place."""

import json
import struct

import pytest

from weftwork.plans.binaries import _glb
from weftwork.sources import media, meshes

TRIANGLE = [(0, 0, 0), (1, 0, 0), (0, 1, 0)]


def box(kind, payload, wide=False):
    if wide:
        return struct.pack(">I4sQ", 1, kind, 16 + len(payload)) + payload
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def movie(long_form=False, tracks=1, last_open=False):
    mvhd = bytes([1, 0, 0, 0]) + struct.pack(">QQIQ", 0, 0, 600, 3000) + bytes(80) if long_form else struct.pack(">IIIII", 0, 0, 0, 600, 3000) + bytes(80)
    tkhd = bytes([1, 0, 0, 0]) + struct.pack(">QQI", 0, 0, 7) + bytes(60) if long_form else struct.pack(">IIII", 0, 0, 0, 7) + bytes(60)
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + box(b"hev1", bytes(70))) + box(b"stts", struct.pack(">IIIIII", 0, 9, 100, 1, 50, 2)))
    trak = box(b"trak", box(b"tkhd", tkhd + struct.pack(">II", 640 << 16, 360 << 16)) + box(b"mdia", box(b"hdlr", bytes(8) + b"vide" + bytes(13)) + box(b"minf", stbl)))
    moov = box(b"mvhd", mvhd) + trak * tracks
    tail = struct.pack(">I4s", 0, b"moov") + moov if last_open else box(b"moov", moov, wide=long_form)
    return box(b"ftyp", b"qt  " + bytes(4) + b"qt  ") + box(b"mdat", bytes(1000), wide=long_form) + tail


@pytest.mark.parametrize(("long_form", "tracks", "last_open"), [(False, 1, False), (True, 2, False), (False, 3, True)])
def test_what_a_movie_says(spark, tmp_path, long_form, tracks, last_open):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mov").write_bytes(movie(long_form, tracks, last_open))
    (tmp_path / "b.txt").write_bytes(b"no movie")
    found = media.read_boxes(spark, str(tmp_path))
    r = media.media_info(found).first()
    assert (r.brand, r.timescale, r.duration, r.seconds, r.n_tracks, r.width, r.height, r.codec, r.fps, r.has_video, r.has_audio, r.damaged, r.reason) == ("qt..", 600, 3000, 5.0, tracks, 640, 360, "hev1", 30.0, True, False, False, None)
    assert [(t.track, t.id, t.kind, t.samples) for t in media.tracks(found).orderBy("track").collect()] == [(k, 7, "vide", 150) for k in range(tracks)]


def test_a_movie_cut_short_anywhere(spark):
    whole = movie()
    files = spark.createDataFrame([(str(n), bytearray(whole[:n])) for n in range(0, len(whole) + 1, 3)] + [("none", None)], "path string, content binary")
    got = {r.path: r.reason for r in media.media_info(media.boxes(files)).collect()}
    head = len(box(b"ftyp", bytes(12)))
    for n in range(0, len(whole) + 1, 3):
        assert got[str(n)] == (None if n == len(whole) else "too short" if n < 12 else "no box" if n < head else "no moov"), n
    assert got["none"] == "too short" and len(got) == files.count()


def test_glb_meshes(spark, tmp_path):
    two = json.loads(_glb(TRIANGLE, [0, 1, 2])[20 : 20 + struct.unpack_from("<I", _glb(TRIANGLE, [0, 1, 2]), 12)[0]])
    assert meshes.parse_glb(_glb(TRIANGLE, [0, 1, 2])) == ([tuple(map(float, p)) for p in TRIANGLE], [(0, 1, 2)])
    assert meshes.parse_glb(_glb(TRIANGLE, [2, 1, 0, 0, 1], True, 20))[1] == [(2, 1, 0)]
    # two primitives, each with its own vertices, the second without indices
    data = b"".join(struct.pack("<3f", *p) for p in TRIANGLE) + struct.pack("<3H", 0, 1, 2)
    two["meshes"] = [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}}, {"attributes": {}}, {"attributes": {"POSITION": 0}, "mode": 1}]}]
    text = json.dumps(two).encode()
    raw = b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data
    points, faces = meshes.parse_glb(raw)
    assert len(points) == 6 and faces == [(0, 1, 2), (3, 4, 5)]
    (tmp_path / "a.glb").write_bytes(raw)
    (tmp_path / "b.glb").write_bytes(raw[:-1])
    (tmp_path / "c.glb").write_bytes(b"glTX" + raw[4:])
    bad = two | {"bufferViews": [v | {"byteStride": 0} for v in two["bufferViews"]]}
    text = json.dumps(bad).encode()
    (tmp_path / "d.glb").write_bytes(b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data)
    v, f = meshes.read_meshes(spark, str(tmp_path))
    assert {r.mesh_id.rsplit("/", 1)[-1] for r in v.collect()} == {"a.glb"} and f.count() == 2
