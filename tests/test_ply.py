"""PLY files by ranges: the same as when they are read whole."""

from __future__ import annotations

import numpy as np
import pytest

from skyraster.sources import binary, ply


def written(path, text, order, polygons, colour=True, first="vertex", extra=False):
    rng = np.random.default_rng(5)
    n = 300
    xyz, rgb = rng.uniform(-9, 9, (n, 3)).astype(np.float32), rng.integers(0, 256, (n, 3), dtype=np.uint8)
    faces = [rng.integers(0, n, 3 if not polygons else int(rng.integers(1, 7))).tolist() for _ in range(170)]
    head = {"vertex": [f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *([f"property uchar {c}" for c in ("red", "green", "blue")] if colour else [])],
            "face": [f"element face {len(faces)}", *(["property uchar flag"] if extra else []), "property list uchar int vertex_indices", *(["property float q"] if extra else [])]}
    parts = [first, "face" if first == "vertex" else "vertex"]
    form = "ascii" if text else "binary_big_endian" if order == ">" else "binary_little_endian"
    out = "\n".join(["ply", f"format {form} 1.0", "comment made for a test", *head[parts[0]], *head[parts[1]], "end_header"]).encode() + b"\n"
    for part in parts:
        if part == "vertex":
            for p, c in zip(xyz, rgb, strict=True):
                out += (" ".join([*map(str, p.tolist()), *(map(str, c.tolist()) if colour else [])]) + "\n").encode() if text else p.astype(f"{order}f4").tobytes() + (c.tobytes() if colour else b"")
        else:
            for f in faces:
                if text:
                    out += (" ".join([*(["7"] if extra else []), str(len(f)), *map(str, f), *(["0.5"] if extra else [])]) + "\n").encode()
                else:
                    out += (b"\x07" if extra else b"") + bytes([len(f)]) + np.array(f, f"{order}i4").tobytes() + (np.array([0.5], f"{order}f4").tobytes() if extra else b"")
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize(("text", "order", "polygons", "colour", "first", "extra"), [
    (False, "<", False, True, "vertex", False), (False, ">", False, False, "vertex", True), (False, "<", True, True, "vertex", True), (False, "<", True, True, "face", False), (False, ">", False, True, "face", False),
    (True, "<", False, True, "vertex", False), (True, "<", True, False, "vertex", True), (True, "<", True, True, "face", False)])
@pytest.mark.parametrize(("records", "size"), [(41, 97), (500_000, 32_000_000)])
def test_ranges_equal_the_whole_file(spark, tmp_path, monkeypatch, text, order, polygons, colour, first, extra, records, size):
    monkeypatch.setattr(ply, "RECORDS", records)
    monkeypatch.setattr(ply, "BYTES", size)
    path = written(tmp_path / "a.ply", text, order, polygons, colour, first, extra)
    points, triangles = ply.read_points(spark, path), ply.read_faces(spark, path)
    want, faces = binary.parse_ply(open(path, "rb").read())
    got = points.orderBy("pt_id").collect()
    assert [r.pt_id for r in got] == list(range(300)) and np.allclose([(r.x, r.y, r.z, r.r, r.g, r.b) for r in got], want[["x", "y", "z", "r", "g", "b"]].to_numpy(float))
    assert sorted((r.a, r.b, r.c) for r in triangles.collect()) == sorted(map(tuple, faces.tolist()))
    if records < 100:
        assert points.rdd.getNumPartitions() > 3  # many tasks for one file


def test_odd_files(spark, tmp_path):
    path = tmp_path / "a.ply"
    path.write_bytes(b"ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nend_header\n")
    assert ply.read_points(spark, str(path)).count() == 0 and ply.read_faces(spark, str(path)).count() == 0
    path.write_bytes(b"no such thing")
    with pytest.raises(ValueError, match="not a PLY"):
        ply.read_points(spark, str(path))
    path.write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6")  # no line end
    assert [(r.x, r.z) for r in ply.read_points(spark, str(path)).orderBy("pt_id").collect()] == [(1.0, 3.0), (4.0, 6.0)]
