from __future__ import annotations

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyraster import schema
from skyraster.functions import geo, photo
from skyraster.operators import cloud, control, ml, ortho, terrain, tiles
from skyraster.plans import pipeline, report, tables
from skyraster.schema import RasterMeta, Settings
from skyraster.sources import binary, clouds, products, project, text_models

DRONE = dict(cam_id=1, path="/a/b/IMG 1.JPG", width=5280, height=3956, make="DJI", model="M3E", focal_mm=12.29, lat=22.58, lon=88.49, alt=108.5, rel_alt=100.0, pitch=-90.0, aligned=False, enabled=True)


def cameras(spark, *rows):
    names = [c.split()[0] for c in schema.CAMERAS.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.CAMERAS)


def raster(spark, a):
    return spark.createDataFrame([(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)], "row long, col long, value double")


def test_photos_are_sorted_by_squared_distance(spark):
    """Squares that differ in their last bit have one root; the nearer photo still comes first."""
    near, far = ({**DRONE, "cam_id": k, "est_x": 13.34, "est_y": y} for k, y in ((2, 7.77), (1, 7.7700000000000005)))
    rows = cameras(spark, far, near, {**DRONE, "cam_id": 0})
    assert [r.cam_id for r in control.sort_photos(rows, "gcp", (0.0, 0.0)).collect()] == [2, 1, 0]


def test_focal_and_gsd(spark):
    f = 5280 * 12.29 / 17.3
    one = cameras(spark, DRONE, {**DRONE, "cam_id": 2, "make": "Unknown", "model": "", "focal_mm": None, "focal35_mm": 24.0})
    got = {r.cam_id: r.f for r in one.select("cam_id", photo.focal_px().alias("f")).collect()}
    assert math.isclose(got[1], f) and math.isclose(got[2], 5280 * 24 / 36)
    assert math.isclose(photo.median_gsd(cameras(spark, DRONE)).first().gsd, 100 / f)
    solved = spark.createDataFrame([(1, 4000.0)], "cam_id long, f_px double")
    assert math.isclose(photo.median_gsd(cameras(spark, {**DRONE, "est_z": 150.0}), 30.0, solved).first().gsd, 0.03)
    assert photo.median_gsd(cameras(spark, {**DRONE, "enabled": False})).first().gsd is None


def test_durations():
    assert [report.hms(s) for s in (42, 300, 3900, 125)] == ["42 s", "5 min 00 s", "1 h 05 min", "2 min 05 s"]


def test_mercator(spark):
    rows = spark.createDataFrame([(88.49, 22.58), (0.0, 0.0), (-122.4, 37.8), (179.9, -84.0)], "lon double, lat double")
    back = rows.select("lon", "lat", geo.mercator_x("lon").alias("mx"), geo.mercator_y("lat").alias("my")).select("lon", "lat", geo.mercator_lon("mx").alias("a"), geo.mercator_lat("my").alias("b"), "mx", "my")
    for r in back.collect():
        assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-9
    z = rows.select(geo.resolution(F.lit(0)).alias("a"), geo.resolution(F.lit(1)).alias("b"), geo.zoom_for_resolution(F.lit(0.6)).alias("z"), geo.zoom_for_resolution(F.lit(0.0)).alias("top")).first()
    assert math.isclose(z.a, 156543.03392804097) and math.isclose(z.a, 2 * z.b) and z.z == 18 and z.top == 19
    t = spark.range(1).select(geo.tile_x(F.lit(1.0), F.lit(1)).alias("x"), geo.tile_y(F.lit(1.0), F.lit(1)).alias("y")).first()
    assert (t.x, t.y) == (1, 0)
    w = geo.ORIGIN
    assert tiles.tiles_in_bounds(spark, -w, -w, w, w, 2).count() == 16
    assert tiles.tiles_in_bounds(spark, -w, -w, w, w, 8, 50).count() == 50


def test_utm_and_codes(spark):
    e, n = geo.utm_forward(F.lit(0.0), F.lit(0.0), 31)
    got = spark.range(1).select(e.alias("e"), n.alias("n"), geo.utm_epsg(F.lit(88.4), F.lit(-5.0)).alias("c")).first()
    assert abs(got.e - 166021.443) < 0.001 and abs(got.n) < 1e-6 and got.c == 32745
    with pytest.raises(ValueError):
        geo.forward("lon", "lat", 2154)
    assert geo.is_valid_epsg(32645) and not geo.is_valid_epsg(1) and "45N" in geo.describe_epsg(32645)


def test_nadir_rotation_is_a_rotation(spark):
    rows = geo.nadir_rows(F.lit(37.0), F.lit(-70.0))
    m = np.array(spark.range(1).select(*[c.cast("double").alias(f"m{i}{j}") for i, r in enumerate(rows) for j, c in enumerate(r)]).first()).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and math.isclose(np.linalg.det(m), 1)
    rows = geo.nadir_rows(F.lit(None).cast("double"), F.lit(None).cast("double"))
    m = np.array(spark.range(1).select(*[c.cast("double").alias(f"m{i}{j}") for i, r in enumerate(rows) for j, c in enumerate(r)]).first()).reshape(3, 3)
    assert np.allclose(m, [[1, 0, 0], [0, -1, 0], [0, 0, -1]])


def test_marks_from_geotags_and_from_poses(spark):
    gcps = spark.createDataFrame([(1, "P", 100.0, 100.0, 20.0, False, True, 0.02, None), (2, "Q", 0.0, 0.0, 0.0, False, True, 0.02, None)], schema.GCPS)
    none = spark.createDataFrame([], schema.OBSERVATIONS)
    cam = cameras(spark, {**DRONE, "lon": 100.0, "lat": 100.0, "alt": 120.0})
    (m,) = control.mark_geotagged(gcps, cam, none, None).collect()
    assert abs(m.px - 2640) < 1 and abs(m.py - 1978) < 1
    assert control.mark_geotagged(gcps, cam, spark.createDataFrame([(1, 1, 5.0, 5.0)], schema.OBSERVATIONS), None).count() == 0
    views = spark.createDataFrame([(1, 5280, 3956, 0.0, 1.0, 0.0, 0.0, 3700.0, 3700.0, 2640.0, 1978.0, -100.0, 100.0, 150.0)],
                                  "cam_id long, width int, height int, qw double, qx double, qy double, qz double, fx double, fy double, ppx double, ppy double, tx double, ty double, tz double")
    world = spark.createDataFrame([(1, "P", 500100.0, 4000100.0, 20.0, False, True, 0.02, None)], schema.GCPS)
    (m,) = control.mark_solved(world, views, none, control.similarity_from([1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 5e5, 4e6, 0])).collect()
    assert abs(m.px - 2640) < 0.5 and abs(m.py - 1978) < 0.5


def test_similarity_recovers_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(0, 1, (3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    src = rng.normal(0, 50, (40, 3))
    dst = 1.7 * src @ q.T + [5e5, 4e6, 30]
    pairs = spark.createDataFrame(np.hstack([src, dst]).tolist(), "sx double, sy double, sz double, dx double, dy double, dz double")
    sim = control.fit_similarity(pairs)
    assert abs(sim.s - 1.7) < 1e-9 and np.allclose(sim.R, q, atol=1e-9) and np.allclose(sim.t, [5e5, 4e6, 30], atol=1e-6)
    assert control.rmse(control.residuals(pairs, sim)).first().rmse < 1e-6
    path = str(tmp_path / "sim.json")
    project.save_similarity(path, sim, "gcp")
    again, method = project.load_similarity(path)
    assert method == "gcp" and np.allclose(again.R, sim.R) and again.s == sim.s
    assert project.load_similarity(str(tmp_path / "none.json")) is None
    inv = sim.inverse()
    assert np.allclose(inv.s * inv.R @ dst[0] + inv.t, src[0], atol=1e-6)


def test_triangulation_recovers_a_point(spark):
    x = np.array([3.0, -2.0, 10.0])
    rows = []
    for cx in (-4.0, 0.0, 5.0):
        p = np.hstack([np.eye(3), [[-cx], [0], [0]]])
        u = p @ [*x, 1]
        rows.append((7, *map(float, p.ravel()), float(u[0] / u[2]), float(u[1] / u[2])))
    names = ["gcp_id long", *[f"p{i}{j} double" for i in range(3) for j in range(4)], "px double", "py double"]
    got = control.triangulate(spark.createDataFrame(rows, ", ".join(names))).first()
    assert np.allclose([got.x, got.y, got.z], x)


def test_bundle_adjustment_converges():
    rng = np.random.default_rng(0)
    pts = rng.normal(0, 5, (40, 3))
    rv, tv = rng.normal(0, 0.1, (4, 3)), np.column_stack([rng.normal(0, 1, (4, 2)), np.full(4, 40.0)])
    lens = np.array([900.0, 500, 400, 0.02])
    cam, pt = (a.ravel() for a in np.meshgrid(range(4), range(40), indexing="ij"))
    local = np.einsum("nij,nj->ni", control.rotation_matrix(rv)[cam], pts[pt]) + tv[cam]
    n = local[:, :2] / local[:, 2:]
    uv = n * (lens[0] * (1 + lens[3] * (n * n).sum(1)))[:, None] + lens[1:3]
    fixed = np.arange(40) < 8
    start = np.where(fixed[:, None], pts, pts + rng.normal(0, 0.1, pts.shape))
    out = control.bundle_adjust(rv + 0.01, tv + 0.1, lens, start, fixed, np.column_stack([cam, pt, uv]))
    assert out.rmse_before > 1 and out.rmse_after < 1e-3
    assert np.array_equal(out.points[:8], pts[:8])


def test_rotation_vectors_round_trip():
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.normal(0, 1.2, (50, 3)), np.zeros((1, 3)), [[np.pi, 0, 0], [0, 3.1, 0], [1e-9, 0, 0]]])
    m = control.rotation_matrix(r)
    assert np.allclose(control.rotation_matrix(control.rotation_vector(m)), m, atol=1e-7)


def rig(spark, marks=True):
    """A survey whose sparse model is a little off; marks and tracks are those of the true cameras."""
    rng = np.random.default_rng(5)
    centres = np.array([(x, y, 60.0) for x in (0.0, 20, 40) for y in (0.0, 15)])
    down = np.diag([1.0, -1, -1])
    ties, gcps = np.column_stack([rng.uniform(-10, 50, 80), rng.uniform(-10, 25, 80), rng.uniform(0, 4, 80)]), np.array([(0, 0, 1.0), (40, 0, 2), (0, 15, 0), (40, 15, 3), (20, 8, 1)])
    move = np.array([500_000.0, 2_500_000, 10])
    see = lambda c, p: (3000 * ((p - c) @ down.T)[:, :2] / ((p - c) @ down.T)[:, 2:]) + [2000, 1500]
    spin = control.rotation_matrix(rng.normal(0, 0.002, (6, 3))) @ down
    quats = []
    for r in spin:
        v = control.rotation_vector(r[None])[0]
        quats.append((float(np.cos(np.linalg.norm(v) / 2)), *map(float, v / np.linalg.norm(v) * np.sin(np.linalg.norm(v) / 2))))
    guess = (centres + rng.normal(0, 0.05, centres.shape)) / 2  # model units are two metres
    shift = -np.einsum("nij,nj->ni", spin, guess)
    views = [(k, f"i{k}.jpg", 1, *quats[k], *map(float, shift[k]), 3000.0, 3000.0, 2000.0, 1500.0, *map(float, guess[k]), 4000, 3000, True) for k in range(6)]
    names = "cam_id long, name string, camera_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, fx double, fy double, ppx double, ppy double, cx double, cy double, cz double, width int, height int, enabled boolean"
    tables = {
        "views": spark.createDataFrame(views, names),
        "cameras": cameras(spark, *[DRONE | dict(cam_id=k, path=f"/p/i{k}.jpg") for k in range(7)]),
        "tie_points": spark.createDataFrame([(k, *map(float, p / 2 + rng.normal(0, 0.02, 3)), 0.5) for k, p in enumerate(ties)], "pid long, x double, y double, z double, err double"),
        "tracks": spark.createDataFrame([(f"i{c}.jpg", k, *map(float, uv)) for c in range(6) for k, uv in enumerate(see(centres[c], ties))], "name string, pid long, u double, v double"),
        "gcps": spark.createDataFrame([(k, f"g{k}", *map(float, p + move), k == 4, True, 0.02, None) for k, p in enumerate(gcps)], schema.GCPS),
        "observations": spark.createDataFrame([(k, c, *map(float, uv)) for c in range(6) for k, uv in enumerate(see(centres[c], gcps))] if marks else [], schema.OBSERVATIONS),
    }
    return pipeline.Run(spark, project.Survey(), tables, log=lambda m: None), centres + move


@pytest.mark.parametrize("ties", [4000, 10])
def test_georef_adjusts_the_bundle(spark, monkeypatch, ties):
    monkeypatch.setattr(control, "MOST_TIES", ties)  # on the driver, and in tables
    run, truth = rig(spark)
    pipeline.georef(run)
    stats = run.survey.stats
    assert stats["georef_method"] == "gcp" and stats["gcp_control"] == 4 and stats["gcp_check"] == 1 and len(stats["georef_rmse_xyz_m"]) == 3 and stats["check_rmse_m"] > 0
    assert stats["ba_rmse_px"] < 0.05 < 1 < stats["ba_rmse_before_px"] and stats["ba_observations"] == 6 * 85
    assert abs(stats["calibration"]["focal_px"] - 3000) < 5
    placed = {r.cam_id: (r.est_x, r.est_y, r.est_z) for r in run.tables["cameras"].collect()}
    assert all(np.allclose(placed[k], truth[k], atol=0.05) for k in range(6)) and placed[6] == (None, None, None)
    errors = {r.gcp_id: r.error for r in run.tables["gcps"].collect()}
    assert all(0 <= errors[k] < 1 for k in range(5))


def test_georef_without_marks_keeps_the_fit(spark):
    run, _ = rig(spark, marks=False)
    with pytest.raises(Exception, match="georeferencing needs"):  # one place for all photos is no three
        run.tables["cameras"] = run.tables["cameras"].limit(2)
        pipeline.georef(run)
    assert control.refine(run.tables["views"], run.tables["tie_points"], run.tables["tracks"], run.tables["gcps"], run.tables["observations"], control.similarity_from([2, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0])) is None


@pytest.fixture
def dsm(spark):
    a = np.full((100, 100), 100.0)
    a[40:60, 40:60] = 105
    return raster(spark, a), RasterMeta(500000, 2500000, 0.5, 100, 100, 32645, -9999)


SQUARE = [(500015, 2499985), (500035, 2499985), (500035, 2499965), (500015, 2499965)]


def test_volumes(spark, dsm):
    cells, meta = dsm
    v = terrain.measure_volume(cells, meta, SQUARE).first()
    assert abs(v.cut_m3 - 500) < 10 and abs(v.area_m2 - 400) < 1e-6 and v.base_z_min == 100 and v.fill_m3 == 0 and not v.warnings
    pit = cells.withColumn("value", F.when(F.col("value") == 105, 96.0).otherwise(F.col("value")))
    assert abs(terrain.measure_volume(pit, meta, SQUARE).first().fill_m3 - 400) < 8
    x = meta.minx + (F.col("col") + 0.5) * meta.cell
    slope = cells.withColumn("value", 100 + 0.1 * (x - meta.minx))
    ring = [(500010, 2499990), (500040, 2499990), (500040, 2499960), (500010, 2499960)]
    assert abs(terrain.measure_volume(slope, meta, ring, "fit").first().net_m3) < 5
    assert terrain.measure_volume(slope, meta, ring, "lowest").first().cut_m3 > 100
    assert terrain.measure_volume(cells, meta, SQUARE, "custom", 99.0).first().cut_m3 > 800
    hole = cells.where("not (row between 45 and 54 and col between 45 and 69)")
    v = terrain.measure_volume(hole, meta, [(500020, 2499980), (500030, 2499980), (500030, 2499970), (500020, 2499970)])
    assert v.first().coverage < 0.8 and any("falls" in w or "fall" in w for w in v.first().warnings)
    assert "Net" in terrain.measure_volume(cells, meta, SQUARE).select(terrain.volume_summary().alias("s")).first().s
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1, 0), (1, 1)]):
        with pytest.raises(ValueError):
            terrain.measure_volume(cells, meta, bad)
    with pytest.raises(ValueError):
        terrain.measure_volume(cells, meta, SQUARE, "other")


def test_contours_of_a_cone(spark, tmp_path):
    r, c = np.indices((80, 80))
    dist = np.hypot(r - 39.5, c - 39.5) / 40
    cone = np.where(dist <= 1, 100 + 20 * (1 - dist), 100.0)
    meta = RasterMeta(500000, 2500000, 1.0, 80, 80, 32645)
    lines = terrain.contours(raster(spark, cone), meta, 5.0, 0.5)
    rows = lines.collect()
    assert {105.0, 110.0, 115.0} <= {x.level for x in rows} and all(x.is_index == (round(x.level / 5) % 5 == 0) for x in rows)
    ring = max((x for x in rows if x.level == 110), key=lambda x: len(x.coords))
    radius = [math.hypot(p.x - 500040, p.y - 2499960) for p in ring.coords]
    assert abs(np.mean(radius) - 20) < 1 and ring.coords[0] == ring.coords[-1]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            terrain.contours(raster(spark, cone), meta, bad)
    with pytest.raises(ValueError):
        terrain.contours(raster(spark, cone), meta, 0.001)
    paths = products.write_contours(lines, str(tmp_path), "c", 32645)
    doc = json.load(open(paths[2]))
    assert len(doc["features"]) == len(rows) and doc["crs"]["properties"]["name"].endswith("32645")
    text = open(paths[1]).read()
    assert text.count("POLYLINE\n") == len(rows) and text.endswith("EOF\n") and "CONTOUR_MAJOR" in text
    assert open(paths[0], "rb").read()[:4] == b"\x00\x00\x27\x0a" and os.path.getsize(str(tmp_path / "c.dbf")) > 60


def test_heightfield(spark):
    r, c = np.indices((10, 10))
    rows = [(int(i), float(x) * 0.5, float(y) * 0.5, 5.0, 10, 20, 30) for i, (y, x) in enumerate(zip(r.ravel(), c.ravel(), strict=True))]
    points = spark.createDataFrame(rows, "pt_id long, x double, y double, z double, r int, g int, b int")
    verts, faces = terrain.heightfield(points, 0.5)
    assert verts.count() == 100 and faces.count() == 162
    far = points.unionByName(points.withColumn("x", F.col("x") + 50).withColumn("pt_id", F.col("pt_id") + 100))
    v, f = terrain.heightfield(far, 0.5)
    x = {q.vid: q.x for q in v.collect()}
    assert all(max(x[q.a], x[q.b], x[q.c]) - min(x[q.a], x[q.b], x[q.c]) < 2 for q in f.collect())
    assert sorted(q.vid for q in v.collect()) == list(range(200))


def test_obj_and_ply(spark, tmp_path):
    lines = ["mtllib a.mtl", "v 10 0 5 0.5", "v 0 1 0", "v 1 1 1", "vn 1 0 0", "vt 0 0", "f 1 2 3"]
    df = spark.createDataFrame([("o", k, v) for k, v in enumerate(lines)], "path string, pos int, value string")
    sim = control.similarity_from([2, 0, -1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0])
    out = [r.value for r in text_models.transform_obj(df, sim, (0.0, 20.0, 0.0)).orderBy("pos").collect()]
    assert out[1] == "v 0.0000 0.0000 10.0000 0.5" and out[4] == "vn 0.0000 1.0000 0.0000" and out[0] == "mtllib a.mtl" and out[6] == "f 1 2 3"
    assert text_models.obj_counts(df).first() == (3, 1) and text_models.first_vertex(df).first() == (10.0, 0.0, 5.0)
    files = spark.createDataFrame([(bytearray(b"ply\nformat ascii 1.0\nelement vertex 3\nelement face 17821866\nend_header\n"),), (bytearray(b"ply\nend_header\nelement face 3"),)], "content binary")
    assert sorted(r.faces for r in binary.ply_faces(files).collect()) == [0, 17821866]
    path = tmp_path / "a.ply"
    path.write_bytes(b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 2\n3 0 1 2\n")
    assert [tuple(r)[3:] for r in binary.read_ply(spark, str(path)).orderBy("pt_id").collect()] == [(0.0, 200, 200, 200), (0.0, 200, 200, 200), (2.0, 200, 200, 200)]
    verts, faces = binary.parse_ply(path.read_bytes())
    assert len(verts) == 3 and faces.tolist() == [[0, 1, 2]]


def test_las_round_trip(spark, tmp_path):
    binary.register(spark)
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.uniform(0, 100, 3) + [5e5, 2e6, 0]), k % 256, 7, 255, k % 8) for k in range(200)]
    points = spark.createDataFrame(rows, schema.POINTS).repartition(3)
    path = str(tmp_path / "a.las")
    assert clouds.write_las(points, path) == path
    back = {r.pt_id: r for r in spark.read.format("las").load(path).collect()}
    assert len(back) == 200 and not [p for p in os.listdir(tmp_path) if "part" in p]
    for k, x, y, z, r, g, b, cls in rows:
        q = back[k]
        assert abs(q.x - x) < 6e-4 and abs(q.y - y) < 6e-4 and abs(q.z - z) < 6e-4 and (q.r, q.g, q.b, q.cls) == (r, g, b, cls)


def test_geotiff_round_trip_and_pruning(spark, tmp_path):
    binary.register(spark)
    a = np.random.default_rng(0).normal(0, 1, (300, 520)).astype(np.float32)
    a[5, 5] = np.nan
    path = binary.write_geotiff(str(tmp_path / "a.tif"), a, 500000, 2500000, 0.5, 32645)
    info = binary.geotiff_info(path)
    assert (info["w"], info["h"], info["epsg"], info["cell"], info["minx"], info["maxy"]) == (520, 300, 32645, 0.5, 500000, 2500000)
    df = spark.read.format("geotiff").load(path)
    assert df.count() == a.size and df.where("value is null").count() == 1
    assert df.where("row >= 10 and row < 12 and col >= 300 and col < 303").agg(F.sum("value")).first()[0] == pytest.approx(float(a[10:12, 300:303].sum()), abs=1e-5)
    rgba = np.random.default_rng(1).integers(0, 255, (4, 40, 30), np.uint8)
    path = binary.write_geotiff(str(tmp_path / "b.tif"), rgba, 0, 0, 1)
    got = spark.read.format("geotiff").load(path)
    assert got.where("band = 4").count() == 1200 and got.where("band = 2 and row = 3 and col = 4").first().value == rgba[1, 3, 4]


@pytest.mark.parametrize(("dtype", "predictor"), [("float32", 1), ("float32", 3), ("float64", 3), ("uint8", 2), ("int16", 2), ("uint16", 1)])
@pytest.mark.parametrize("big", [False, True])
def test_geotiff_predictors_and_overviews(spark, tmp_path, dtype, predictor, big):
    binary.register(spark)
    a = (np.random.default_rng(3).normal(0, 300, (2, 300, 270))).astype(dtype)
    path = binary.write_geotiff(str(tmp_path / "p.tif"), a, 5, 9, 0.5, 32645, predictor=predictor, overviews=2, big=big)
    assert open(path, "rb").read(4) == (b"II+\0" if big else b"II*\0")
    for level in range(3):
        info, want = binary.geotiff_info(path, level), a
        for _ in range(level):
            want = binary.halved(want)
        assert (info["w"], info["h"], info["cell"], info["bands"]) == (want.shape[2], want.shape[1], 0.5 * 2**level, 2)
        got = np.zeros(want.shape)
        for r in spark.read.format("geotiff").option("overview", level).load(path).toPandas().itertuples():
            got[r.band - 1, r.row, r.col] = r.value
        assert np.array_equal(got, want.astype(float))
    with pytest.raises(ValueError, match="no overview"):
        binary.geotiff_info(path, 3)


def test_geotiff_directory_at_the_end(spark, tmp_path):
    """What other writers do: blocks first, big-endian, and codes that are not supported."""
    binary.register(spark)
    values = np.arange(6, dtype=">u2").reshape(2, 3)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, 12)]

    def write(name, tags):
        body = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags)
        (tmp_path / name).write_bytes(b"MM\0*" + struct.pack(">I", 20) + values.tobytes() + struct.pack(">H", len(tags)) + body + b"\0" * 4)
        return spark.read.format("geotiff").load(str(tmp_path / name))

    assert {(r.row, r.col): r.value for r in write("a.tif", tags).collect()} == {(r, c): 3.0 * r + c for r in range(2) for c in range(3)}
    for bad in ((259, 3, 1, 7), (317, 3, 1, 9)):
        some = sorted([t for t in tags if t[0] != bad[0]] + [bad])
        with pytest.raises(Exception, match="not supported"):
            write(f"{bad[0]}.tif", some).collect()


def test_rasters_are_written_by_tiles(spark, tmp_path):
    binary.register(spark)
    rng = np.random.default_rng(6)
    a = rng.normal(0, 50, (700, 600)).astype(np.float32)
    a[:, 300:] = np.nan  # one column of tiles has no cell at all
    meta = RasterMeta(5.0, 9.0, 0.5, 600, 700, 32645)
    cells = spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a) if v == v], "row long, col long, value double").repartition(5)
    path = products.write_cog(cells, meta, str(tmp_path / "c.tif"))
    for level, want in enumerate([a, binary.halved(a[None])[0], binary.halved(binary.halved(a[None]))[0]]):
        info = binary.geotiff_info(path, level)
        assert (info["h"], info["w"], info["cell"], info["epsg"]) == (*want.shape, 0.5 * 2**level, 32645)
        if level < 2:
            got = np.full(want.shape, np.nan)
            for r in spark.read.format("geotiff").option("overview", level).load(path).where("value is not null").toPandas().itertuples():
                got[r.row, r.col] = r.value
            assert np.allclose(got, want, atol=1e-4, equal_nan=True)
    plain = spark.read.format("geotiff").load(products.write_raster(cells, meta, str(tmp_path / "r.tif"), "int16", -9999.0))
    assert plain.where("value is not null").count() == 700 * 300 and plain.where("row = 3 and col = 4").first().value == round(float(a[3, 4]))
    colours = cells.where("row < 40 and col < 30").select("row", "col", (F.col("row") % 256).alias("red"), F.lit(7).alias("green"), (F.col("col") % 256).alias("blue"), F.lit(255).alias("alpha"))
    got = spark.read.format("geotiff").load(products.write_ortho(colours, RasterMeta(0.0, 0.0, 1.0, 30, 40), str(tmp_path / "o.tif")))
    assert got.count() == 4 * 1200 and {r.band: r.value for r in got.where("row = 17 and col = 21").collect()} == {1: 17, 2: 7, 3: 21, 4: 255}


def test_ply_ids_go_on(spark, tmp_path):
    for name, n in (("b", 2), ("a", 3)):
        rows = "".join(f"{k} 0 0\n" for k in range(n))
        (tmp_path / f"{name}.ply").write_text(f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n{rows}")
    got = sorted((r.pt_id, r.x) for r in binary.read_ply(spark, str(tmp_path)).collect())
    assert got == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 0.0), (4, 1.0)]


def test_volume_without_a_valid_cell(spark):
    meta = schema.RasterMeta(0.0, 100.0, 1.0, 100, 100)
    dsm = spark.range(10_000).select(F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"), F.lit(None).cast("double").alias("value"))
    with pytest.raises(Exception, match="no valid surface cells"):
        terrain.measure_volume(dsm, meta, [(20, 20), (40, 20), (40, 40), (20, 40)], "custom", 1.0).collect()


def test_lzw_known_stream():
    # 7,7,7,8,8,7,7,6,6 as in the format's specification: clear, 7, 258, 8, 8, 258, 6, 6, end.
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    size = 9 * len(codes)
    raw = (bits << (-size % 8)).to_bytes((size + 7) // 8, "big")
    assert binary.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_exif(spark):
    head = binary.exif_bytes("DJI", "M3E", -22.58, 88.49, -12.5, 12.29, "2024:05:06 07:08:09", (5280, 3956))
    jpeg = b"\xff\xd8\xff\xe1" + (len(head) + 8).to_bytes(2, "big") + b"Exif\x00\x00" + head + b"\xff\xda"
    for content in (head, jpeg):
        got = binary.parse_exif(content)
        assert (got["make"], got["model"], got["width"], got["height"], got["datetime"]) == ("DJI", "M3E", 5280, 3956, "2024:05:06 07:08:09")
        assert abs(got["lat"] + 22.58) < 1e-6 and abs(got["lon"] - 88.49) < 1e-6 and got["alt"] == -12.5 and abs(got["focal_mm"] - 12.29) < 1e-9
    assert binary.parse_exif(b"nothing")["width"] == 0
    df = spark.createDataFrame([("p", bytearray(jpeg)), ("q", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.width for r in binary.photo_headers(df).collect()} == {"p": 5280, "q": 0}


def test_control_point_lists(spark):
    def read(*lines, **more):
        return {r.label: r for r in text_models.control_points(spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "path string, pos int, value string"), **more).collect()}

    got = read("﻿label,x,y,z,type", "A,1,2,3,control", "B, 4,,5,6,check", "C,1,2", "D,a,b,c", "E,1,2,3,c")
    assert set(got) == {"A", "B", "E"} and not got["A"].is_check and got["B"].is_check and got["E"].is_check and got["B"].z == 6
    assert read("h", "A,1,2,3,control", literal_types=True)["A"].is_check
    assert read("A\t1\t2\t3", has_header=False)["A"].y == 2
    assert read("h", "A 1 2 3")["A"].z == 3


def test_marks_catalog(spark):
    marks = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 6.0, 6.0)], schema.OBSERVATIONS)
    change = spark.createDataFrame([(1, 1, 9.0, 9.0), (1, 2, None, None), (2, 1, 3.0, 3.0)], schema.OBSERVATIONS)
    assert {(r.gcp_id, r.cam_id): r.px for r in control.upsert_marks(marks, change).collect()} == {(1, 1): 9.0, (2, 1): 3.0}
    new = control.append_photos(cameras(spark, DRONE), cameras(spark, {**DRONE, "path": "b"}, {**DRONE, "path": "a"}).drop("cam_id"), 7)
    assert {r.path: r.cam_id for r in new.collect()} == {"/a/b/IMG 1.JPG": 1, "a": 7, "b": 8}


def test_project_round_trip(tmp_path):
    s = project.Survey("S", cameras=[DRONE], settings=Settings(build_mesh=True), stats={"a": {"b": [1, 2]}})
    path = str(tmp_path / "p.json")
    project.save(path, [s])
    (again,), active = project.load(path)
    assert again == s and active == 0
    assert Settings.from_dict({"nonsense": 1, "dense_quality": "low"}).dense_quality == "low"
    with pytest.raises(ValueError):
        project.Survey.from_dict({"cameras": [{"odd": 1}]})
    with pytest.raises(ValueError):
        Settings(max_raster_dim=5).check()
    json.dump({"chunks": []}, open(path, "w"))
    assert project.load(path)[0] == [project.Survey()]


def test_export(tmp_path):
    for n in ("m.obj", "m.mtl", "m_offset.txt", "d.tif"):
        (tmp_path / n).write_text(n)
    done = project.export({"mesh": str(tmp_path / "m.obj"), "dsm": str(tmp_path / "d.tif"), "dtm": "missing"}, str(tmp_path / "out"))
    assert [d[0] for d in done] == ["mesh", "dsm"] and sorted(os.listdir(tmp_path / "out")) == ["d.tif", "m.mtl", "m.obj", "m_offset.txt"]


def test_tiles_and_kml(spark, tmp_path):
    image = np.zeros((4, 5, 4), np.uint8)
    image[1, 2] = (1, 2, 3, 255)
    assert np.array_equal(tiles.unpng(tiles.png(image)), image)
    cells = spark.createDataFrame([(r, c, 200, 10, 10, 0 if r > 34 and c < 5 else 255) for r in range(40) for c in range(40)], "row long, col long, red int, green int, blue int, alpha int")
    low, high = tiles.zoom_range(40, 9_840_000, 2_570_000, 9_840_160, 2_570_160)
    assert low <= high and tiles.zoom_range(40, 0, 0, 160, 160, 15, 13) == (13, 15)
    place = RasterMeta(9_840_000, 2_570_160, 4.0, 40, 40, 3857)
    meta = products.write_tiles(cells, place, str(tmp_path), (14, 16))
    assert meta["bounds_3857"] == [9_840_000, 2_570_000, 9_840_160, 2_570_160] and not [n for n in os.listdir(tmp_path) if "part" in n]
    assert meta["tiles"] == sum(f.endswith(".png") for _, _, fs in os.walk(tmp_path) for f in fs) and json.load(open(tmp_path / "tiles.json"))["max_zoom"] == 16
    with pytest.raises(ValueError, match="coordinate system"):
        products.write_tiles(cells, RasterMeta(0, 160, 4.0, 40, 40), str(tmp_path))
    for root, _, files in os.walk(tmp_path):
        for f in files:
            if f.endswith(".kml"):
                text = open(os.path.join(root, f)).read()
                for href in [h.split("</href>")[0] for h in text.split("<href>")[1:]]:
                    assert os.path.exists(os.path.join(root, href)), href


def test_gains_level_exposures(spark):
    rng = np.random.default_rng(0)
    true = {"a": 1.2, "b": 1.0, "c": 0.85}
    rows = []
    for k in range(600):
        i, j = rng.choice(list(true), 2, replace=False)
        base = rng.uniform(60, 150)
        rows += [(k, i, 1, *[base * true[i]] * 3), (k, j, 2, *[base * true[j]] * 3)]
    colors = spark.createDataFrame([(int(a), str(b), c, *map(float, v)) for a, b, c, *v in rows], "sample long, site string, rank int, red double, green double, blue double")
    gains = ortho.solve_gains(ortho.pair_ratios(colors), sorted(true))
    level = [true[s] * gains[s][0] for s in sorted(true)]
    assert max(level) / min(level) < 1.01
    assert all((g == 1).all() for g in ortho.solve_gains(ortho.pair_ratios(colors.where("sample < 10")), sorted(true)).values())


def test_scene_and_forest(spark):
    scene = ml.scene(spark, [7])
    n = {r.cls: r.n for r in scene.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[2] == 55_000 and n[6] == 12_600 and 40 * 250 <= n[5] < 40 * 600
    assert scene.select("pt_id").distinct().count() == sum(n.values())
    roof = scene.where("cls = 6 and x > 130 and y > 120 and y < 144").agg(F.stddev_pop("z")).first()[0]
    assert roof < 0.08
    small = cloud.features(ml.scene(spark, [11], noise=True).where("x < 70 and y < 70").drop("seed"), 8)
    trained = ml.train(small, trees=15, depth=8)
    assert trained.accuracy > 0.95 and abs(sum(trained.importances.values()) - 1) < 1e-6


def test_pipeline_stops_at_the_first_failure(spark):
    run = pipeline.Run(spark, project.Survey(), {"cameras": cameras(spark)}, log=lambda m: None)
    ok, why = pipeline.execute(run)
    assert not ok and why.startswith("align") and run.survey.stats["stage_seconds"] == {}
    assert "mesh" not in pipeline.plan(project.Survey()) and "mesh" in pipeline.plan(project.Survey(settings=Settings(build_mesh=True)))


def test_pipeline_runs_from_a_cloud(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 30, (3000, 2))
    z = np.where((xy[:, 0] > 10) & (xy[:, 0] < 16) & (xy[:, 1] > 10) & (xy[:, 1] < 16), 6.0, 0.0) + rng.normal(0, 0.02, 3000)
    local = spark.createDataFrame([(k, float(x), float(y), float(h), 120, 110, 100) for k, ((x, y), h) in enumerate(zip(xy, z, strict=True))], "pt_id long, x double, y double, z double, r int, g int, b int")
    survey = project.Survey(settings=Settings(surface_gsd_mode="custom", surface_gsd=1.0, ortho_gsd_mode="custom", ortho_gsd=1.0), vertical_datum="orthometric", geoid_separation=2.0)
    run = pipeline.Run(spark, survey, {"cameras": cameras(spark, DRONE), "dense_local": local}, log=lambda m: None)
    ok, why = pipeline.execute(run, ["align", "dense", "mesh", "classify", "dsm", "dtm", "ortho"])
    assert ok, why
    assert abs(run.tables["dsm"].agg(F.max("value")).first()[0] - 4) < 0.3 and run.tables["dtm"].agg(F.max("value")).first()[0] < -1
    assert run.tables["ortho"].where("alpha = 255").count() == run.grids["ortho"].nx * run.grids["ortho"].ny
    page = report.generate(survey, run.tables["cameras"], spark.createDataFrame([], schema.GCPS), run.tables["classified"])
    assert "Ground" in page and "DJI M3E" in page and "3,000 points" in page


def test_photo_pixels(spark, tmp_path):
    from skyraster.sources import photos

    image = np.zeros((3, 4, 4), np.uint8)
    image[..., 3] = 255
    image[1, 2, :3] = (250, 100, 5)
    (tmp_path / "a b.png").write_bytes(tiles.png(image))
    (tmp_path / "note.txt").write_text("no photo")
    assert [r.path.rsplit("/", 1)[1] for r in photos.find_photos(spark, str(tmp_path)).collect()] == ["a b.png"]
    (row,) = photos.read_photos(spark, str(tmp_path / "*.png")).collect()
    assert (row.h, row.w) == (3, 4) and np.frombuffer(row.data, np.uint8).reshape(3, 4, 3)[1, 2].tolist() == [250, 100, 5]
    plain = photos.image_sizes(photos.read_photos(spark, str(tmp_path / "*.png")))
    assert photos.camera_set(plain, plain.limit(0)) is plain


def test_reach_loses_no_mark(spark, monkeypatch):
    """Straight, tilted and flat views, from near and far: the same marks as when every view meets every point."""
    rng = np.random.default_rng(0)
    gcps = spark.createDataFrame([(k, f"g{k}", *map(float, rng.uniform(-400, 400, 2)), float(rng.uniform(-20, 20)), False, True) for k in range(60)], "gcp_id long, label string, x double, y double, z double, is_check boolean, enabled boolean")
    none = spark.createDataFrame([], "gcp_id long, cam_id long, px double, py double")
    sim = control.similarity_from([2.5, *(0, -1, 0, 1, 0, 0, 0, 0, 1), 10, -20, 5])
    rows = []
    for k in range(80):
        axis, angle = rng.normal(size=3), rng.uniform(0, np.pi if k % 4 == 0 else 0.5)
        turn = control.rotation_matrix(axis / np.linalg.norm(axis) * angle)[0] @ np.diag([1.0, -1.0, -1.0])
        centre = np.array([*rng.uniform(-150, 150, 2), rng.uniform(10, 120)])
        q = np.array([1 + np.trace(turn), turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]])
        if np.linalg.norm(q) < 1e-3:
            continue
        rows.append((k, *map(float, q / np.linalg.norm(q)), *map(float, -turn @ centre), 900.0, 950.0, 500.0, 420.0, 1000, 800))
    views = spark.createDataFrame(rows, "cam_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, fx double, fy double, ppx double, ppy double, width int, height int")
    cams = spark.createDataFrame([(k, f"/p/{k}.jpg", 1000, 800, "DJI", "M3E", 12.29, 24.0, *map(float, rng.uniform(-0.004, 0.004, 2)), float(rng.uniform(-5, 120)), [None, 60.0, 3.0][k % 3], float(rng.uniform(0, 360)), [-90.0, -60.0, -20.0, None][k % 4], True) for k in range(80)],
                                "cam_id long, path string, width int, height int, make string, model string, focal_mm double, focal35_mm double, lat double, lon double, alt double, rel_alt double, yaw double, pitch double, enabled boolean")
    lists = lambda: [sorted(map(tuple, f().collect())) for f in (lambda: control.mark_solved(gcps, views, none, sim, 100), lambda: control.mark_geotagged(gcps, cams, none, 3857, 0.0, 100))]
    got = lists()
    monkeypatch.setattr(control, "_within_reach", lambda views, points: views.crossJoin(points))
    want = lists()
    assert got == want and all(len(x) > 100 for x in want)


def test_numbers_go_on(spark):
    rows = spark.createDataFrame([(f"p{k:04d}",) for k in np.random.default_rng(0).permutation(500)], "path string").repartition(7)
    got = tables.numbered(rows, ["path"], "n", 10).collect()
    assert {(r.path, r.n) for r in got} == {(f"p{k:04d}", 10 + k) for k in range(500)}
    assert tables.numbered(rows.limit(0), ["path"], "n").count() == 0


def test_mesh_of_an_engine(spark):
    """An engine's OBJ moves into the survey's system; a round offset is taken off its vertices."""
    text = ["mtllib m.mtl", "v 1 2 3", "v 4 5 6 0.5 0.5 0.5", "vt 0 0", "vn 0 0 1", "f 1/1/1 2/1/1 1/1/1"]
    lines = spark.createDataFrame([("m.obj", k, t) for k, t in enumerate(text)], "path string, pos int, value string")
    sim = control.similarity_from([2, 0, -1, 0, 1, 0, 0, 0, 0, 1, 500_000, 4_000_000, 50])
    run = pipeline.Run(spark, project.Survey(), {"engine_obj": lines}, sim=sim, log=lambda m: None)
    assert pipeline.execute(run, ["mesh"]) == (True, "")
    got = [r.value for r in run.tables["mesh_lines"].orderBy("pos").collect()]
    assert got == ["mtllib m.mtl", "v 96.0000 2.0000 56.0000", "v 90.0000 8.0000 62.0000 0.5 0.5 0.5", "vt 0 0", "vn 0.0000 0.0000 1.0000", "f 1/1/1 2/1/1 1/1/1"]
    assert run.survey.stats["mesh_offset"] == [499_900.0, 4_000_000.0, 0.0] and (run.survey.stats["mesh_vertices"], run.survey.stats["mesh_faces"]) == (2, 1)
    assert run.spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    run.tables["engine_obj"] = lines.where("pos > 2")
    assert not pipeline.execute(run, ["mesh"])[0]


def test_gains_of_many_photos_take_few_steps(monkeypatch):
    """Two strips of photos and one by itself: the least solution, each set with a mean of 0, in steps that hardly grow with the photos."""
    rng, steps, times = np.random.default_rng(6), [], ortho._Graph.times
    for side in (12, 96):
        n = side * side
        at = np.arange(n).reshape(side, side)
        i, j = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
        keep = np.minimum(i, j) // side != np.maximum(i, j) // side
        keep = ~keep | (i // side != side // 2)  # cut in the middle
        i, j = i[keep], j[keep]
        w, y = rng.integers(5, 90, len(i)).astype(float), rng.normal(0, 0.1, (len(i), 3))
        right = np.zeros((n + 1, 3))
        np.add.at(right, i, w[:, None] * y)
        np.add.at(right, j, -w[:, None] * y)
        graph, count = ortho._Graph(n + 1, i, j, w), [0]
        monkeypatch.setattr(graph, "times", lambda x, g=graph, c=count: c.__setitem__(0, c[0] + 1) or times(g, x))
        got = graph.solve(right)
        steps.append(count[0])
        assert len(np.unique(graph.parts())) == 3 and np.abs(times(graph, got) - right).max() < 1e-9
        if side == 12:
            a = np.zeros((len(i), n + 1))
            a[np.arange(len(i)), i], a[np.arange(len(i)), j] = w**0.5, -(w**0.5)
            assert np.allclose(got, np.linalg.lstsq(a, y * w[:, None] ** 0.5, rcond=None)[0], atol=1e-9)
    assert steps[1] < 200
