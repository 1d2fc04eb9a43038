from __future__ import annotations

import json
import math
import os
import subprocess
import sys
from xml.etree import ElementTree

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyraster.operators import control, grid, ml, morph, ortho, terrain
from skyraster.plans import adapters, catalog, queries_catalog, queries_grid, queries_model
from skyraster.plans.tables import cut

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in adapters.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([[None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[k] for k in order)] for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"forest_classes", "triangulate"}))
def test_query_without_sql_has_rows(spark, name):  # triangulate: no point has two rays at this scale, see below
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    """A tree without the training-data subpackage and the corpus pipeline still imports."""
    subprocess.run(["cp", "-r", f"{ROOT}/skyraster", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/skyraster/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_true_ortho_covers_the_surface(spark):
    meta = grid.plan(adapters.load(spark, SF, "points"), 5.0)
    got = catalog.QUERIES["true_ortho"](spark, SF)
    assert got.agg(F.count(F.lit(1)), F.max("row") + 1, F.max("col") + 1).first() == (meta.nx * meta.ny, meta.ny, meta.nx)


def test_bundle_adjusts_all_tie_points(spark):
    """What the query finds is what the dense solver finds on the same rows."""
    n, m = (adapters.load(spark, SF, t).count() for t in ("tie_points", "gcps"))
    got = catalog.QUERIES["bundle"](spark, SF).first()
    points, observed, turns, shifts = queries_model._flight(spark, SF)
    seen = min(4, len(turns)), min(6, len(turns))
    assert n > 60 and got.n_obs == seen[0] * n + seen[1] * m and got.rmse_after < 0.5 < got.rmse_before
    rows = points.orderBy("pid").toPandas()
    place = {p: k for k, p in enumerate(rows["pid"])}
    obs = np.array([(r.cam, place[r.pid], r.u, r.v) for r in observed.collect()])
    want = control.bundle_adjust(turns, shifts, np.array([3700.0, 2640, 1978, 0]), rows[["x", "y", "z"]].to_numpy(float), rows["fixed"].to_numpy(bool), obs)
    assert np.isclose(got.rmse_before, want.rmse_before, rtol=1e-9) and np.isclose(got.rmse_after, want.rmse_after, rtol=1e-6)


def test_forest_is_trained_with_the_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "train", lambda data, **settings: seen.append(settings) or ml.Trained(None, 0.0, data, {}))
    catalog.QUERIES["forest_classes"](spark, SF)
    assert seen == [{}]


def test_triangulate_finds_the_control_points(spark):
    want = {r.gcp_id: (r.x, r.y, r.z) for r in adapters.load(spark, "/root/testdata/sf0.01", "gcps").collect()}
    got = catalog.QUERIES["triangulate"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) > 20 and all(np.allclose((r.x, r.y, r.z), want[r.gcp_id], atol=1e-5) for r in got)


def test_gains_by_dense_least_squares(spark):
    ratios = queries_model._colors(spark, SF)
    rows = ortho.pair_ratios(ratios).collect()
    got = {r.site: (r.red, r.green, r.blue) for r in catalog.QUERIES["camera_gains"](spark, SF).collect()}
    sites, used = sorted(got), [r for r in rows if r.n >= 5]
    a, y = np.zeros((len(used) + 1, len(sites))), np.zeros((len(used) + 1, 3))
    for k, r in enumerate(used):
        a[k, sites.index(r.ci)], a[k, sites.index(r.cj)], y[k] = r.n**0.5, -(r.n**0.5), np.array((r.red, r.green, r.blue)) * r.n**0.5
    a[-1] = 10
    want = np.clip(np.exp(np.linalg.lstsq(a, y, rcond=None)[0]), 0.6, 1.6)
    assert used and np.allclose([got[s] for s in sites], want, atol=1e-9)


def test_similarity_by_singular_values(spark):
    rows = adapters.load(spark, SF, "pairs").collect()
    src, dst = (np.array([[r[f"{p}{c}"] for c in "xyz"] for r in rows]) for p in "sd")
    a, b = src - src.mean(0), dst - dst.mean(0)
    u, d, vt = np.linalg.svd(b.T @ a / len(a))
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    got = catalog.QUERIES["similarity_fit"](spark, SF).first()
    r = u @ flip @ vt
    s = (d * np.diag(flip)).sum() / a.var(0).sum()
    assert np.allclose(got.r, r.reshape(-1), atol=1e-9) and abs(got.s - s) < 1e-9 and np.allclose(got.t, dst.mean(0) - s * r @ src.mean(0), atol=1e-5)


def test_contour_lines_hold_their_segments(spark):
    surface, meta = queries_grid._surface(spark, SF)
    segments = terrain.contour_segments(cut(morph.smooth_valid(surface, meta), "smooth"), 2.0).toPandas()
    want = (np.hypot(segments.r1 - segments.r2, segments.c1 - segments.c2) * meta.cell).groupby(segments.k).sum()
    lines = terrain.contours(surface, meta, 2.0).collect()
    length = {}
    for r in lines:
        xy = np.array([(p.x, p.y) for p in r.coords])
        length[round(r.level / 2)] = length.get(round(r.level / 2), 0) + np.hypot(*np.diff(xy, axis=0).T).sum()
    assert all(abs(length[k] - v) < 1e-4 * v + 1e-6 for k, v in want.items() if v > 1) and all(r.is_index == (round(r.level / 2) % 5 == 0) for r in lines)


def test_features_by_numpy(spark):
    """All nine features of every point, from its fifteen nearest points."""
    got = {r.pt_id: r for r in catalog.QUERIES["cloud_features"](spark, SF).collect()}
    ids = sorted(got)
    xyz, rgb = (np.array([[float(got[i][c]) for c in cs] for i in ids]) for cs in ("xyz", "rgb"))
    low = {}
    cells = [tuple(np.minimum(np.floor((p[:2] - xyz[:, :2].min(0)) / 3), np.ceil(np.ptp(xyz[:, :2], axis=0) / 3)).astype(int)) for p in xyz]
    for c, p in zip(cells, xyz, strict=True):
        low[c] = min(low.get(c, np.inf), p[2])
    for k, i in enumerate(ids):
        d2 = ((xyz - xyz[k]) ** 2).sum(1)
        near = xyz[np.lexsort((ids, d2))[:15]]
        value, vector = np.linalg.eigh(np.cov(near.T, bias=True))
        l3, l2, l1 = value
        light = rgb[k].sum() + 1e-6
        want = dict(hag=xyz[k, 2] - low[cells[k]], planarity=(l2 - l3) / l1, linearity=(l1 - l2) / l1, sphericity=l3 / l1, surface_variation=l3 / value.sum(), verticality=1 - abs(vector[2, 0]),
                    z_range=np.ptp(near[:, 2]), greenness=(2 * rgb[k, 1] - rgb[k, 0] - rgb[k, 2]) / light, brightness=light / 3 / 255)
        assert np.allclose([got[i][c] for c in want], list(want.values()), atol=1e-7), i


def test_samples_lie_on_their_faces(spark):
    """A point for each square metre of a face, within it, and all vertices."""
    verts, faces = terrain.heightfield(adapters.load(spark, SF, "points"), 5.0)
    at = {r.vid: np.array((r.x, r.y, r.z)) for r in verts.collect()}
    corners = np.array([[at[r.a], at[r.b], at[r.c]] for r in faces.collect()])
    area = np.linalg.norm(np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]), axis=1) / 2
    rows = catalog.QUERIES["mesh_samples"](spark, SF).toPandas().to_numpy()
    assert len(rows) == len(at) + np.minimum(np.ceil(area), 64).sum()
    known = {tuple(np.round(v, 9)) for v in at.values()}
    extra = np.array([r for r in rows if tuple(np.round(r, 9)) not in known])
    for p in extra[::50]:
        weights = [np.linalg.solve(np.vstack([c[:, :2].T, np.ones(3)]), [*p[:2], 1.0]) for c in corners if (c[:, :2].min(0) - 1e-9 <= p[:2]).all() and (p[:2] <= c[:, :2].max(0) + 1e-9).all()]
        assert any((w > -1e-6).all() for w in weights)


def test_contour_texts_hold_their_lines(spark):
    surface, meta = queries_grid._surface(spark, SF, 8.0)
    lines = {r.line_id: r for r in terrain.contours(surface, meta, 5.0).collect()}
    ring = lambda r: [[round(p.x, 3), round(p.y, 3)] for p in r.coords]
    for r in catalog.QUERIES["contour_geojson"](spark, SF).collect():
        doc = json.loads(r.value)
        want = lines[r.line_id]
        assert doc["properties"] == {"elevation": want.level, "index": int(want.is_index)} and np.allclose(doc["geometry"]["coordinates"], ring(want), atol=1.1e-3)
    found = catalog.QUERIES["contour_dxf"](spark, SF).collect()
    assert {r.line_id for r in found} == set(lines)
    for r in found:
        pairs = r.value.split("\n")
        code = list(zip(pairs[::2], pairs[1::2], strict=True))
        x, y, z = ([float(v) for c, v in code if c == n] for n in ("10", "20", "30"))
        want = lines[r.line_id]
        assert np.allclose(np.column_stack([x, y]), ring(want), atol=1.1e-3) and set(z) == {round(want.level, 3)} and ("8", "CONTOUR_MAJOR" if want.is_index else "CONTOUR_MINOR") in code


def test_overlay_links_its_tiles(spark):
    """Each document has its tile's box and picture, and links to just those children that there are."""
    tiles_ = {(r.z, r.x, r.y) for r in queries_catalog._camera_tiles(spark, SF).collect()}
    docs = {r.path: r.kml for r in catalog.QUERIES["kml_overlay"](spark, SF).collect()}
    assert set(docs) == {"doc.kml", *(f"{z}/{x}/{y}.kml" for z, x, y in tiles_)}
    for z, x, y in tiles_:
        root = ElementTree.fromstring(docs[f"{z}/{x}/{y}.kml"].encode())
        tag = lambda e, *path: e.findall("/".join("{http://www.opengis.net/kml/2.2}" + p for p in path))
        box = {k: float(tag(root, "Document", "GroundOverlay", "LatLonBox", k)[0].text) for k in ("north", "south", "east", "west")}
        lon = lambda v, z=z: v / 2**z * 360 - 180
        lat = lambda v, z=z: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / 2**z))))
        assert np.allclose([box["west"], box["east"], box["north"], box["south"]], [lon(x), lon(x + 1), lat(y), lat(y + 1)], atol=1e-8)
        links = {e.text for e in tag(root, "Document", "NetworkLink", "Link", "href")}
        assert links == {f"../../{c[0]}/{c[1]}/{c[2]}.kml" for c in tiles_ if c[0] == z + 1 and (c[1] // 2, c[2] // 2) == (x, y)}
        assert tag(root, "Document", "GroundOverlay", "Icon", "href")[0].text == f"{y}.png"
