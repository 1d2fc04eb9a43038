from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyraster.operators import blocks, cloud, grid, knn, morph
from skyraster.schema import RasterMeta


def table(spark, array: np.ndarray):
    r, c = np.indices(array.shape)
    rows = [(int(a), int(b), None if np.isnan(v) else float(v)) for a, b, v in zip(r.ravel(), c.ravel(), array.ravel(), strict=True)]
    return spark.createDataFrame(rows, "row long, col long, value double")


def array(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r.value is None else r.value
    return out


def cloud_table(spark, xyz: np.ndarray, **more):
    pdf = pd.DataFrame({"pt_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more})
    return spark.createDataFrame(pdf)


def test_plane_surface_keeps_heights(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 50, (5000, 2))
    points = cloud_table(spark, np.column_stack([xy, 10 + 0.1 * xy[:, 0]]))
    cell = grid.native_cell(points, 0.5)
    meta = grid.plan(points, cell)
    assert cell > 0.5
    target = grid.plan(points, 0.5)
    surface = grid.bilinear(grid.native(points, meta), meta, target, 2.0)
    assert surface.where("value is null").count() == 0
    middle = surface.where(f"row = {target.ny // 2} and col = {target.nx // 2}").first().value
    assert abs(middle - 10.5) < 0.3


def test_top_point_gives_the_colour(spark):
    points = cloud_table(spark, np.array([(1.2, 1.2, 5), (1.3, 1.3, 20), (3, 3, 1.0)]), c=[100.0, 200.0, 50.0])
    meta = grid.plan(points, 1.0)
    got = grid.indexed(points, meta).where("pt_id = 0").join(grid.binned(points, meta, value="c", by="z"), ["row", "col"]).first()
    assert got.value == 200


def test_fill_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 9, (23, 31))
    a[rng.random(a.shape) < 0.9] = np.nan
    got = array(grid.fill_nearest(table(spark, a).where("value is not null"), RasterMeta(0, 0, 1, 31, 23)), a.shape)
    rows, cols = np.nonzero(~np.isnan(a))
    for r in range(23):
        for c in range(31):
            d = (rows - r) ** 2 + (cols - c) ** 2
            k = min(range(len(d)), key=lambda i: (d[i], rows[i], cols[i]))
            assert got[r, c] == a[rows[k], cols[k]]


@pytest.mark.parametrize(("ny", "nx", "holes", "side"), [(23, 31, 0.95, 5), (40, 17, 0.99, 4), (30, 30, 0.97, 7), (1, 50, 0.9, 8), (50, 1, 0.9, 8), (12, 12, 0.0, 5)])
def test_nearest_cells_over_blocks(spark, ny, nx, holes, side):
    rng = np.random.default_rng(nx)
    a = rng.uniform(0, 9, (ny, nx))
    a[rng.random(a.shape) < holes] = np.nan
    a[ny // 2, nx // 2] = 1.0
    meta = RasterMeta(0, 0, 1, nx, ny)
    rows, cols = np.nonzero(~np.isnan(a))
    cells = spark.createDataFrame([(int(r), int(c), float(a[r, c]), float(r * nx + c)) for r, c in zip(rows, cols, strict=True)], "row long, col long, v double, at double")
    full = blocks.nearest(blocks.pack(cells, meta, ["v", "at"], side), meta, 2, side)
    got = {(r.row, r.col): (r.v, r["at"]) for r in blocks.unpack(full, meta, ["v", "at"], side).collect()}
    assert len(got) == nx * ny
    for r in range(ny):
        for c in range(nx):
            d = (rows - r) ** 2 + (cols - c) ** 2
            k = min(range(len(d)), key=lambda i: (d[i], rows[i], cols[i]))
            assert got[r, c] == (a[rows[k], cols[k]], rows[k] * nx + cols[k])


@pytest.mark.parametrize("side", [6, 9, 256])
def test_filters_do_not_depend_on_blocks(spark, monkeypatch, side):
    a = np.random.default_rng(7).uniform(0, 5, (21, 25))
    meta, df = RasterMeta(0, 0, 1, 25, 21), None
    df = blocks.pack(table(spark, a), meta, ["value"], side)
    whole = blocks.pack(table(spark, a), meta, ["value"])
    for reach, f in ((6, morph._opened(meta, 3)), (4, morph._median(meta, 9)), morph._gaussian(meta, 1.2)):
        got, want = (array(blocks.unpack(blocks.filtered(x, meta, reach, f, side=n), meta, ["value"], n), a.shape) for x, n in ((df, side), (whole, blocks.SIDE)))
        assert np.array_equal(got, want)
    with pytest.raises(ValueError, match="margin"):
        blocks.filtered(df, meta, side + 1, morph._opened(meta, 1), side=side)


def test_running_extremes():
    a = np.random.default_rng(8).uniform(0, 1, (2, 40, 30))
    for size in (1, 2, 3, 7, 30):
        assert np.array_equal(blocks.running(a, size, np.fmin, 2), np.lib.stride_tricks.sliding_window_view(a, size, axis=2).min(-1))
        assert np.array_equal(blocks.running(a, size, np.fmax, 1), np.lib.stride_tricks.sliding_window_view(a, size, axis=1).max(-1))


def mirrored(a: np.ndarray, h: int) -> np.ndarray:
    return np.pad(a, h, mode="symmetric")


@pytest.mark.parametrize("size", [3, 9])
def test_median_equals_numpy(spark, size):
    a = np.random.default_rng(1).uniform(0, 5, (11, 14))
    p = mirrored(a, size // 2)
    want = np.array([[np.median(p[r : r + size, c : c + size]) for c in range(14)] for r in range(11)])
    got = array(morph.median(table(spark, a), RasterMeta(0, 0, 1, 14, 11), size), a.shape)
    assert np.array_equal(got, want)


@pytest.mark.parametrize("w", [1, 4, 16])
def test_opening_equals_numpy_and_is_idempotent(spark, w):
    a = np.random.default_rng(2).uniform(0, 5, (12, 17))

    def flat(x, f):
        p = np.pad(x, w, mode="symmetric") if w < 12 else np.pad(x, w, mode="constant", constant_values=np.inf if f is np.min else -np.inf)
        return np.array([[f(p[r : r + 2 * w + 1, c : c + 2 * w + 1]) for c in range(17)] for r in range(12)])

    got = array(morph.opening(table(spark, a), RasterMeta(0, 0, 1, 17, 12), w), a.shape)
    assert np.array_equal(got, flat(flat(a, np.min), np.max))
    assert (got <= a).all()
    assert np.array_equal(array(morph.opening(table(spark, got), RasterMeta(0, 0, 1, 17, 12), w), a.shape), got)


def test_gaussian_equals_numpy(spark):
    a = np.random.default_rng(4).uniform(0, 5, (9, 13))
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    k /= k.sum()
    p = np.pad(a, 8, mode="symmetric")
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, p))
    got = array(morph.gaussian(table(spark, a), RasterMeta(0, 0, 1, 13, 9), 2.0), a.shape)
    assert np.allclose(got, want, atol=1e-9)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = rng.normal(0, 1, (300, 3)) * [10, 10, 1]
    got = knn.neighbours(cloud_table(spark, xyz), 8).toPandas()
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :8]
    have = got.sort_values(["pt_id", "rank"]).d2.to_numpy().reshape(300, 8)
    assert np.allclose(have, want)


def test_knn_of_few_points(spark):
    assert knn.neighbours(cloud_table(spark, np.zeros((1, 3))), 8).count() == 0
    assert knn.neighbours(cloud_table(spark, np.array([(0, 0, 0), (1, 0, 0.0)])), 8).count() == 2


def brute_nearest(query, spots, k, own):
    out = []
    for i, q in enumerate(query):
        d = ((q - spots) ** 2).T
        d = sum(d[1:], d[0])
        order = [j for j in sorted(range(len(spots)), key=lambda j: (d[j], j)) if not own or j != i][:k]
        out.append([(j, d[j]) for j in order])
    return out


@pytest.mark.parametrize(("k", "dims"), [(1, 2), (5, 2), (8, 3)])
def test_index_equals_brute_force(monkeypatch, k, dims):
    monkeypatch.setattr(knn, "PIECE", 8)
    rng = np.random.default_rng(k)
    spots = np.round(rng.normal(0, 3, (200, dims)), 0)  # many ties
    query = np.concatenate([spots[:50], rng.normal(0, 9, (30, dims))])
    index = knn.Index(spots)
    for own in (None, np.arange(len(query))):
        d2, at = index.nearest(query, k, own)
        want = brute_nearest(query, spots, k, own is not None)
        assert [[(int(j), x) for j, x in zip(a, d, strict=True) if j >= 0] for a, d in zip(at, d2, strict=True)] == want
    assert (knn.Index(spots[:3]).nearest(query, 5)[1] >= 0).sum(1).tolist() == [3] * len(query)


def test_neighbours_over_parts(spark, monkeypatch):
    """Half of the points in one small spot, and copies: the same as brute force, whatever the split; parts are of about one size."""
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.uniform(0, 100, (700, 3)), rng.normal(50, 0.01, (700, 3)), np.full((20, 3), 7.0)])
    points = cloud_table(spark, xyz)
    monkeypatch.setattr(knn, "LEAF", 100)
    split = knn._split(points, ("x", "y", "z"))
    sizes = np.bincount(split.part(xyz), minlength=1 << split.depth)
    assert split.depth == 4 and sizes.max() < 2 * np.median(sizes)
    for include in (False, True):
        got = knn.neighbours(points, 6, include_self=include).toPandas().sort_values(["pt_id", "rank"])
        want = brute_nearest(xyz, xyz, 6, not include)
        assert [(int(a), b) for a, b in zip(got.nbr_id, got.d2, strict=True)] == [x for row in want for x in row]
    flat = knn.neighbours(points, 4, ("x", "y")).toPandas().sort_values(["pt_id", "rank"])
    assert flat.nbr_id.tolist() == [j for row in brute_nearest(xyz[:, :2], xyz[:, :2], 4, True) for j, _ in row]


@pytest.mark.parametrize(("few", "many"), [(32, 200_000), (0, 200_000), (0, 0)])
def test_nearest_sites_in_three_ways(spark, monkeypatch, few, many):
    monkeypatch.setattr(knn, "FEW_SITES", few)
    monkeypatch.setattr(knn, "MANY_SITES", many)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(4)
    xy, spots = np.round(rng.uniform(0, 20, (150, 2))), np.round(rng.uniform(0, 20, (30, 2)))
    rows = spark.createDataFrame([(k // 10, k % 10, *map(float, p), "more") for k, p in enumerate(xy)], "row long, col int, x double, y double, note string")
    sites = spark.createDataFrame([(f"s{k:02d}", *map(float, p)) for k, p in enumerate(spots)], "site string, sx double, sy double")
    got = {(r.row, r.col, r["rank"]): (r.site, r.d2, r.note) for r in knn.nearest_sites(rows, sites, 3, ["row", "col"]).collect()}
    want = {(k // 10, k % 10, n + 1): (f"s{j:02d}", d, "more") for k, near in enumerate(brute_nearest(xy, spots, 3, False)) for n, (j, d) in enumerate(near)}
    assert got == want


def test_thinning_reaches_density(spark):
    rng = np.random.default_rng(0)
    xyz = np.column_stack([rng.uniform(0, 100, (60_000, 2)), rng.normal(10, 0.05, 60_000)])
    points = cloud_table(spark, xyz)
    thin = cloud.thin(points, 5.0)
    assert 2 < thin.count() / 10_000 <= 6
    assert thin.join(points, "pt_id", "left_anti").count() == 0
    assert cloud.thin(points, 0).count() == 60_000


def town(rng):
    """Rolling ground with a flat-roofed block and bushes; truth per point."""
    g = rng.uniform(0, 60, (9000, 2))
    ground = np.column_stack([g, 0.02 * g[:, 0] + rng.normal(0, 0.02, 9000)])
    b = rng.uniform([20, 20], [34, 32], (1800, 2))
    roof = np.column_stack([b, np.full(1800, 8.0) + rng.normal(0, 0.02, 1800)])
    t = rng.normal([48, 45], 2.0, (1200, 2))
    tree = np.column_stack([t, rng.uniform(1.5, 7, 1200)])
    truth = np.repeat([2, 6, 5], [9000, 1800, 1200])
    color = np.repeat([(140, 120, 90), (180, 180, 185), (50, 130, 45)], [9000, 1800, 1200], axis=0)
    return np.concatenate([ground, roof, tree]), color, truth


def test_rule_classes_meet_the_floors(spark):
    rng = np.random.default_rng(3)
    xyz, color, truth = town(rng)
    flyers = np.array([(30, 30, 80), (20, 20, -40), (40, 40, 120.0)])
    points = cloud_table(spark, np.concatenate([xyz, flyers]), **{c: np.concatenate([color[:, k], [100] * 3]) for k, c in enumerate("rgb")})
    got = cloud.classify(points).toPandas().sort_values("pt_id").cls.to_numpy()
    assert (got[12_000:] == 7).all()
    got = got[:12_000]
    assert (got[truth == 2] == 2).mean() > 0.9
    assert (got[truth == 6] == 6).mean() > 0.75
    assert np.isin(got[truth == 5], [3, 4, 5]).mean() > 0.75


def test_noise_goes_unless_it_is_all(spark):
    some = spark.createDataFrame([(1, 7), (2, 2)], "pt_id long, cls int")
    assert [r.pt_id for r in cloud.drop_noise(some).collect()] == [2]
    assert cloud.drop_noise(some.where("cls = 7")).count() == 1


def test_eigenvalues_in_closed_form(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for _ in range(200):
        a = rng.normal(0, 1, (3, 3)) * rng.uniform(0.01, 3, 3)
        m = a @ a.T
        rows.append([float(m[i, j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])
        want.append(np.linalg.eigvalsh(m)[::-1])
    df = spark.createDataFrame(rows, "cxx double, cyy double, czz double, cxy double, cxz double, cyz double").select(*[e.alias(f"e{k}") for k, e in enumerate(cloud.eigenvalues())])
    assert np.allclose(np.array(df.collect()), np.array(want), atol=1e-9)


def test_histogram_sums_to_all(spark):
    points = spark.createDataFrame([(k, k % 5) for k in range(50)] + [(99, 42)], "pt_id long, cls int")
    rows = cloud.histogram(points).collect()
    assert sum(r.n for r in rows) == 51
    assert next(r for r in rows if r.cls == 42).red == 150


def test_top_view_takes_the_highest(spark):
    points = cloud_table(spark, np.array([(0, 0, 1), (0, 0, 5), (9, 9, 2.0)]), r=[1, 2, 3], g=[1, 2, 3], b=[1, 2, 3])
    assert {(r.row, r.col): r.r for r in cloud.render_top(points, 10, 10).collect()} == {(9, 0): 2, (0, 9): 3}


def test_sample_is_repeatable(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    first = {r.k for r in cloud.sample(ids, 50, "k").collect()}
    assert first == {r.k for r in cloud.sample(ids.orderBy(F.rand()), 50, "k").collect()}
    assert len(first) == 50


def test_pyramid_fill_has_no_holes(spark):
    a = np.full((13, 9), np.nan)
    a[0, 0], a[12, 8] = 1.0, 3.0
    got = array(grid.pyramid_fill(table(spark, a).where("value is not null"), RasterMeta(0, 0, 1, 9, 13)), a.shape)
    assert not np.isnan(got).any()
    assert got[0, 0] == 1 and got[12, 8] == 3


def test_a_search_works_out_few_distances(monkeypatch):
    """With sixteen times the sites a query meets hardly more of them."""
    count, distances = [0], knn.Index._distances

    def counted(self, *args):
        out = distances(self, *args)
        count[0] += out[0].size
        return out

    monkeypatch.setattr(knn.Index, "_distances", counted)
    rng, met = np.random.default_rng(5), []
    for n in (4_000, 64_000):
        count[0] = 0
        knn.Index(rng.uniform(0, 100, (n, 2)), 2).nearest(rng.uniform(0, 100, (3_000, 2)), 2)
        met.append(count[0] / 3_000)
    assert met[1] < 1.2 * met[0] < 200
