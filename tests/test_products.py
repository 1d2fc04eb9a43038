"""Rasters in web mercator, contour lines over blocks, files, and runs that are opened again."""

from __future__ import annotations

import json
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyraster import schema
from skyraster.functions import geo
from skyraster.operators import blocks, control, terrain, tiles, warp
from skyraster.plans import archive, pipeline
from skyraster.schema import RasterMeta
from skyraster.sources import binary, clouds, files, products, project


def raster(spark, *bands):
    r, c = np.indices(bands[0].shape)
    rows = [(int(a), int(b), *map(int, v)) for a, b, *v in zip(r.ravel(), c.ravel(), *[x.ravel() for x in bands], strict=True)]
    return spark.createDataFrame(rows, "row long, col long, red int, green int, blue int, alpha int")


def surface(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in np.ndindex(a.shape)], "row long, col long, value double")


@pytest.fixture
def store(spark, tmp_path):
    """A folder that only Hadoop's file systems reach."""
    name = f"p{uuid.uuid4().hex}"  # file systems are kept by name
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./out", f"file://{tmp_path}")
    return f"viewfs://{name}/out"


# --- projections ------------------------------------------------------------------------------


def test_utm_there_and_back():
    rng = np.random.default_rng(0)
    for epsg, lat in ((32645, (0, 80)), (32733, (-80, 0)), (32601, (10, 60))):
        lon0 = 6 * (epsg % 100) - 183
        lon, lat = lon0 + rng.uniform(-3, 3, 50), rng.uniform(*lat, 50)
        east, north = geo.utm_forward(lon, lat, epsg % 100, epsg > 32700, geo.ARRAYS)
        back = geo.utm_inverse(east, north, epsg % 100, epsg > 32700)
        assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
        mx, my = geo.to_mercator(east, north, epsg)
        assert np.allclose(geo.mercator_to(mx, my, epsg), (east, north), atol=1e-4)
    for f in (geo.to_mercator, geo.mercator_to):
        with pytest.raises(ValueError, match="not supported"):
            f(np.zeros(1), np.zeros(1), 27700)


def drawn(df):
    return {(r.z, r.x, r.y): tiles.unpng(r.png) for r in df.collect()}


def test_tiles_of_a_gradient(spark, monkeypatch):
    """Where a channel grows by 2 a column and 3 a row, so it does between the cells, over blocks and in every tile."""
    monkeypatch.setattr(blocks, "SIDE", 256)
    n = 60
    r, c = np.indices((n, n))
    cells = raster(spark, 2 * c, 3 * r, np.full((n, n), 77), np.full((n, n), 255))
    z = 17
    res = 2 * geo.ORIGIN / (256 << z)
    meta = RasterMeta(9_840_000.0, 2_570_000.0, res * 1.9, n, n, 3857)
    count = 0
    for (zoom, x, y), image in drawn(tiles.cut_tiles(cells, meta, (z, z))).items():
        box = -geo.ORIGIN + x * 256 * res, geo.ORIGIN - y * 256 * res
        col = (box[0] + (np.arange(256) + 0.5) * res - meta.minx) / meta.cell
        row = (meta.maxy - (box[1] - (np.arange(256) + 0.5) * res)) / meta.cell
        inside = ((row >= 0) & (row < n))[:, None] & ((col >= 0) & (col < n))[None]
        assert zoom == z and np.array_equal(image[..., 3], np.where(inside, 255, 0))
        want = np.stack([np.broadcast_to(2 * np.clip(col - 0.5, 0, n - 1), (256, 256)), np.broadcast_to((3 * np.clip(row - 0.5, 0, n - 1))[:, None], (256, 256))], axis=-1)
        assert np.abs(image[inside][:, :2] - want[inside]).max() <= 0.5 + 1e-6 and (image[inside][:, 2] == 77).all()
        count += int(inside.sum())
    assert abs(count - (n * 1.9) ** 2) < 300


def test_tiles_do_not_depend_on_blocks(spark):
    """A raster of many blocks gives the pixels that a plain reading of the whole array gives, at every zoom."""
    rng = np.random.default_rng(2)
    n = 600
    bands = [rng.integers(0, 256, (n, n)) for _ in range(3)] + [np.where(rng.random((n, n)) < 0.2, 0, 255)]
    frame = spark.createDataFrame([(0,)], "i int").select(F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("i"))
    flat = spark.sparkContext.broadcast([b.ravel() for b in bands])

    def rows(batches):
        for b in batches:
            i = b["i"].to_numpy()
            b["row"], b["col"] = i // n, i % n
            for k, name in enumerate(warp.BANDS):
                b[name] = flat.value[k][i]
            yield b.drop(columns="i")

    cells = frame.repartition(4).mapInPandas(rows, "row long, col long, red int, green int, blue int, alpha int")
    meta = RasterMeta(500_000.0, 2_500_000.0, 2.0, n, n, 32645)
    whole = np.stack(bands).astype(float)
    levels = [whole]
    while len(levels) < 4:
        levels.append(warp._halved(levels[-1]))
    for (z, x, y), image in drawn(tiles.cut_tiles(cells, meta, (14, 16))).items():
        res = 2 * geo.ORIGIN / (256 << z)
        row, col = warp._spot(meta, -geo.ORIGIN + x * 256 * res, geo.ORIGIN - y * 256 * res, res, 256)
        level = warp._level(row, col, 9)
        assert level == {14: 2, 15: 1, 16: 0}[z]
        source = levels[level]
        a, b = row / 2**level - 0.5, col / 2**level - 0.5
        want = np.zeros((256, 256, 4))
        weight, alpha, colour = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256, 3))
        for dr in (0, 1):
            for dc in (0, 1):
                i, j = np.floor(a).astype(int) + dr, np.floor(b).astype(int) + dc
                ok = (i >= 0) & (j >= 0) & (i < source.shape[1]) & (j < source.shape[2])
                w = ok * (1 - np.abs(a - i)) * (1 - np.abs(b - j))
                cell = source[:, np.clip(i, 0, source.shape[1] - 1), np.clip(j, 0, source.shape[2] - 1)]
                weight, alpha, colour = weight + w, alpha + w * cell[3], colour + (w * cell[3])[..., None] * np.moveaxis(cell[:3], 0, -1)
        inside = (row >= 0) & (row < n) & (col >= 0) & (col < n)
        want[..., :3] = np.where(alpha > 0, 1, 0)[..., None] * colour / np.maximum(alpha, 1e-9)[..., None]
        want[..., 3] = alpha / np.maximum(weight, 1e-9)
        want[~inside] = 0
        assert np.abs(image - want).max() <= 0.5 + 1e-6


def test_preview_is_the_raster_in_mercator(spark):
    n = 50
    r, c = np.indices((n, n))
    cells = raster(spark, 5 * c, 5 * r, np.zeros((n, n)), np.full((n, n), 255))
    meta = RasterMeta(500_000.0, 2_500_000.0, 10.0, n, n, 32645)
    found, place = warp.preview(cells, meta)
    rows = found.collect()
    assert place.epsg == 3857 and abs(len(rows) - n * n) < 0.05 * n * n and all(x.alpha == 255 for x in rows)
    for x in rows[::97]:
        east, north = geo.mercator_to(np.array([place.minx + (x.col + 0.5) * place.cell]), np.array([place.maxy - (x.row + 0.5) * place.cell]), 32645)
        assert abs(x.red - 5 * np.clip((east[0] - meta.minx) / 10 - 0.5, 0, n - 1)) <= 0.51 and abs(x.green - 5 * np.clip((meta.maxy - north[0]) / 10 - 0.5, 0, n - 1)) <= 0.51
    small, place = warp.preview(cells, meta, 20)
    assert small.agg(F.max("row"), F.max("col")).first() <= (21, 21) and max(place.nx, place.ny) <= 22


# --- contour lines ----------------------------------------------------------------------------


def ring(coords, closed):
    """A line's points in an order of its own."""
    points = [(round(p.x, 6), round(p.y, 6)) for p in coords]
    if not closed:
        return tuple(min(points, points[::-1]))
    points = points[:-1]
    k = points.index(min(points))
    turned = points[k:] + points[:k]
    return tuple(min(turned, turned[:1] + turned[:0:-1]))


@pytest.mark.parametrize("side", [3, 7, 40])
def test_lines_do_not_depend_on_blocks(spark, side):
    r, c = np.indices((40, 40))
    a = 10 + 6 * np.sin(r / 4.0) * np.cos(c / 5.0) + 0.03 * r
    a[20, 20] = 8.0  # on a level
    meta = RasterMeta(0, 40, 1.0, 40, 40)
    got = terrain.contours(surface(spark, a), meta, 2.0, 0, side).collect()
    want = terrain.contours(surface(spark, a), meta, 2.0, 0).collect()
    lines = lambda rows: sorted((x.level, x.closed, x.segments, ring(x.coords, x.closed)) for x in rows)
    assert lines(got) == lines(want) and len({x.line_id for x in got}) == len(got)
    assert {x.closed for x in got} == {True, False} and all((x.coords[0] == x.coords[-1]) == x.closed for x in got)


def test_a_long_line_is_one(spark):
    """A plane's contours cross all blocks."""
    a = np.indices((30, 200))[0] + 0.5
    rows = terrain.contours(surface(spark, a), RasterMeta(0, 30, 1.0, 200, 30), 10.0, 0, 8).collect()
    assert sorted((x.level, x.segments, x.closed, len(x.coords)) for x in rows) == [(10.0, 199, False, 200), (20.0, 199, False, 200)]
    assert all(np.allclose(np.abs(np.diff([p.x for p in x.coords])), 1) for x in rows)


def test_cone_closes(spark):
    r, c = np.indices((80, 80))
    cone = 100 + 20 * np.maximum(1 - np.hypot(r - 39.5, c - 39.5) / 40, 0)
    (line,) = [x for x in terrain.contours(surface(spark, cone), RasterMeta(0, 80, 1.0, 80, 80), 5.0, 0.5, 16).collect() if x.level == 110]
    radius = [math.hypot(p.x - 40, p.y - 40) for p in line.coords]
    assert line.closed and abs(np.mean(radius) - 20) < 1


# --- files ------------------------------------------------------------------------------------


def test_files_are_whole_or_not_there(spark, store, tmp_path):
    def broken():
        yield b"half"
        raise RuntimeError("no more")

    for folder in (str(tmp_path), store):
        files.write(spark, f"{folder}/a.txt", [b"one ", b"two"])
        with pytest.raises(RuntimeError):
            files.write(spark, f"{folder}/a.txt", broken())
        assert (tmp_path / "a.txt").read_bytes() == b"one two"
        files.write(spark, f"{folder}/a.txt", b"three")
        assert (tmp_path / "a.txt").read_bytes() == b"three"
        rows = spark.createDataFrame([(f"d{k % 3}/{k}.bin", bytes([k])) for k in range(20)], "path string, data binary").repartition(4)
        assert files.write_each(rows, f"{folder}/many") == 20
        assert {p.name: p.read_bytes() for p in tmp_path.glob("many/*/*.bin")} == {f"{k}.bin": bytes([k]) for k in range(20)}
        assert not [p for p in tmp_path.rglob("*part-*")]
    assert files.Store(spark, store).names(f"{store}/many") == ["d0", "d1", "d2"]


def test_products_in_a_store(spark, store, tmp_path):
    points = spark.createDataFrame([(k, float(k % 7), float(k % 5), float(k), 1, 2, 3, 2) for k in range(50)], schema.POINTS)
    clouds.write_las(points.repartition(3), f"{store}/a.las")
    n = 20
    r, c = np.indices((n, n))
    cells = raster(spark, c, r, r, np.full((n, n), 255))
    meta = RasterMeta(9_840_000.0, 2_570_000.0, 4.0, n, n, 3857)
    products.write_ortho(cells, meta, f"{store}/o.tif")
    found = products.write_tiles(cells, meta, f"{store}/t", (15, 16))
    products.write_mesh(*terrain.heightfield(points, 1.0), f"{store}/m.obj")
    binary.register(spark)
    assert spark.read.format("las").load(str(tmp_path / "a.las")).count() == 50
    assert spark.read.format("geotiff").load(str(tmp_path / "o.tif")).count() == n * n * 4
    assert len(list(tmp_path.glob("t/1?/*/*.png"))) == found["tiles"] > 0 and json.loads((tmp_path / "t/tiles.json").read_text())["tiles"] == found["tiles"]
    lines = (tmp_path / "m.obj").read_text().splitlines()
    assert sum(x.startswith("v ") for x in lines) == 35 and (tmp_path / "m_offset.txt").exists()
    assert not [p for p in tmp_path.rglob("*part-*")]


def test_las_under_a_similarity_and_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.uniform(0, 100, 3)), k % 256, 7, 255, k % 8) for k in range(300)]
    source, moved, back = (str(tmp_path / f"{n}.las") for n in "abc")
    clouds.write_las(spark.createDataFrame(rows, schema.POINTS), source)
    sim = control.similarity_from([2, 0, -1, 0, 1, 0, 0, 0, 0, 1, 500_000, 4_000_000, 50])
    clouds.transform_las(spark, source, moved, sim)
    clouds.transform_las(spark, moved, back, sim.inverse())
    load = lambda p: spark.read.format("las").load(p).orderBy("pt_id").collect()
    for x, y, z in zip(load(source), load(moved), load(back), strict=True):
        assert abs(y.x - (500_000 - 2 * x.y)) < 2e-3 and abs(y.y - (4_000_000 + 2 * x.x)) < 2e-3
        assert max(abs(x[c] - z[c]) for c in "xyz") < 2e-3 and [x[c] for c in ("r", "g", "b", "cls")] == [z[c] for c in ("r", "g", "b", "cls")]
    assert binary.las_header(moved)["n"] == 300
    assert os.path.getsize(clouds.write_las(spark.createDataFrame([], schema.POINTS), str(tmp_path / "none.las"))) == 227


# --- runs -------------------------------------------------------------------------------------


def test_run_opened_again(spark, store, tmp_path):
    for folder in (f"file://{tmp_path}/runs", f"{store}/other"):
        assert archive.load(spark, folder) is None and archive.versions(spark, folder) == []
        survey = project.Survey(name="s", epsg=32645, stats={"a": 1}, settings=schema.Settings(ortho_gsd=0.1))
        points = spark.createDataFrame([(1, 2.0)], "pt_id long, z double")
        run = pipeline.Run(spark, survey, {"dense": points, "_model": points}, {"dsm": RasterMeta(1.0, 2.0, 0.5, 3, 4, 32645)}, control.similarity_from([2, 1, 0, 0, 0, 1, 0, 0, 0, 1, 5, 6, 7]))
        first = archive.save(run, folder)
        run.tables["dense"], run.grids["dtm"] = points.union(points), RasterMeta(0.0, 0.0, 1.0, 1, 1)
        second = archive.save(run, folder)
        assert archive.versions(spark, folder) == [second, first]
        again, before = archive.load(spark.newSession(), folder), archive.load(spark, folder, first)
        assert again.tables.keys() == {"dense"} and again.tables["dense"].count() == 2 and before.tables["dense"].count() == 1
        assert again.grids == run.grids and before.grids.keys() == {"dsm"} and again.survey == survey
        assert again.sim.s == 2 and np.array_equal(again.sim.R, run.sim.R) and np.array_equal(again.sim.t, run.sim.t)
        broken = pipeline.Run(spark, survey, {"x": spark.range(1).select(F.raise_error(F.lit("lost")).alias("v"))})
        with pytest.raises(Exception, match="lost"):
            archive.save(broken, folder)
        assert archive.versions(spark, folder) == [second, first]
