"""Queries over point clouds and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import photo
from skyraster.operators import cloud, grid, knn, morph, terrain
from skyraster.plans.adapters import load
from skyraster.plans.catalog import query
from skyraster.plans.tables import cut
from skyraster.schema import CLASSES, RasterMeta

# Grid of the points at a cell size, as SQL: `e` and `m` are one row, `bin` has every point's row and col.
_GRID = """e AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, count(*) AS n FROM {src}),
m AS (SELECT *, greatest(ceil((maxx - minx) / {cell}::double) + 1, 1)::bigint AS nx, greatest(ceil((maxy - miny) / {cell}::double) + 1, 1)::bigint AS ny FROM e),
bin AS (SELECT p.*, least(greatest(floor((m.maxy - p.y) / {cell}::double), 0), m.ny - 1)::bigint AS row, least(greatest(floor((p.x - m.minx) / {cell}::double), 0), m.nx - 1)::bigint AS col
  FROM {src} p, m)"""


def _sql_grid(cell: float, src: str = "points") -> str:
    return _GRID.format(cell=cell, src=src)


_DENSE = """full_ AS (SELECT r.row, c.col, v.value FROM (SELECT unnest(range(ny)) AS row FROM m) r CROSS JOIN (SELECT unnest(range(nx)) AS col FROM m) c
  LEFT JOIN v ON v.row = r.row AND v.col = c.col)"""
_FILL = """filled AS (SELECT h.row, h.col, coalesce(any_value(h.value), arg_min(o.value, {'d': (h.row - o.row) * (h.row - o.row) + (h.col - o.col) * (h.col - o.col), 'r': o.row, 'c': o.col})) AS value
  FROM full_ h LEFT JOIN v o ON h.value IS NULL GROUP BY h.row, h.col)"""


_UNIT = 1 << 20  # of a metre: sums that differ in their last bits agree, and no decimal of ten places or fewer lies halfway


def _near(c: str) -> Column:
    return (F.floor(F.col(c) * _UNIT + 0.5) / _UNIT).alias(c)


def _near_sql(value: str) -> str:
    return f"floor(({value}) * {_UNIT} + 0.5::double) / {_UNIT}::double"


@query(f"WITH {_sql_grid(5)} SELECT row, col, max(z) AS top_z, min(z) AS low_z, count(*) AS n, arg_max(r, {{'z': z, 'i': pt_id}}) AS red FROM bin GROUP BY row, col")
def dsm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 5.0)
    return grid.indexed(points, meta).groupBy("row", "col").agg(
        F.max("z").alias("top_z"), F.min("z").alias("low_z"), F.count(F.lit(1)).alias("n"), F.max_by("r", F.struct("z", "pt_id")).alias("red"))


@query(f"WITH src AS (SELECT * FROM points WHERE cls = 2), {_sql_grid(5, 'src')}, v AS (SELECT row, col, min(z) AS value FROM bin GROUP BY row, col) SELECT row, col, value FROM v")
def dtm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = load(spark, sf_dir, "points").where("cls = 2")
    return grid.binned(ground, grid.plan(ground, 5.0), "min")


@query(f"WITH {_sql_grid(5)} SELECT row, col, arg_max(r, {{'z': z, 'i': pt_id}}) AS r, arg_max(g, {{'z': z, 'i': pt_id}}) AS g, arg_max(b, {{'z': z, 'i': pt_id}}) AS b FROM bin GROUP BY row, col")
def top_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    at = grid.indexed(points, grid.plan(points, 5.0))
    return at.groupBy("row", "col").agg(*[F.max_by(c, F.struct("z", "pt_id")).alias(c) for c in "rgb"])


@query("SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM points")
def cloud_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extent(load(spark, sf_dir, "points"))


@query("SELECT round(sqrt(greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6) / greatest(count(*), 1)), 9) AS spacing FROM points")
def mean_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.mean_spacing(load(spark, sf_dir, "points")).select(F.round("spacing", 9).alias("spacing"))


@query("SELECT ceil((max(x) - min(x)) / 2.5::double)::bigint + 1 AS nx, ceil((max(y) - min(y)) / 2.5::double)::bigint + 1 AS ny FROM points")
def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = grid.plan(load(spark, sf_dir, "points"), 2.5)
    return spark.createDataFrame([(meta.nx, meta.ny)], "nx long, ny long")


@query("""WITH k AS (SELECT *, xor(xor(floor(x / (1 / sqrt(0.35::double)))::bigint * 73856093, floor(y / (1 / sqrt(0.35::double)))::bigint * 19349663), floor(z / (1 / sqrt(0.35::double)))::bigint * 83492791) AS key FROM points)
SELECT pt_id, x, y, z FROM (SELECT *, min(pt_id) OVER (PARTITION BY key) AS first FROM k) WHERE pt_id = first""")
def voxel_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.thin(load(spark, sf_dir, "points"), 0.35).select("pt_id", "x", "y", "z")


_CLASSES_SQL = "(VALUES " + ", ".join(f"({c}, '{n}', {r}, {g}, {b})" for c, n, r, g, b in CLASSES) + ") AS t(code, name, red, green, blue)"


@query(f"""SELECT cls, n, 100.0::double * n / greatest(sum(n) OVER (), 1)::double AS pct, coalesce(name, 'Class ' || cls) AS name, coalesce(red, 150) AS red, coalesce(green, 150) AS green, coalesce(blue, 150) AS blue
FROM (SELECT cls, count(*) AS n FROM points GROUP BY cls) LEFT JOIN {_CLASSES_SQL} ON code = cls""")
def class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.histogram(load(spark, sf_dir, "points"))


@query("""SELECT pt_id, CASE WHEN veg AND hag <= 2 THEN 3 WHEN veg AND hag <= 5 THEN 4 WHEN veg THEN 5 WHEN hag > 2.5 THEN 6 ELSE 1 END AS cls
FROM (SELECT pt_id, z - 15 AS hag, g > r + 10 AND g > b + 10 AS veg FROM points)""")
def class_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "points").select("pt_id", (F.col("z") - 15).alias("hag"), photo.green().alias("veg"))
    return rows.select("pt_id", photo.band().alias("cls"))


@query("""SELECT pt_id, CASE WHEN coplanar AND hag > 2.5 THEN 6 WHEN hag > 5 THEN 5 WHEN hag > 2 THEN 4 WHEN hag > 0.35 THEN 3 ELSE cls END AS cls
FROM (SELECT pt_id, cls, z - 15 AS hag, r % 2 = 0 AS coplanar FROM points)""")
def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "points").select("pt_id", "cls", (F.col("z") - 15).alias("hag"), (F.col("r") % 2 == 0).alias("coplanar"))
    return cloud.class_rules(rows).select("pt_id", "cls")


@query("SELECT pt_id, cls FROM points WHERE cls <> 7 OR (SELECT NOT bool_or(cls <> 7) FROM points)")
def noise_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.drop_noise(load(spark, sf_dir, "points")).select("pt_id", "cls")


@query("SELECT median(z) FILTER (WHERE cls = 2) AS ground_z, quantile_cont(z, 0.05) AS low_z FROM points")
def ground_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    low = cloud.ground_height(points.withColumn("cls", F.lit(1))).withColumnRenamed("ground_z", "low_z")
    return cloud.ground_height(points).crossJoin(F.broadcast(low))  # one row each


@query("""WITH m AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM points),
k AS (SELECT p.pt_id, p.z, least(floor((x - minx) / 3::double), ceil((maxx - minx) / 3::double)) AS i, least(floor((y - miny) / 3::double), ceil((maxy - miny) / 3::double)) AS j FROM points p, m)
SELECT pt_id, round(z - min(z) OVER (PARTITION BY i, j), 9) AS hag FROM k""")
def hag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.height_over_lowest(load(spark, sf_dir, "points")).select("pt_id", F.round("hag", 9).alias("hag"))


@query(f"WITH {_sql_grid(4)}, v AS (SELECT row, col, max(z) AS value FROM bin GROUP BY row, col), {_DENSE}, {_FILL} SELECT row, col, value FROM filled")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    return grid.native(points, grid.plan(points, 4.0))


def _surface(spark: SparkSession, sf_dir: str, cell: float = 4.0) -> tuple[DataFrame, RasterMeta]:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, cell)
    return cut(grid.native(points, meta), "surface"), meta


_SURFACE = f"{_sql_grid(4)}, v AS (SELECT row, col, max(z) AS value FROM bin GROUP BY row, col), {_DENSE}, {_FILL}"


@query(f"""WITH {_SURFACE}, e1 AS (SELECT row, col, min(value) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM filled),
e2 AS (SELECT row, col, min(value) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM e1),
d1 AS (SELECT row, col, max(value) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM e2)
SELECT row, col, max(value) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM d1""")
def grey_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    return morph.opening(surface, meta, 2)


def _offsets(h: int) -> str:
    k = ", ".join(str(i) for i in range(-h, h + 1))
    return f"(SELECT a.k AS dr, b.k AS dc FROM (SELECT unnest([{k}]) AS k) a, (SELECT unnest([{k}]) AS k) b)"


def _mirror(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


_MEDIAN = f"""med AS (SELECT t.row, t.col, median(s.value) AS value FROM (SELECT f.row, f.col, {_mirror('f.row + o.dr', 'm.ny')} AS r2, {_mirror('f.col + o.dc', 'm.nx')} AS c2 FROM {{src}} f, {{offsets}} o, m) t
  JOIN {{src}} s ON s.row = t.r2 AND s.col = t.c2 GROUP BY t.row, t.col)"""


@query(f"WITH {_SURFACE}, {_MEDIAN.format(src='filled', offsets=_offsets(1))} SELECT row, col, value FROM med")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    return morph.median(surface, meta, 3)


@query(f"WITH {_SURFACE}, {_MEDIAN.format(src='filled', offsets=_offsets(4))} SELECT v.row, v.col, v.value FROM v JOIN med USING (row, col) WHERE v.value - med.value <= 15")
def knock_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 4.0)
    return morph.knock_out(cut(grid.binned(points, meta), "cells"), meta)


@query(f"""WITH {_SURFACE}, w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4])::double AS k)),
h AS (SELECT f.row, f.col, sum(s.value * w.w) AS value FROM filled f, w, m, filled s WHERE s.row = f.row AND s.col = {_mirror('f.col + w.k::bigint', 'm.nx')} GROUP BY f.row, f.col)
SELECT f.row, f.col, {_near_sql("sum(s.value * w.w)")} AS value FROM h f, w, m, h s WHERE s.col = f.col AND s.row = {_mirror('f.row + w.k::bigint', 'm.ny')} GROUP BY f.row, f.col""")
def gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    return morph.gaussian(surface, meta, 1.0).select("row", "col", _near("value"))


@query(f"""WITH {_SURFACE}, t AS (SELECT r.row, c.col, least(greatest((r.row + 0.5) * 0.625 - 0.5, 0), ny - 1)::double AS fr, least(greatest((c.col + 0.5) * 0.625 - 0.5, 0), nx - 1)::double AS fc, ny, nx
  FROM (SELECT unnest(range(ceil(ny * 1.6::double)::bigint)) AS row FROM m) r, (SELECT unnest(range(ceil(nx * 1.6::double)::bigint)) AS col FROM m) c, m),
u AS (SELECT *, floor(fr)::bigint AS r0, floor(fc)::bigint AS c0 FROM t)
SELECT u.row, u.col, {_near_sql("a.value * (1 - (fr - r0)) * (1 - (fc - c0)) + b.value * (1 - (fr - r0)) * (fc - c0) + c.value * (fr - r0) * (1 - (fc - c0)) + d.value * (fr - r0) * (fc - c0) - 2")} AS value
FROM u JOIN filled a ON a.row = r0 AND a.col = c0 JOIN filled b ON b.row = r0 AND b.col = least(c0 + 1, nx - 1) JOIN filled c ON c.row = least(r0 + 1, ny - 1) AND c.col = c0
  JOIN filled d ON d.row = least(r0 + 1, ny - 1) AND d.col = least(c0 + 1, nx - 1)""")
def bilinear_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    target = RasterMeta(meta.minx, meta.maxy, 2.5, math.ceil(meta.nx * 1.6), math.ceil(meta.ny * 1.6))
    return grid.bilinear(surface, meta, target, 2.0).select("row", "col", _near("value"))


@query(f"""WITH {_sql_grid(1)}, v AS (SELECT row, col, max(z) AS value FROM bin GROUP BY row, col), {_DENSE},
l1 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM full_ GROUP BY 1, 2), l2 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l1 GROUP BY 1, 2),
l3 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l2 GROUP BY 1, 2), l4 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l3 GROUP BY 1, 2),
l5 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l4 GROUP BY 1, 2), l6 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l5 GROUP BY 1, 2)
SELECT f.row, f.col, {_near_sql("coalesce(f.value, l1.value, l2.value, l3.value, l4.value, l5.value, l6.value)")} AS value FROM full_ f
LEFT JOIN l1 ON l1.row = f.row // 2 AND l1.col = f.col // 2 LEFT JOIN l2 ON l2.row = f.row // 4 AND l2.col = f.col // 4 LEFT JOIN l3 ON l3.row = f.row // 8 AND l3.col = f.col // 8
LEFT JOIN l4 ON l4.row = f.row // 16 AND l4.col = f.col // 16 LEFT JOIN l5 ON l5.row = f.row // 32 AND l5.col = f.col // 32 LEFT JOIN l6 ON l6.row = f.row // 64 AND l6.col = f.col // 64""")
def pyramid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 1.0)
    return grid.pyramid_fill(grid.binned(points, meta), meta).select("row", "col", _near("value"))


@query(f"WITH {_sql_grid(5)} SELECT row, col, {_near_sql("avg(z)")} AS value FROM bin GROUP BY row, col")
def cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    return grid.binned(points, grid.plan(points, 5.0), "mean").select("row", "col", _near("value"))


@query(f"""WITH {_SURFACE}, s AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM filled)
SELECT row, col, trunc(n * 255)::int AS r, least(trunc(abs(sin(pi() * n)) * 200 + 40), 255)::int AS g, trunc((1 - n) * 255)::int AS b
FROM (SELECT row, col, least(greatest((value - lo) / greatest(hi - lo, 1e-6), 0), 1) AS n FROM filled, s)""")
def false_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.stretch(_surface(spark, sf_dir)[0])


@query(f"WITH {_SURFACE} SELECT row // 3 AS row, col // 3 AS col, value FROM filled WHERE row % 3 = 0 AND col % 3 = 0")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.decimate(_surface(spark, sf_dir)[0], 3)


@query(f"WITH {_sql_grid(4)} SELECT round(count(*) FILTER (WHERE n > 8) * 16.0 / 10000, 9) AS area_ha FROM (SELECT row, col, count(*) AS n FROM bin GROUP BY row, col)")
def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    n = grid.indexed(points, grid.plan(points, 4.0)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return grid.covered_hectares(n.select((F.col("n") - 8).alias("value")), 4.0).select(F.round("area_ha", 9).alias("area_ha"))


_POLYGON = [(30.0, 40.0), (120.0, 35.0), (150.0, 110.0), (70.0, 140.0)]
_RING = "(VALUES " + ", ".join(f"({i}, {x}::double, {y}::double, {x2}::double, {y2}::double)" for i, ((x, y), (x2, y2)) in enumerate(zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]], strict=True))) + ") AS t(i, x1, y1, x2, y2)"


@query(f"""SELECT pt_id, x, y FROM points p WHERE (SELECT sum(CASE WHEN (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END + x1 THEN 1 ELSE 0 END) FROM {_RING}) % 2 = 1""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "points").where(terrain.in_polygon(_POLYGON, F.col("x"), F.col("y"))).select("pt_id", "x", "y")


@query("""WITH r AS (SELECT x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2, first_value(x) OVER o AS x0, first_value(y) OVER o AS y0 FROM gcps WINDOW o AS (ORDER BY gcp_id))
SELECT round(0.5 * abs(sum(x * coalesce(y2, y0) - coalesce(x2, x0) * y)), 6) AS area_m2 FROM r""")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the ring that the control points make in the order of their ids."""
    ring = load(spark, sf_dir, "gcps").select(F.col("gcp_id").alias("i"), "x", "y")
    return terrain.polygon_area(ring).select(F.round("area_m2", 6).alias("area_m2"))


def _volume_sql(base: str) -> str:
    plane = {"lowest": "0.0 AS a, 0.0 AS b, min(value) AS c", "mean": "0.0 AS a, 0.0 AS b, avg(value) AS c", "custom": "0.0 AS a, 0.0 AS b, max(20.0::double) AS c",
             "fit": "regr_a AS a, regr_b AS b, c"}[base]
    fit = """fit AS (SELECT *, CASE WHEN xx * yy - xy * xy <= 1e-12 THEN 0 ELSE (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS regr_a, CASE WHEN xx * yy - xy * xy <= 1e-12 THEN 0 ELSE (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS regr_b
  FROM (SELECT avg(value) AS c, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, value) AS xz, covar_pop(y, value) AS yz FROM rim))"""
    chosen = f"base AS (SELECT {plane}, mx, my FROM fit)" if base == "fit" else f"base AS (SELECT {plane}, 0.0 AS mx, 0.0 AS my FROM rim)"
    return f"""WITH {_SURFACE}, g AS (SELECT f.row, f.col, f.value, m.minx + (f.col + 0.5) * 4 AS x, m.maxy - (f.row + 0.5) * 4 AS y FROM filled f, m),
step AS (SELECT *, greatest(trunc(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 4), 1)::bigint AS n FROM {_RING}),
pts AS (SELECT x1 + k::double / n * (x2 - x1) AS x, y1 + k::double / n * (y2 - y1) AS y FROM (SELECT *, unnest(range(n)) AS k FROM step)),
rim AS (SELECT g.* FROM pts, m JOIN g ON g.row = least(greatest(floor((m.maxy - pts.y) / 4), 0), m.ny - 1) AND g.col = least(greatest(floor((pts.x - m.minx) / 4), 0), m.nx - 1)),
{fit}, {chosen},
inside AS (SELECT g.*, a * (g.x - mx) + b * (g.y - my) + c AS base FROM g, base
  WHERE (SELECT sum(CASE WHEN (y1 > g.y) <> (y2 > g.y) AND g.x < (x2 - x1) * (g.y - y1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END + x1 THEN 1 ELSE 0 END) FROM {_RING}) % 2 = 1)
SELECT count(*) AS n_cells, round(sum(greatest(value - base, 0)) * 16, 3) AS cut_m3, round(sum(greatest(base - value, 0)) * 16, 3) AS fill_m3,
  round(sum(greatest(value - base, 0)) * 16 - sum(greatest(base - value, 0)) * 16, 3) AS net_m3, round((SELECT 0.5 * abs(sum(x1 * y2 - x2 * y1)) FROM {_RING}), 6) AS area_m2,
  round(least(count(*) * 16 / (SELECT 0.5 * abs(sum(x1 * y2 - x2 * y1)) FROM {_RING}), 1), 9)::double AS coverage, round(min(base), 6) AS base_z_min, round(max(base), 6) AS base_z_max FROM inside"""


def _volume(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    v = terrain.measure_volume(surface, meta, _POLYGON, base, 20.0)
    return v.select("n_cells", *[F.round(c, 3).alias(c) for c in ("cut_m3", "fill_m3", "net_m3")], *[F.round(c, n).alias(c) for c, n in (("area_m2", 6), ("coverage", 9), ("base_z_min", 6), ("base_z_max", 6))])


@query(_volume_sql("lowest"))
def volume_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(spark, sf_dir, "lowest")


@query(_volume_sql("mean"))
def volume_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(spark, sf_dir, "mean")


@query(_volume_sql("fit"))
def volume_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(spark, sf_dir, "fit")


@query(_volume_sql("custom"))
def volume_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(spark, sf_dir, "custom")


@query(f"""WITH {_SURFACE}, q AS (SELECT a.row, a.col, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM filled a JOIN filled b ON b.row = a.row AND b.col = a.col + 1
  JOIN filled c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN filled d ON d.row = a.row + 1 AND d.col = a.col),
l AS (SELECT *, k * 2.0::double AS level FROM (SELECT *, unnest(range(floor(least(a, b, c, d) / 2)::bigint + 1, floor(greatest(a, b, c, d) / 2)::bigint + 1)) AS k FROM q)),
x AS (SELECT k, (a >= level) = ((a + b + c + d) / 4 >= level) AS turned, list_filter([
    CASE WHEN (a >= level) <> (b >= level) THEN {{'r': row::double, 'c': col + (level - a) / (b - a)}} END, CASE WHEN (b >= level) <> (c >= level) THEN {{'r': row + (level - b) / (c - b), 'c': col + 1.0::double}} END,
    CASE WHEN (c >= level) <> (d >= level) THEN {{'r': row + 1.0::double, 'c': col + 1 - (level - c) / (d - c)}} END, CASE WHEN (d >= level) <> (a >= level) THEN {{'r': row + 1 - (level - d) / (a - d), 'c': col::double}} END],
    lambda p: p IS NOT NULL) AS p FROM l),
s AS (SELECT k, unnest(CASE WHEN len(p) = 2 THEN [{{'p': p[1], 'q': p[2]}}] WHEN turned THEN [{{'p': p[1], 'q': p[2]}}, {{'p': p[3], 'q': p[4]}}] ELSE [{{'p': p[4], 'q': p[1]}}, {{'p': p[2], 'q': p[3]}}] END) AS s FROM x)
SELECT k, {_near_sql("s.p.r")} AS r1, {_near_sql("s.p.c")} AS c1, {_near_sql("s.q.r")} AS r2, {_near_sql("s.q.c")} AS c2 FROM s""")
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, _ = _surface(spark, sf_dir)
    return terrain.contour_segments(surface, 2.0).select("k", *[_near(c) for c in ("r1", "c1", "r2", "c2")])


def _line_sql(cell: float, interval: float, rounds: int = 20) -> str:
    """CTEs up to `line`: the contour lines of the smoothed surface (k, segments, length, closed), components of segments that share a grid edge."""
    smooth = f"""w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4])::double AS k)),
h AS (SELECT f.row, f.col, sum(s.value * w.w) AS value FROM filled f, w, m, filled s WHERE s.row = f.row AND s.col = {_mirror('f.col + w.k::bigint', 'm.nx')} GROUP BY f.row, f.col),
blur AS (SELECT f.row, f.col, sum(s.value * w.w) AS value FROM h f, w, m, h s WHERE s.col = f.col AND s.row = {_mirror('f.row + w.k::bigint', 'm.ny')} GROUP BY f.row, f.col)"""
    surface = f"{_sql_grid(cell)}, v AS (SELECT row, col, max(z) AS value FROM bin GROUP BY row, col), {_DENSE}, {_FILL}"
    cross = ("row::double", "col + (level - a) / (b - a)", "2 * row", "2 * col + 1"), ("row + (level - b) / (c - b)", "col + 1.0::double", "2 * row + 1", "2 * col + 2"), (
        "row + 1.0::double", "col + 1 - (level - c) / (d - c)", "2 * row + 2", "2 * col + 1"), ("row + 1 - (level - d) / (a - d)", "col::double", "2 * row + 1", "2 * col")
    sides = ", ".join(f"CASE WHEN ({p} >= level) <> ({q} >= level) THEN {{'r': {r}, 'c': {c}, 'i': {i}, 'j': {j}}} END" for (p, q), (r, c, i, j) in zip(("ab", "bc", "cd", "da"), cross, strict=True))
    parts = [surface, smooth, f"""q AS (SELECT a.row, a.col, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM blur a JOIN blur b ON b.row = a.row AND b.col = a.col + 1
  JOIN blur c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN blur d ON d.row = a.row + 1 AND d.col = a.col),
l AS (SELECT *, k * {interval}::double AS level FROM (SELECT *, unnest(range(floor(least(a, b, c, d) / {interval})::bigint + 1, floor(greatest(a, b, c, d) / {interval})::bigint + 1)) AS k FROM q)),
x AS (SELECT k, (a >= level) = ((a + b + c + d) / 4 >= level) AS turned, list_filter([{sides}], lambda p: p IS NOT NULL) AS p FROM l),
s AS (SELECT k, unnest(CASE WHEN len(p) = 2 THEN [{{'p': p[1], 'q': p[2]}}] WHEN turned THEN [{{'p': p[1], 'q': p[2]}}, {{'p': p[3], 'q': p[4]}}] ELSE [{{'p': p[4], 'q': p[1]}}, {{'p': p[2], 'q': p[3]}}] END) AS s FROM x),
seg AS MATERIALIZED (SELECT hash(row_number() OVER ()) AS n, k, s.p AS p, s.q AS q FROM s),
node AS MATERIALIZED (SELECT n, k, p.i AS i, p.j AS j FROM seg UNION ALL SELECT n, k, q.i, q.j FROM seg),
e0 AS MATERIALIZED (SELECT a.n AS u, b.n AS v FROM node a JOIN node b ON a.k = b.k AND a.i = b.i AND a.j = b.j AND a.n <> b.n),
c0 AS (SELECT n, n AS c FROM seg)"""]
    for r in range(1, rounds + 1):  # each takes the least of itself and its neighbours; numbers are hashes, so that a round leaves about two thirds
        parts += [f"h{r} AS MATERIALIZED (SELECT u, least(u, min(v)) AS h FROM e{r - 1} GROUP BY u)", f"c{r} AS MATERIALIZED (SELECT n, coalesce(h, c) AS c FROM c{r - 1} LEFT JOIN h{r} ON u = c)",
                  f"e{r} AS MATERIALIZED (SELECT DISTINCT a.h AS u, b.h AS v FROM e{r - 1} e JOIN h{r} a ON a.u = e.u JOIN h{r} b ON b.u = e.v WHERE a.h <> b.h)"]
    parts.append(f"""ends AS (SELECT c.c, count(*) AS ends FROM (SELECT min(n) AS n FROM node GROUP BY k, i, j HAVING count(*) = 1) e JOIN c{rounds} c USING (n) GROUP BY 1),
line AS (SELECT any_value(seg.k) AS k, count(*) AS segments, sum(sqrt((p.r - q.r) ** 2 + (p.c - q.c) ** 2)) * {cell}::double AS length, any_value(ends.ends) IS NULL AS closed
  FROM seg JOIN c{rounds} c USING (n) LEFT JOIN ends ON ends.c = c.c GROUP BY c.c)""")
    return ", ".join(parts)


def _length() -> Column:
    step = F.transform(F.sequence(F.lit(1), F.size("coords") - 1), lambda i: F.sqrt(F.pow(F.get("coords", i)["x"] - F.get("coords", i - 1)["x"], 2) + F.pow(F.get("coords", i)["y"] - F.get("coords", i - 1)["y"], 2)))
    return F.aggregate(step, F.lit(0.0), lambda a, b: a + b)


@query(f"WITH {_line_sql(4, 2.0)} SELECT k * 2.0::double AS level, k % 5 = 0 AS is_index, segments, closed, round(length, 3) AS length FROM line")
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir)
    return terrain.contours(surface, meta, 2.0).select("level", "is_index", "segments", "closed", F.round(_length(), 3).alias("length"))


@query("""WITH m AS (SELECT min(x) AS minx, min(y) AS miny FROM points),
c AS (SELECT floor((y - miny) / 5::double)::bigint AS row, floor((x - minx) / 5::double)::bigint AS col, avg(z) AS z FROM points, m GROUP BY 1, 2),
v AS (SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS vid FROM c)
SELECT f.a, f.b, f.c FROM (SELECT unnest([{'a': a.vid, 'b': b.vid, 'c': c.vid}, {'a': b.vid, 'b': d.vid, 'c': c.vid}]) AS f
  FROM v a JOIN v b ON b.row = a.row AND b.col = a.col + 1 JOIN v c ON c.row = a.row + 1 AND c.col = a.col JOIN v d ON d.row = a.row + 1 AND d.col = a.col + 1)""")
def heightfield_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.heightfield(load(spark, sf_dir, "points"), 5.0)[1]


@query(f"""WITH m AS (SELECT min(x) AS minx, min(y) AS miny FROM points),
c AS (SELECT floor((y - miny) / 5::double)::bigint AS row, floor((x - minx) / 5::double)::bigint AS col, avg(z) AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM points, m GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY row, col) - 1 AS vid, round(minx + (col + 0.5) * 5, 6) AS x, round(miny + (row + 0.5) * 5, 6) AS y, {_near_sql("z")} AS z, floor(r)::int AS r, floor(g)::int AS g, floor(b)::int AS b FROM c, m""")
def heightfield_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = terrain.heightfield(load(spark, sf_dir, "points"), 5.0)[0]
    return v.select("vid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), _near("z"), *"rgb")


@query("""WITH d AS (SELECT a.pt_id, b.pt_id AS nbr, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM tie_points a JOIN tie_points b ON a.pt_id <> b.pt_id),
k AS (SELECT pt_id, d2, row_number() OVER (PARTITION BY pt_id ORDER BY d2, nbr) AS r FROM d), n AS (SELECT pt_id, avg(sqrt(d2)) AS mean_d FROM k WHERE r <= 8 GROUP BY pt_id)
SELECT pt_id, round(mean_d, 6) AS mean_d, mean_d > (SELECT avg(mean_d) + 3 * stddev_pop(mean_d) FROM n) AS noisy FROM n""")
def knn_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.outliers(load(spark, sf_dir, "tie_points")).select("pt_id", F.round("mean_d", 6).alias("mean_d"), "noisy")


@query("""WITH d AS (SELECT a.pt_id, b.pt_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM tie_points a JOIN tie_points b ON a.pt_id <> b.pt_id),
k AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d2, nbr_id) AS rank FROM d) SELECT pt_id, nbr_id, rank::int AS rank FROM k WHERE rank <= 3""")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbours(load(spark, sf_dir, "tie_points"), 3).select("pt_id", "nbr_id", "rank")


@query(f"""WITH d AS (SELECT a.pt_id, b.pt_id AS nbr, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM tie_points a CROSS JOIN tie_points b),
k AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY x * x + y * y + z * z, nbr) AS r FROM d),
c AS (SELECT pt_id, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM k WHERE r <= 12 GROUP BY pt_id),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
t AS (SELECT *, (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det FROM p),
low AS (SELECT pt_id, q + 2 * p * cos(acos(least(greatest(det / greatest(2 * p * p * p, 1e-300), -1), 1)) / 3 + 2 * pi() / 3) AS low FROM t)
SELECT pt_id, {_near_sql('sqrt(greatest(low, 0))')} AS residual FROM low""")
def plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.plane_residual(load(spark, sf_dir, "tie_points")).select("pt_id", _near("residual"))


@query()
def cloud_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "tie_points").withColumns({c: F.pmod(F.xxhash64("pt_id", F.lit(c)), F.lit(256)).cast("int") for c in "rgb"})
    return cloud.features(points)


def _median_of(src: str, name: str, h: int) -> str:
    return _MEDIAN.format(src=src, offsets=_offsets(h)).replace("med AS (", f"{name} AS (", 1)


def _opening_of(src: str, name: str, w: int) -> str:
    """CTEs that open a dense grid with a (2w + 1) square."""
    steps, before = [], src
    for k, (f, axis, along) in enumerate((("min", "row", "col"), ("min", "col", "row"), ("max", "row", "col"), ("max", "col", "row"))):
        steps.append(f"{name}_{k} AS (SELECT row, col, {f}(value) OVER (PARTITION BY {axis} ORDER BY {along} ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS value FROM {before})")
        before = f"{name}_{k}"
    return ", ".join([*steps, f"{name} AS (SELECT * FROM {before})"])


def _ground_sql() -> str:
    """The progressive filter's rounds at 4 m: windows of 1, 2, 4 ... 32 cells, limits up to 2.5 m."""
    parts = [_sql_grid(4), "v AS (SELECT row, col, min(z) AS value FROM bin GROUP BY row, col)", _DENSE, _FILL]
    before = "filled"
    for w in (1, 2, 4, 8, 16, 32):
        limit = min(0.25 + 0.15 * (w * 4.0), 2.5)
        parts += [_opening_of(before, f"o{w}", w), f"g{w} AS (SELECT f.row, f.col, CASE WHEN f.value - o.value > {limit!r}::double THEN o.value ELSE f.value END AS value FROM {before} f JOIN o{w} o USING (row, col))"]
        before = f"g{w}"
    parts.append(_median_of(before, "ground", 1))
    return f"WITH {', '.join(parts)} SELECT b.pt_id, b.z - g.value AS hag, b.z - g.value <= 0.35 AS ground FROM bin b JOIN ground g USING (row, col)"


def _projection_sql() -> str:
    """Top surface at 4 m without spikes, holes filled from a pyramid of means, opened by 2 cells, median of 3."""
    levels = [f"l{k} AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM {'p0' if k == 1 else f'l{k - 1}'} GROUP BY 1, 2)" for k in range(1, 6)]
    joins = " ".join(f"LEFT JOIN l{k} ON l{k}.row = f.row // {2 ** k} AND l{k}.col = f.col // {2 ** k}" for k in range(1, 6))
    parts = [_SURFACE, _median_of("filled", "around", 4), "kept AS (SELECT v.row, v.col, v.value FROM v JOIN around USING (row, col) WHERE v.value - around.value <= 15)",
             "p0 AS (SELECT f.row, f.col, k.value FROM filled f LEFT JOIN kept k USING (row, col))", *levels,
             f"whole AS (SELECT f.row, f.col, coalesce(f.value, {', '.join(f'l{k}.value' for k in range(1, 6))}) AS value FROM p0 f {joins})",
             _opening_of("whole", "opened", 2), _median_of("opened", "smooth", 1)]
    return f"WITH {', '.join(parts)} SELECT row, col, {_near_sql('value')} AS value FROM smooth"


@query(_ground_sql())
def ground_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 4.0)
    return morph.height_above(points, morph.ground_surface(points, meta), meta).select("pt_id", "hag", (F.col("hag") <= 0.35).alias("ground"))


@query()
def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "tie_points").withColumns({c: F.pmod(F.xxhash64("pt_id", F.lit(c)), F.lit(256)).cast("int") for c in "rgb"})
    return cloud.classify(points).select("pt_id", "cls")


@query(_projection_sql())
def projection_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morph.projection_surface(load(spark, sf_dir, "points"), 4.0)[0].select("row", "col", _near("value"))


@query("SELECT DISTINCT floor(x / 10)::bigint AS i, floor(y / 10)::bigint AS j FROM points UNION SELECT DISTINCT floor(est_x / 10)::bigint, floor(est_y / 10)::bigint FROM cameras WHERE est_x IS NOT NULL")
def seen_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda x, y: [F.floor(F.col(x) / 10).alias("i"), F.floor(F.col(y) / 10).alias("j")]
    points, cameras = load(spark, sf_dir, "points"), load(spark, sf_dir, "cameras").where("est_x is not null")
    return points.select(*cell("x", "y")).unionByName(cameras.select(*cell("est_x", "est_y"))).distinct()
