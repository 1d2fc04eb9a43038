"""Queries over similarity fits, projection, colour balance, volumes of learning and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import geo
from skyraster.operators import bundle as bundle_
from skyraster.operators import cloud, control, grid, knn, ml, ortho, terrain, tiles, warp
from skyraster.plans.adapters import load
from skyraster.plans.catalog import query
from skyraster.plans.queries_grid import _DENSE, _FILL, _near, _near_sql, _sql_grid
from skyraster.plans.tables import cut, numbered
from skyraster.schema import RasterMeta

_SIM = control.similarity_from([2, 0, -1, 0, 1, 0, 0, 0, 0, 1, 500000, 4000000, 50])


@query(f"SELECT pid, {_near_sql('500000 - 2 * sy')} AS x, {_near_sql('4000000 + 2 * sx')} AS y, {_near_sql('50 + 2 * sz')} AS z FROM pairs")
def similarity_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = _SIM.columns("sx", "sy", "sz")
    return load(spark, sf_dir, "pairs").select("pid", x.alias("x"), y.alias("y"), z.alias("z")).select("pid", *map(_near, "xyz"))


@query(f"SELECT pid, {_near_sql('(dy - 4000000) / 2')} AS x, {_near_sql('-(dx - 500000) / 2')} AS y, {_near_sql('(dz - 50) / 2')} AS z FROM pairs")
def similarity_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = _SIM.inverse().columns("dx", "dy", "dz")
    return load(spark, sf_dir, "pairs").select("pid", x.alias("x"), y.alias("y"), z.alias("z")).select("pid", *map(_near, "xyz"))


@query("""WITH e AS (SELECT label % 2 = 1 AS is_check, 500000 - 2 * sy - dx AS ex, 4000000 + 2 * sx - dy AS ey, 50 + 2 * sz - dz AS ez FROM pairs)
SELECT is_check, count(*) AS n, round(sqrt(avg(ex * ex + ey * ey + ez * ez)), 6) AS rmse, round(sqrt(avg(ex * ex)), 6) AS rmse_x, round(sqrt(avg(ey * ey)), 6) AS rmse_y, round(sqrt(avg(ez * ez)), 6) AS rmse_z FROM e GROUP BY is_check""")
def control_check_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = control.residuals(load(spark, sf_dir, "pairs").withColumn("is_check", F.col("label") % 2 == 1), _SIM)
    out = control.rmse(found, "is_check")
    return out.select("is_check", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "rmse_x", "rmse_y", "rmse_z")])


@query()
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = control.fit_similarity(load(spark, sf_dir, "pairs"))
    return spark.createDataFrame([(sim.s, sim.R.reshape(-1).tolist(), sim.t.tolist())], "s double, r array<double>, t array<double>")


@query("""WITH c AS (SELECT p.pt_id, p.x - 100 AS xc, -(p.y - 100) AS yc, -(p.z - 150) AS zc FROM points p), u AS (SELECT pt_id, 3700 * xc / zc + 2640 AS u, 3700 * yc / zc + 1978 AS v FROM c WHERE zc > 1e-6)
SELECT pt_id, round(u, 4) AS u, round(v, 4) AS v FROM u WHERE u BETWEEN 5280 * 0.02 AND 5280 - 5280 * 0.02 AND v BETWEEN 3956 * 0.02 AND 3956 - 3956 * 0.02""")
def project_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.quaternion_rows(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    xc, yc, zc = geo.camera_point(rows, "x", "y", "z", F.lit(-100.0), F.lit(100.0), F.lit(150.0))
    u, v = geo.pinhole(xc, yc, zc, F.lit(3700.0), F.lit(3700.0), F.lit(2640.0), F.lit(1978.0))
    out = load(spark, sf_dir, "points").select("pt_id", u.alias("u"), v.alias("v"))
    return out.where(geo.inside("u", "v", F.lit(5280), F.lit(3956), 0.02)).select("pt_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


_PAIR_SQL = """WITH s AS (SELECT pt_id, site, row_number() OVER (PARTITION BY pt_id ORDER BY d2, site) AS rank FROM (
  SELECT p.pt_id, c.cam_id AS site, (p.x - c.est_x) * (p.x - c.est_x) + (p.y - c.est_y) * (p.y - c.est_y) AS d2 FROM points p CROSS JOIN cameras c WHERE c.est_x IS NOT NULL)),
k AS (SELECT s.pt_id, site, rank, ln(least(greatest(p.r + site % 7, 8), 255)) AS red, ln(least(greatest(p.g + site % 5, 8), 255)) AS green, ln(least(greatest(p.b + site % 3, 8), 255)) AS blue FROM s JOIN points p USING (pt_id) WHERE rank <= 2)
SELECT a.site AS ci, b.site AS cj, count(*) AS n, round(avg(b.red - a.red), 6) AS red, round(avg(b.green - a.green), 6) AS green, round(avg(b.blue - a.blue), 6) AS blue FROM k a JOIN k b ON a.pt_id = b.pt_id AND a.rank = 1 AND b.rank = 2 GROUP BY 1, 2"""


def _colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = load(spark, sf_dir, "cameras").where("est_x is not null").select(F.col("cam_id").alias("site"), F.col("est_x").alias("sx"), F.col("est_y").alias("sy"))
    near = knn.nearest_sites(load(spark, sf_dir, "points").select("pt_id", "x", "y", "r", "g", "b"), sites, 2, ["pt_id"])
    return near.select(F.col("pt_id").alias("sample"), "site", "rank", *[(F.col(c) + F.col("site") % k).cast("double").alias(n) for c, k, n in (("r", 7, "red"), ("g", 5, "green"), ("b", 3, "blue"))])


@query(_PAIR_SQL)
def pair_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ortho.pair_ratios(_colors(spark, sf_dir)).select("ci", "cj", "n", *[F.round(c, 6).alias(c) for c in ("red", "green", "blue")])


@query()
def camera_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    colors = _colors(spark, sf_dir)
    ratios = cut(ortho.pair_ratios(colors), "gain-pairs")
    near = ratios.select(F.explode(F.array("ci", "cj")).alias("site")).distinct()  # all that are near a point, if there are two
    sites = sorted(near.toArrow()["site"].to_pylist() or [r.site for r in colors.select("site").distinct().collect()])
    gains = ortho.solve_gains(ratios, sites)
    found = np.array(list(gains.values())).reshape(-1, 3)
    return spark.createDataFrame(pd.DataFrame({"site": np.array(list(gains), np.int64), **{c: found[:, k] for k, c in enumerate(("red", "green", "blue"))}}), "site long, red double, green double, blue double")


@query("""WITH v AS (SELECT o_orderkey AS id, (o_orderkey * 31) % 256 AS r1, (o_orderkey * 57) % 256 AS g1, (o_orderkey * 91) % 256 AS b1, (o_orderkey * 31 + o_orderkey % 60) % 256 AS r2, (o_orderkey * 57 + o_orderkey % 50) % 256 AS g2,
  (o_orderkey * 91 + o_orderkey % 40) % 256 AS b2, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1.0 + o_orderkey % 4 END::double AS w1, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1.0 + o_orderkey % 19 END::double AS w2 FROM orders),
d AS (SELECT *, greatest(abs(r1 - r2), abs(g1 - g2), abs(b1 - b2)) AS d FROM v)
SELECT id, """ + ", ".join(f"least(greatest(round_even(CASE WHEN w2 IS NULL THEN {c}1 WHEN w1 IS NULL THEN {c}2 WHEN d < 30 THEN ({c}1 * w1 + {c}2 * w2) / (w1 + w2) WHEN w2 > 4 * w1 THEN {c}2 ELSE {c}1 END, 0), 0), 255)::int AS {n}" for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))) + " FROM d")
def view_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = {n: (k * m) % 256 for n, m in (("red", 31), ("green", 57), ("blue", 91))}
    two = {n: (k * m + k % s) % 256 for n, m, s in (("red", 31, 60), ("green", 57, 50), ("blue", 91, 40))}
    rows = load(spark, sf_dir, "orders").select(k.alias("id"), *[c.cast("double").alias(f"{n}1") for n, c in one.items()], *[c.cast("double").alias(f"{n}2") for n, c in two.items()],
                                                F.when(k % 9 != 0, 1.0 + k % 4).alias("w1"), F.when(k % 7 != 0, 1.0 + k % 19).alias("w2"))
    return rows.select("id", *ortho.blend())


@query()
def true_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 4.0)
    surface = cut(grid.native(points, meta), "ortho-surface")
    sim = control.similarity_from([1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0])
    cams = load(spark, sf_dir, "cameras").where("est_x is not null").select(
        F.col("cam_id").cast("string").alias("site"), F.col("est_x").alias("sx"), F.col("est_y").alias("sy"), F.lit(64).alias("width"), F.lit(48).alias("height"),
        *[F.lit(v).alias(c) for c, v in (("qw", 0.0), ("qx", 1.0), ("qy", 0.0), ("qz", 0.0), ("fx", 45.0), ("fy", 45.0), ("ppx", 32.0), ("ppy", 24.0))], (-F.col("est_x")).alias("tx"), F.col("est_y").alias("ty"), F.col("est_z").alias("tz"))

    def paint(batches):
        for b in batches:
            data = [np.random.default_rng(int(s)).integers(60, 200, (48, 64, 3), np.uint8).tobytes() for s in b["site"]]
            yield pd.DataFrame({"site": b["site"], "h": 48, "w": 64, "data": data})

    photos = cams.select("site").mapInPandas(paint, "site string, h int, w int, data binary")
    gains = {r.site: np.ones(3) for r in cams.select("site").collect()}
    return ortho.true_ortho(surface, meta, grid.plan(points, 5.0), cams, photos, sim, gains)


@query(f"""WITH {_sql_grid(5)}, v AS (SELECT row, col, {{'r': arg_max(r, {{'z': z, 'i': pt_id}}), 'g': arg_max(g, {{'z': z, 'i': pt_id}}), 'b': arg_max(b, {{'z': z, 'i': pt_id}})}} AS value FROM bin GROUP BY row, col), {_DENSE}, {_FILL}
SELECT row, col, value.r::double AS red, value.g::double AS green, value.b::double AS blue FROM filled""")
def splat_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "points")
    return ortho.splat(points, grid.plan(points, 5.0))


def _tiles_sql(cell: float, east: float, north: float, zooms: dict[int, int]) -> str:
    """Sums of the pixels of web tiles: a colour grid in mercator metres, halved by alpha, sampled between the four nearest cells. zooms: overview by zoom."""
    names = ("red", "green", "blue")
    parts = [f"""{_sql_grid(cell)}, v AS (SELECT row, col, {', '.join(f"arg_max({c}, {{'z': z, 'i': pt_id}})::double AS {n}" for c, n in zip("rgb", names, strict=True))}, 255.0::double AS alpha FROM bin GROUP BY row, col),
l0 AS (SELECT r.row, c.col, {', '.join(f'coalesce(v.{n}, 0) AS {n}' for n in (*names, 'alpha'))} FROM (SELECT unnest(range(ny)) AS row FROM m) r CROSS JOIN (SELECT unnest(range(nx)) AS col FROM m) c LEFT JOIN v ON v.row = r.row AND v.col = c.col)"""]
    for k in range(1, max(zooms.values()) + 1):
        parts.append(f"l{k} AS (SELECT row // 2 AS row, col // 2 AS col, {', '.join(f'round_even(sum({n} * alpha) / greatest(sum(alpha), 1), 0) AS {n}' for n in names)}, round_even(sum(alpha) / count(*), 0) AS alpha FROM l{k - 1} GROUP BY 1, 2)")
    drawn = []
    for z, k in zooms.items():
        size = 2 * geo.ORIGIN / (1 << z)
        res = size / 256
        place = f"""(SELECT x // 256 AS tx, y // 256 AS ty, (m.maxy + {north}::double - ({geo.ORIGIN!r}::double - (y // 256) * {size!r}::double - (y % 256 + 0.5) * {res!r}::double)) / {cell}::double AS row,
  (-{geo.ORIGIN!r}::double + (x // 256) * {size!r}::double + (x % 256 + 0.5) * {res!r}::double - (m.minx + {east}::double)) / {cell}::double AS col FROM m,
  (SELECT unnest(range(floor((minx + {east} + {geo.ORIGIN!r}) / {res!r})::bigint - 1, ceil((minx + nx * {cell} + {east} + {geo.ORIGIN!r}) / {res!r})::bigint + 1)) AS x FROM m),
  (SELECT unnest(range(floor(({geo.ORIGIN!r} - maxy - {north}) / {res!r})::bigint - 1, ceil(({geo.ORIGIN!r} - maxy - {north} + ny * {cell}) / {res!r})::bigint + 1)) AS y FROM m))"""
        corners = [(dr, dc) for dr in (0, 1) for dc in (0, 1)]
        w = [f"(CASE WHEN g{dr}{dc}.alpha IS NULL THEN 0 ELSE abs({1 - dr} - (r - r0)) * abs({1 - dc} - (c - c0)) END)" for dr, dc in corners]
        alpha = " + ".join(f"{x} * coalesce(g{dr}{dc}.alpha, 0)" for x, (dr, dc) in zip(w, corners, strict=True))
        colour = lambda n: " + ".join(f"{x} * coalesce(g{dr}{dc}.alpha, 0) * coalesce(g{dr}{dc}.{n}, 0)" for x, (dr, dc) in zip(w, corners, strict=True))  # noqa: B023, E731
        joins = " ".join(f"LEFT JOIN l{k} g{dr}{dc} ON g{dr}{dc}.row = r0 + {dr} AND g{dr}{dc}.col = c0 + {dc}" for dr, dc in corners)
        drawn.append(f"""SELECT {z} AS z, tx AS x, ty AS y, {', '.join(f'CASE WHEN a > 0 THEN round_even({n} / a, 0) ELSE 0 END AS {n}' for n in names)}, round_even(a / w, 0) AS alpha
FROM (SELECT tx, ty, {' + '.join(w)} AS w, {alpha} AS a, {', '.join(f'{colour(n)} AS {n}' for n in names)}
  FROM (SELECT *, floor(r)::bigint AS r0, floor(c)::bigint AS c0 FROM (SELECT tx, ty, row / {2 ** k} - 0.5 AS r, col / {2 ** k} - 0.5 AS c FROM {place} p, m WHERE row >= 0 AND row < m.ny AND col >= 0 AND col < m.nx)) {joins})""")
    return f"WITH {', '.join(parts)} SELECT z, x, y, count(*) FILTER (WHERE alpha > 0) AS opaque, {', '.join(f'sum({n})::bigint AS {n}' for n in (*names, 'alpha'))} FROM ({' UNION ALL '.join(drawn)}) GROUP BY z, x, y HAVING max(alpha) > 0"


def _mosaic(spark: SparkSession, sf_dir: str, epsg: int, east: float, north: float) -> tuple[DataFrame, RasterMeta]:
    """Colours of the topmost points on a 4 m grid, where there are any, at a place on the globe."""
    points = load(spark, sf_dir, "points")
    meta = grid.plan(points, 4.0)
    top = grid.indexed(points, meta).groupBy("row", "col").agg(*[F.max_by(c, F.struct("z", "pt_id")).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    return top.withColumn("alpha", F.lit(255)), RasterMeta(meta.minx + east, meta.maxy + north, 4.0, meta.nx, meta.ny, epsg)


@query(_tiles_sql(4, 9_840_000, 2_570_000, {13: 2, 14: 1, 15: 0, 16: 0}))
def web_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.cut_tiles(*_mosaic(spark, sf_dir, 3857, 9_840_000, 2_570_000), (13, 16))

    def sums(batches):
        for b in batches:
            images = [tiles.unpng(x).reshape(-1, 4).astype(np.int64) for x in b["png"]]
            yield pd.DataFrame({**{c: b[c] for c in "zxy"}, "opaque": [int((i[:, 3] > 0).sum()) for i in images], **{n: [int(i[:, k].sum()) for i in images] for k, n in enumerate(("red", "green", "blue", "alpha"))}})

    return found.mapInPandas(sums, "z int, x long, y long, opaque long, red long, green long, blue long, alpha long")


@query()
def mercator_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warp.preview(*_mosaic(spark, sf_dir, 32645, 500_000, 2_500_000), 1400)[0]


@query()
def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = load(spark, sf_dir, "cameras").where("est_x is not null").select("cam_id", F.col("est_x").alias("cx"), F.col("est_y").alias("cy"), F.col("est_z").alias("cz"))
    marks = load(spark, sf_dir, "observations").select("gcp_id", "cam_id").join(load(spark, sf_dir, "gcps").select("gcp_id", "x", "y", "z"), "gcp_id").join(cams, "cam_id")
    depth = F.col("cz") - F.col("z")
    zero = F.lit(0.0)
    seen = marks.withColumn("px", 3700 * (F.col("x") - F.col("cx")) / depth).withColumn("py", -3700 * (F.col("y") - F.col("cy")) / depth).withColumns(
        {"p00": F.lit(3700.0), "p01": zero, "p02": zero, "p03": -3700 * F.col("cx"), "p10": zero, "p11": F.lit(-3700.0), "p12": zero, "p13": 3700 * F.col("cy"), "p20": zero, "p21": zero, "p22": F.lit(-1.0), "p23": F.col("cz")})
    return control.triangulate(control.rays(seen, cams.select("cam_id")))


def _flight(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """Tie points seen from four cameras each and control points from six, as pixels of straight views with an error of up to half a pixel,
    and a start off by decimetres: (points, observed, rotation vectors, translations). All errors are hashes of the rows' keys."""
    off = lambda size, *key: (F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, str) and not k.startswith("=") else F.col(k[1:]) for k in key]), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 2 * size
    cams = cut(numbered(load(spark, sf_dir, "cameras").where("est_x is not null"), ["cam_id"], "cam").select(F.col("cam").cast("int").alias("cam"), "cam_id", "est_x", "est_y", "est_z"), "flight")
    ties = load(spark, sf_dir, "tie_points").select(F.col("pt_id").alias("pid"), (F.col("x") * 3 + 100).alias("x"), (F.col("y") * 3 + 100).alias("y"), (F.col("z") / 5).alias("z"), F.lit(False).alias("fixed"))
    control_ = load(spark, sf_dir, "gcps").select((-1 - F.col("gcp_id")).alias("pid"), "x", "y", "z", F.lit(True).alias("fixed"))
    sites = cams.select(F.col("cam").alias("site"), F.col("est_x").alias("sx"), F.col("est_y").alias("sy"))
    near = knn.nearest_sites(ties, sites, 4, ["pid"]).unionByName(knn.nearest_sites(control_, sites, 6, ["pid"]))
    seen = near.join(control.small(cams), F.col("site") == F.col("cam"))
    depth = F.col("est_z") - F.col("z")
    observed = seen.select("pid", "cam", (2640 + 3700 * (F.col("x") - F.col("est_x")) / depth + off(0.5, "=pid", "=cam_id", "u")).alias("u"), (1978 - 3700 * (F.col("y") - F.col("est_y")) / depth + off(0.5, "=pid", "=cam_id", "v")).alias("v"))
    start = ties.select("pid", *[(F.col(c) + off(0.3, "=pid", c)).alias(c) for c in "xyz"], "fixed")
    rows = cams.select("cam", *[(F.col(f"est_{c}") + off(0.3, "=cam_id", c)).alias(c) for c in "xyz"], *[off(0.003, "=cam_id", f"r{c}").alias(f"r{c}") for c in "xyz"]).orderBy("cam").toPandas()
    turns = rows[["rx", "ry", "rz"]].to_numpy() + [np.pi, 0, 0]
    return start.unionByName(control_), observed, turns, -np.einsum("nij,nj->ni", control.rotation_matrix(turns), rows[["x", "y", "z"]].to_numpy())


@query()
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusts all cameras and tie points of the tables; control points stay where they are."""
    points, observed, turns, shifts = _flight(spark, sf_dir)
    out = bundle_.adjust(points, observed, turns, shifts, np.array([3700.0, 2640, 1978, 0]))
    return spark.createDataFrame([(out.n_obs, out.rmse_before, out.rmse_after)], "n_obs int, rmse_before double, rmse_after double")


@query()
def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    verts, faces = terrain.heightfield(load(spark, sf_dir, "points"), 5.0)
    return terrain.sample_faces(verts, faces)


@query()
def forest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that learns the rule-based classes of the points from their features."""
    points = load(spark, sf_dir, "tie_points").withColumns({c: F.pmod(F.xxhash64("pt_id", F.lit(c)), F.lit(256)).cast("int") for c in "rgb"})
    data = cut(cloud.features(points).withColumn("cls", F.when(F.col("hag") > 20, 6).when(F.col("greenness") > 0.1, 5).otherwise(2)), "forest")
    return ml.train(data).confusion


@query("""SELECT stage, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)::timestamp) AS hour_ms, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type AS stage, ts, value FROM events) GROUP BY 1, 2""")
def stage_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), F.date_trunc("hour", "ts").alias("hour"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("stage", F.unix_millis(F.col("hour").cast("timestamp")).alias("hour_ms"), "n", "total")
