"""Queries over the smaller operators: views, boxes, rotations, headers, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import geo, photo
from skyraster.operators import cloud, control, ml, ortho, terrain
from skyraster.plans import report
from skyraster.plans.adapters import load
from skyraster.plans.catalog import query
from skyraster.plans.queries_catalog import _EXIF_SQL
from skyraster.plans.queries_grid import _near, _near_sql, _surface
from skyraster.sources import binary, text_models


@query("""WITH e AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM points),
p AS (SELECT floor((maxy - y) / (maxy - miny) * 59)::bigint AS row, floor((x - minx) / (maxx - minx) * 79)::bigint AS col, z, pt_id, r, g, b FROM points, e)
SELECT row, col, arg_max(r, {'z': z, 'i': pt_id}) AS r, arg_max(g, {'z': z, 'i': pt_id}) AS g, arg_max(b, {'z': z, 'i': pt_id}) AS b, max(z) AS z FROM p GROUP BY row, col""")
def top_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.render_top(load(spark, sf_dir, "points"), 80, 60)


@query("SELECT pt_id, floor((x + 500000) / 100) * 100.0::double AS ox, floor((y + 2500000) / 100) * 100.0::double AS oy FROM points")
def mesh_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ox, oy, _ = terrain.offset(F.col("x") + 500_000, F.col("y") + 2_500_000)
    return load(spark, sf_dir, "points").select("pt_id", ox.alias("ox"), oy.alias("oy"))


@query("SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM (SELECT x, y FROM gcps UNION ALL SELECT est_x, est_y FROM cameras)")
def bounds_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = load(spark, sf_dir, "gcps").select("x", "y").unionByName(load(spark, sf_dir, "cameras").select(F.col("est_x").alias("x"), F.col("est_y").alias("y")))
    return spots.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


@query("SELECT avg((pt_id % 9)::double) AS mean_reproj_px FROM points")
def mean_reproj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_models.mean_error(load(spark, sf_dir, "points").select((F.col("pt_id") % 9).cast("double").alias("err")))


@query("SELECT 'model/' || (page_id % 7) AS folder, max(length(html)) AS size FROM pages GROUP BY 1 ORDER BY size DESC, folder LIMIT 1")
def largest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("model/"), (F.col("page_id") % 7).cast("string"), F.lit("/f"), F.col("page_id").cast("string"))
    files = load(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").cast("long").alias("length"))
    return text_models.largest_model(files)


@query("SELECT cam_id, coalesce(epoch_ms(strptime(datetime, '%Y:%m:%d %H:%M:%S')), -1) AS taken_ms FROM cameras")
def capture_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cameras").select("cam_id", F.coalesce(F.unix_millis(photo.exif_time()), F.lit(-1)).alias("taken_ms"))


@query("SELECT cam_id, round(CASE WHEN cam_id % 2 = 0 THEN -1 ELSE 1 END * (cam_id % 90 + (cam_id % 60) / 60.0 + (cam_id % 50 + 0.5) / 3600.0), 9) AS deg FROM cameras")
def dms_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("cam_id")
    rows = load(spark, sf_dir, "cameras").select(k, (k % 90).cast("double").alias("d"), (k % 60).cast("double").alias("m"), (k % 50 + 0.5).alias("s"), F.when(k % 2 == 0, "S").otherwise("N").alias("ref"))
    return rows.select("cam_id", F.round(photo.dms("d", "m", "s", "ref"), 9).alias("deg"))


_W = "2 * pi() * 6378137 / 16384"


@query(f"""WITH t AS (SELECT cam_id, cam_id % 16384 AS x, (cam_id * 7) % 16384 AS y FROM cameras), b AS (SELECT cam_id, -pi() * 6378137 + x * {_W} AS west, pi() * 6378137 - y * {_W} AS north FROM t)
SELECT cam_id, round(west, 3) AS west, round(north - {_W}, 3) AS south, round(degrees((west + {_W}) / 6378137), 9) AS east_lon, round(degrees(2 * atan(exp(north / 6378137)) - pi() / 2), 9) AS north_lat FROM b""")
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cameras").select("cam_id", (F.col("cam_id") % 16384).alias("x"), (F.col("cam_id") * 7 % 16384).alias("y"))
    box, deg = geo.tile_box("x", "y", F.lit(14)), geo.tile_lonlat("x", "y", F.lit(14))
    return rows.select("cam_id", F.round(box["west"], 3).alias("west"), F.round(box["south"], 3).alias("south"), F.round(deg["east"], 9).alias("east_lon"), F.round(deg["north"], 9).alias("north_lat"))


@query("""WITH a AS (SELECT cam_id, cos(radians(coalesce(yaw, 0)) / 2) AS w, sin(radians(coalesce(yaw, 0)) / 2) AS z, cam_id % 9 AS tx, cam_id % 7 AS ty, cam_id % 5 AS tz FROM cameras)
SELECT cam_id, round(-((1 - 2 * z * z) * tx + 2 * z * w * ty), 6) + 0.0 AS cx, round(-(-2 * z * w * tx + (1 - 2 * z * z) * ty), 6) + 0.0 AS cy, round(-tz, 6)::double + 0.0 AS cz FROM a""")
def camera_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, half = F.col("cam_id"), F.radians(F.coalesce("yaw", F.lit(0.0))) / 2
    rows = load(spark, sf_dir, "cameras").select(k, F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), *[(k % n).cast("double").alias(c) for c, n in (("tx", 9), ("ty", 7), ("tz", 5))])
    return rows.select("cam_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in zip(("cx", "cy", "cz"), geo.centre(geo.quaternion_rows()), strict=True)])


@query("""SELECT cam_id, round(cos(p), 9) + 0.0 AS r00, round(-sin(p), 9) + 0.0 AS r01, round(-cos(t) * sin(p), 9) + 0.0 AS r10, round(-sin(t), 9) + 0.0 AS r12, round(sin(t) * cos(p), 9) + 0.0 AS r21, round(-cos(t), 9) + 0.0 AS r22
FROM (SELECT cam_id, radians(coalesce(yaw, 0)) AS p, radians(coalesce(pitch, -90) + 90) AS t FROM cameras)""")
def gimbal_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geo.nadir_rows()
    return load(spark, sf_dir, "cameras").select("cam_id", *[(F.round(r[i][j], 9) + 0.0).alias(f"r{i}{j}") for i, j in ((0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2))])


@query("""SELECT cam_id, round(3700 * 1.0 + 2640 * 0.0, 3)::double AS p00, round(3700.0 * tx + 2640 * tz, 3)::double AS p03, round(-3700.0, 3)::double AS p11, round(3700.0 * ty + 1978 * tz, 3)::double AS p13, tz::double AS p23
FROM (SELECT cam_id, cam_id % 9 AS tx, cam_id % 7 AS ty, cam_id % 5 + 1 AS tz FROM cameras)""")
def projection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("cam_id")
    fixed = (("qw", 0.0), ("qx", 1.0), ("qy", 0.0), ("qz", 0.0), ("fx", 3700.0), ("fy", 3700.0), ("ppx", 2640.0), ("ppy", 1978.0))
    rows = load(spark, sf_dir, "cameras").select(k, *[F.lit(v).alias(c) for c, v in fixed], (k % 9).cast("double").alias("tx"), (k % 7).cast("double").alias("ty"), (k % 5 + 1).cast("double").alias("tz"))
    p = control.projection_columns()
    return rows.select("cam_id", *[F.round(p[c], 3).alias(c) for c in ("p00", "p03", "p11", "p13")], p["p23"].alias("p23"))


@query("""WITH p AS (SELECT pt_id, (pt_id % 640)::double AS u, ((pt_id * 7) % 480)::double AS v FROM points)
SELECT pt_id, round(least(greatest(least(u, 639 - u, v, 479 - v) / 28.8, 0.02), 1), 9)::double AS weight FROM p""")
def border_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "points").select("pt_id", (F.col("pt_id") % 640).cast("double").alias("u"), (F.col("pt_id") * 7 % 480).cast("double").alias("v"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return rows.select("pt_id", F.round(ortho.feather(), 9).alias("weight"))


@query("""WITH p AS (SELECT pt_id, (x - 100) / z AS xn, (y - 100) / z AS yn FROM points) SELECT pt_id, round(3700 * xn * (1 + 0.01 * (xn * xn + yn * yn)) + 2640, 4) AS u, round(3700 * yn * (1 + 0.01 * (xn * xn + yn * yn)) + 1978, 4) AS v FROM p""")
def radial_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geo.pinhole(F.col("x") - 100, F.col("y") - 100, F.col("z"), F.lit(3700.0), F.lit(3700.0), F.lit(2640.0), F.lit(1978.0), F.lit(0.01))
    return load(spark, sf_dir, "points").select("pt_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("SELECT count(*) AS points, round(count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6), 9) AS density FROM points")
def cloud_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(1e-6))
    return load(spark, sf_dir, "points").agg(F.count(F.lit(1)).alias("points"), F.round(F.count(F.lit(1)) / area, 9).alias("density"))


@query("""WITH e AS (SELECT min(est_x) AS x0, max(est_x) AS x1, min(est_y) AS y0, max(est_y) AS y1 FROM cameras), s AS (SELECT *, greatest(x1 - x0, y1 - y0, 1e-6) AS span FROM e)
SELECT cam_id, round(20 + (est_x - x0) / span * 360, 4) AS u, round(20 + (y1 - est_y) / span * 360, 4) AS v FROM cameras, s WHERE est_x IS NOT NULL""")
def camera_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.camera_map(load(spark, sf_dir, "cameras")).select("cam_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id * 1000 END::bigint AS faces FROM pages")
def ply_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("element face "), (F.col("page_id") * 1000).cast("string"), F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex 9\n"), face, F.lit("end_header\nelement face 7\n"), F.col("html")).cast("binary")
    return binary.ply_faces(load(spark, sf_dir, "pages").select("page_id", content.alias("content"))).select("page_id", "faces")


@query("SELECT gcp_id, CASE WHEN gcp_id % 3 = 0 THEN x ELSE gcp_id + 0.5 END::double AS x FROM gcps")
def cell_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.when(F.col("gcp_id") % 3 == 0, "not a number").otherwise(F.concat(F.col("gcp_id").cast("string"), F.lit(".5")))
    return load(spark, sf_dir, "gcps").select("gcp_id", F.coalesce(typed.try_cast("double"), F.col("x")).alias("x"))  # what does not parse changes nothing


@query("SELECT cam_id, CASE WHEN lat IS NULL THEN est_x ELSE round(radians(lon) * 6378137, 3) END AS est_x, CASE WHEN lat IS NULL THEN est_z ELSE alt END AS est_z FROM cameras")
def reproject_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = control.project_position(load(spark, sf_dir, "cameras"), 3857)
    return out.select("cam_id", F.when(F.col("lat").isNull(), F.col("est_x")).otherwise(F.round("est_x", 3)).alias("est_x"), "est_z")


@query(f"""WITH {_EXIF_SQL.split('WITH ', 1)[1].replace('SELECT gcp_id, cam_id, round(px, 3) AS px, round(py, 3) AS py FROM k', ', new AS (SELECT gcp_id, cam_id, px, py FROM k', 1)})
SELECT gcp_id, cam_id, round(px, 3) AS px, round(py, 3) AS py FROM (SELECT gcp_id, cam_id, px, py FROM observations UNION ALL SELECT * FROM new)""")
def auto_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gcps = load(spark, sf_dir, "gcps").where("not (x = 0 and y = 0 and z = 0)").withColumn("x", 88.4 + F.col("x") / 20).withColumn("y", 22.5 + F.col("y") / 20)
    marks, _ = control.auto_mark(gcps, load(spark, sf_dir, "cameras"), load(spark, sf_dir, "observations"))
    return marks.select("gcp_id", "cam_id", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


@query("""SELECT gcp_id, label, x, enabled FROM gcps UNION ALL SELECT 999 + row_number() OVER (ORDER BY r_name), r_name, 0.0::double, true FROM region""")
def added_gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = load(spark, sf_dir, "region").select(F.col("r_name").alias("label"))
    return control.append_gcps(load(spark, sf_dir, "gcps"), added, 1000).select("gcp_id", "label", "x", "enabled")


@query("""WITH p AS (SELECT cls, CASE WHEN z > 30 THEN 6 WHEN z > 20 THEN 5 ELSE 2 END AS g FROM points), t AS (SELECT cls, count(*) AS support, count(*) FILTER (WHERE cls = g) AS hits FROM p GROUP BY 1),
q AS (SELECT g AS cls, count(*) AS guesses FROM p GROUP BY 1), r AS (SELECT cls, coalesce(support, 0) AS support, coalesce(hits, 0)::double AS hits, coalesce(guesses, 0) AS guesses FROM t FULL JOIN q USING (cls)),
s AS (SELECT cls, support, CASE WHEN guesses > 0 THEN hits / guesses ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM r)
SELECT cls, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, support::bigint AS support FROM s""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("z") > 30, 6).when(F.col("z") > 20, 5).otherwise(2).alias("predicted")
    confusion = load(spark, sf_dir, "points").groupBy("cls", guess).agg(F.count(F.lit(1)).alias("n"))
    return ml.class_report(confusion).select("cls", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query()
def contour_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir, 8.0)
    return text_models.geojson(terrain.contours(surface, meta, 5.0))


@query()
def contour_dxf(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface, meta = _surface(spark, sf_dir, 8.0)
    return text_models.dxf(terrain.contours(surface, meta, 5.0))


# Heights are held to 2^-20 m, and written with a half rounded up, as here; a decimal cast does the same.
_MESH_SQL = f"""WITH m AS (SELECT min(x) AS minx, min(y) AS miny FROM points),
c AS (SELECT floor((y - miny) / 5::double)::bigint AS row, floor((x - minx) / 5::double)::bigint AS col, {_near_sql('avg(z)')} AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM points, m GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (ORDER BY row, col) - 1 AS vid FROM c),
f AS (SELECT unnest([{{'a': a.vid, 'b': b.vid, 'c': c.vid}}, {{'a': b.vid, 'b': d.vid, 'c': c.vid}}]) AS f
  FROM v a JOIN v b ON b.row = a.row AND b.col = a.col + 1 JOIN v c ON c.row = a.row + 1 AND c.col = a.col JOIN v d ON d.row = a.row + 1 AND d.col = a.col + 1)
SELECT 0 AS part, vid AS pos, format('v {{:.4f}} {{:.4f}} {{}} {{:.4f}} {{:.4f}} {{:.4f}}', minx + (col + 0.5) * 5, miny + (row + 0.5) * 5, z::varchar::decimal(38, 20)::decimal(20, 4)::varchar,
  floor(r) / 255.0::double, floor(g) / 255.0::double, floor(b) / 255.0::double) AS value FROM v, m
UNION ALL SELECT 1, f.a, format('f {{}} {{}} {{}}', f.a + 1, f.b + 1, f.c + 1) FROM f"""


@query(_MESH_SQL)
def mesh_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    verts, faces = terrain.heightfield(load(spark, sf_dir, "points"), 5.0)
    return text_models.mesh_lines(verts.withColumn("z", _near("z")), faces)
