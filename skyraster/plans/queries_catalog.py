"""Queries over photo, control-point and text catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyraster.functions import geo, photo
from skyraster.operators import control, tiles
from skyraster.plans.adapters import load
from skyraster.plans.catalog import query
from skyraster.schema import SENSORS
from skyraster.sources import text_models

_SENSOR = "CASE " + " ".join(f"WHEN contains(lower(concat(make, ' ', model)), '{k}') THEN {w}::double" for k, w in SENSORS) + " END"
_FOCAL = f"coalesce(nullif(width::double, 0) * nullif(focal_mm, 0) / ({_SENSOR}), nullif(width::double, 0) * nullif(focal35_mm, 0) / 36.0::double)"


@query("SELECT list_sort(list(DISTINCT trim(concat(make, ' ', model))) FILTER (WHERE model <> ''))::varchar AS models FROM cameras")
def camera_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set(F.when(F.col("model") != "", photo.camera_name())))  # distinct camera models: a few
    return load(spark, sf_dir, "cameras").agg(F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: n), ", "), F.lit("]")).alias("models"))


@query("""SELECT count(*) AS photos, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS geotagged,
  (SELECT count(*) FROM observations) AS marks, (SELECT count(DISTINCT gcp_id) FROM observations) AS marked_points FROM cameras""")
def geotag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = load(spark, sf_dir, "observations").agg(F.count(F.lit(1)).alias("marks"), F.count_distinct("gcp_id").alias("marked_points"))
    cams = load(spark, sf_dir, "cameras").agg(F.count(F.lit(1)).alias("photos"), F.count_if("enabled").alias("enabled"), F.count_if(photo.has_geotag()).alias("geotagged"))
    return cams.crossJoin(F.broadcast(marks))  # one row each


@query("""SELECT stage, round(sum(seconds), 4) AS seconds, CASE WHEN s < 60 THEN format('{:d} s', s) WHEN s < 3600 THEN format('{:d} min {:02d} s', s // 60, s % 60)
  ELSE format('{:d} h {:02d} min', s // 3600, (s // 60) % 60) END AS took FROM (SELECT stage, seconds, round_even(round(sum(seconds) OVER (PARTITION BY stage), 4), 0)::bigint AS s FROM stage_log) GROUP BY stage, s""")
def stage_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "stage_log").groupBy("stage").agg(F.round(F.sum("seconds"), 4).alias("seconds"))
    return rows.withColumn("took", photo.duration("seconds"))


@query(f"SELECT cam_id, {_SENSOR} AS sensor_mm, {_FOCAL} AS focal_px FROM cameras")
def sensor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cameras").select("cam_id", photo.sensor_width().alias("sensor_mm"), photo.focal_px().alias("focal_px"))


@query("SELECT cam_id, CASE WHEN est_z - 30 > 2 THEN est_z - 30 WHEN rel_alt > 2 THEN rel_alt END AS agl FROM cameras")
def height_agl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cameras").select("cam_id", photo.height_agl(F.lit(30.0)).alias("agl"))


@query(f"SELECT round(median(CASE WHEN est_z - 30 > 2 THEN est_z - 30 WHEN rel_alt > 2 THEN rel_alt END / ({_FOCAL})), 9) AS gsd FROM cameras WHERE enabled")
def gsd_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.median_gsd(load(spark, sf_dir, "cameras"), 30.0).select(F.round("gsd", 9).alias("gsd"))


@query("SELECT gcp_id, error, CASE WHEN error IS NULL THEN '' WHEN error < 0.05 THEN 'good' WHEN error < 0.2 THEN 'warn' ELSE 'bad' END AS grade FROM gcps")
def error_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "gcps").select("gcp_id", "error", photo.grade().alias("grade"))


def _ranked(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.select("cam_id").withColumn("pos", F.monotonically_increasing_id()).select("cam_id", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("pos"))


@query("SELECT cam_id, row_number() OVER (ORDER BY lower(regexp_extract(path, '[^/]*$')), cam_id) - 1 AS pos FROM cameras")
def photo_sort_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, control.sort_photos(load(spark, sf_dir, "cameras")))


@query("SELECT cam_id, row_number() OVER (ORDER BY coalesce(datetime, ''), lower(regexp_extract(path, '[^/]*$')), cam_id) - 1 AS pos FROM cameras")
def photo_sort_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, control.sort_photos(load(spark, sf_dir, "cameras"), "time"))


@query("SELECT cam_id, row_number() OVER (ORDER BY (est_x - 100) * (est_x - 100) + (est_y - 90) * (est_y - 90) ASC NULLS LAST, cam_id) - 1 AS pos FROM cameras")
def photo_sort_gcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, control.sort_photos(load(spark, sf_dir, "cameras"), "gcp", (100.0, 90.0)))


@query("""WITH gone AS (SELECT cam_id FROM cameras WHERE NOT enabled) SELECT 'camera' AS kind, cam_id, (-1)::bigint AS gcp_id FROM cameras WHERE cam_id NOT IN (SELECT cam_id FROM gone)
UNION ALL SELECT 'mark', cam_id, gcp_id FROM observations WHERE cam_id NOT IN (SELECT cam_id FROM gone)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = load(spark, sf_dir, "cameras")
    left, marks = control.remove_cameras(cams, load(spark, sf_dir, "observations"), cams.where("not enabled").select("cam_id"))
    return left.select(F.lit("camera").alias("kind"), "cam_id", F.lit(-1).cast("long").alias("gcp_id")).unionByName(marks.select(F.lit("mark").alias("kind"), "cam_id", "gcp_id"))


@query("""SELECT gcp_id, cam_id, px, py FROM observations WHERE cam_id % 5 <> 0 AND cam_id % 7 <> 1 UNION ALL
SELECT gcp_id, cam_id, px + 1 AS px, py FROM observations WHERE cam_id % 5 = 0 UNION ALL SELECT gcp_id, cam_id + 1000000, px, py FROM observations WHERE cam_id % 5 = 0""")
def upsert_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = load(spark, sf_dir, "observations")
    moved = marks.where("cam_id % 5 = 0").withColumn("px", F.col("px") + 1)
    new = marks.where("cam_id % 5 = 0").withColumn("cam_id", F.col("cam_id") + 1_000_000)
    gone = marks.where("cam_id % 7 = 1 and cam_id % 5 <> 0").withColumn("px", F.lit(None).cast("double"))
    return control.upsert_marks(marks, moved.unionByName(new).unionByName(gone))


@query("SELECT gcp_id, cam_id, least(greatest(px, 0), 5280)::double AS px, least(greatest(py, 0), 3956)::double AS py FROM observations")
def clamp_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.clamp_marks(load(spark, sf_dir, "observations"), load(spark, sf_dir, "cameras"))


@query("""WITH named AS (SELECT regexp_extract(path, '[^/]*$') AS name, max(cam_id) AS cam_id FROM cameras GROUP BY 1) SELECT name, cam_id FROM named""")
def last_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.by_file_name(load(spark, sf_dir, "cameras")).select("name", "cam_id")


@query("SELECT o.gcp_id, o.cam_id FROM observations o JOIN cameras c USING (cam_id) WHERE c.est_x IS NOT NULL QUALIFY count(*) OVER (PARTITION BY o.gcp_id) >= 2")
def control_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = load(spark, sf_dir, "cameras").where("est_x is not null").select("cam_id")
    return control.rays(load(spark, sf_dir, "observations"), views).select("gcp_id", "cam_id")


@query("""SELECT o.gcp_id, o.cam_id FROM observations o WHERE EXISTS (SELECT 1 FROM cameras c WHERE c.cam_id = o.cam_id AND c.enabled) AND EXISTS (SELECT 1 FROM gcps g WHERE g.gcp_id = o.gcp_id AND g.enabled)""")
def usable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = load(spark, sf_dir, "observations").withColumnsRenamed({"cam_id": "name", "gcp_id": "pid"})
    cams = load(spark, sf_dir, "cameras").where("enabled").select(F.col("cam_id").alias("name"))
    points = load(spark, sf_dir, "gcps").where("enabled").select(F.col("gcp_id").alias("pid"))
    return control.usable_tracks(tracks, cams, points).select(F.col("pid").alias("gcp_id"), F.col("name").alias("cam_id"))


@query("SELECT arg_min(lon, cam_id) AS lon, arg_min(lat, cam_id) AS lat, arg_min(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon + 180) / 6) + 1, 1), 60), cam_id)::int AS epsg FROM cameras WHERE lat IS NOT NULL")
def first_geotag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.first_geotag(load(spark, sf_dir, "cameras")).select("lon", "lat", F.col("epsg").cast("int").alias("epsg"))


@query(f"""WITH h AS (SELECT g.gcp_id, c.cam_id, c.est_x - g.x AS dx, c.est_y - g.y AS dy FROM gcps g CROSS JOIN cameras c WHERE g.enabled AND NOT (g.x = 0 AND g.y = 0 AND g.z = 0) AND c.est_x IS NOT NULL),
k AS (SELECT gcp_id, cam_id, row_number() OVER (PARTITION BY gcp_id ORDER BY dx * dx + dy * dy, cam_id) AS r FROM h WHERE abs(dx) <= 60 AND abs(dy) <= 45)
SELECT gcp_id, cam_id FROM k WHERE r <= 8 AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.gcp_id = k.gcp_id AND o.cam_id = k.cam_id)""")
def marks_topk_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = load(spark, sf_dir, "cameras").where("est_x is not null").select("cam_id", "est_x", "est_y")
    both = cams.crossJoin(control.small(control.markable(load(spark, sf_dir, "gcps"))))  # every point against every view is the operator
    both = both.withColumn("px", F.col("est_x") - F.col("x")).withColumn("py", F.col("est_y") - F.col("y")).where((F.abs("px") <= 60) & (F.abs("py") <= 45))
    hits = both.withColumn("metric", F.col("px") * F.col("px") + F.col("py") * F.col("py"))
    return control._best(hits, load(spark, sf_dir, "observations"), 8).select("gcp_id", "cam_id")


_EXIF_SQL = f"""WITH c AS (SELECT *, {_FOCAL} AS f, est_x AS camx, est_y AS camy FROM cameras WHERE enabled AND lat IS NOT NULL AND lon IS NOT NULL),
b AS (SELECT g.gcp_id, c.*, g.x - lon AS dx, g.y - lat AS dy, g.z - CASE WHEN alt - g.z >= 5 THEN alt WHEN rel_alt > 5 THEN g.z + rel_alt END AS dz FROM c CROSS JOIN (SELECT gcp_id, 88.4 + x / 20 AS x, 22.5 + y / 20 AS y, z FROM gcps WHERE enabled AND NOT (x = 0 AND y = 0 AND z = 0)) g WHERE f > 0),
r AS (SELECT *, cos(radians(coalesce(yaw, 0))) AS cy, sin(radians(coalesce(yaw, 0))) AS sy, cos(radians(pitch + 90)) AS ct, sin(radians(pitch + 90)) AS st FROM b WHERE dz IS NOT NULL),
p AS (SELECT *, cy * dx - sy * dy AS xc, -ct * sy * dx - ct * cy * dy - st * dz AS yc, st * sy * dx + st * cy * dy - ct * dz AS zc FROM r),
h AS (SELECT gcp_id, cam_id, dx * dx + dy * dy AS d, f * xc / zc + width / 2 AS px, f * yc / zc + height / 2 AS py, width, height FROM p WHERE zc > 1e-6),
k AS (SELECT *, row_number() OVER (PARTITION BY gcp_id ORDER BY d, cam_id) AS n FROM h WHERE px BETWEEN width * 0.05 AND width - width * 0.05 AND py BETWEEN height * 0.05 AND height - height * 0.05)
SELECT gcp_id, cam_id, round(px, 3) AS px, round(py, 3) AS py FROM k WHERE n <= 8 AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.gcp_id = k.gcp_id AND o.cam_id = k.cam_id)"""


@query(_EXIF_SQL)
def exif_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gcps = load(spark, sf_dir, "gcps").where("not (x = 0 and y = 0 and z = 0)").withColumn("x", 88.4 + F.col("x") / 20).withColumn("y", 22.5 + F.col("y") / 20)
    out = control.mark_geotagged(gcps, load(spark, sf_dir, "cameras"), load(spark, sf_dir, "observations"), None)
    return out.select("gcp_id", "cam_id", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


@query("""WITH m AS (SELECT gcp_id, cam_id, 3700 * (g.x - est_x) / (est_z - g.z) + 2640 AS u, 3700 * (est_y - g.y) / (est_z - g.z) + 1978 AS v, width AS w, height AS h FROM gcps g CROSS JOIN cameras c
  WHERE g.enabled AND NOT (g.x = 0 AND g.y = 0 AND g.z = 0) AND est_x IS NOT NULL AND est_z - g.z > 1e-6),
r AS (SELECT *, row_number() OVER (PARTITION BY gcp_id ORDER BY (u - w / 2.0::double) ** 2 + (v - h / 2.0::double) ** 2, cam_id) AS r FROM m
  WHERE u BETWEEN w * 0.02::double AND w - w * 0.02::double AND v BETWEEN h * 0.02::double AND h - h * 0.02::double)
SELECT gcp_id, cam_id, round(u, 6) AS px, round(v, 6) AS py FROM r WHERE r <= 8 AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.gcp_id = r.gcp_id AND o.cam_id = r.cam_id)""")
def solved_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = load(spark, sf_dir, "cameras").where("est_x is not null").select("cam_id", "width", "height", *[F.lit(v).alias(c) for c, v in (("qw", 0.0), ("qx", 1.0), ("qy", 0.0), ("qz", 0.0), ("fx", 3700.0), ("fy", 3700.0), ("ppx", 2640.0), ("ppy", 1978.0))],
                                                                            (-F.col("est_x")).alias("tx"), F.col("est_y").alias("ty"), F.col("est_z").alias("tz"))
    marks = control.mark_solved(load(spark, sf_dir, "gcps"), views, load(spark, sf_dir, "observations"), control.similarity_from([1, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]))
    return marks.select("gcp_id", "cam_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


# --- coordinates ------------------------------------------------------------------------------


@query(f"""SELECT cam_id, round(radians(lon) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(least(greatest(lat, -85.05112878), 85.05112878)) / 2)) * 6378137, 3) AS my,
  least(greatest(floor((radians(lon) * 6378137 + pi() * 6378137) / (2 * pi() * 6378137 / 131072)), 0), 131071)::bigint AS tx FROM cameras WHERE lat IS NOT NULL""")
def mercator_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cameras").where("lat is not null").withColumn("mx", geo.mercator_x("lon")).withColumn("my", geo.mercator_y("lat"))
    return rows.select("cam_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), geo.tile_x("mx", F.lit(17)).alias("tx"))


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_RADIUS = 6378137 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * _N**0.5 / (1 + _N)


@query(f"""WITH a AS (SELECT cam_id, radians(lat) AS p, radians(lon - 87) AS l FROM cameras WHERE lat IS NOT NULL), b AS (SELECT *, sinh(atanh(sin(p)) - {_ECC!r}::double * atanh({_ECC!r}::double * sin(p))) AS t FROM a),
c AS (SELECT cam_id, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM b)
SELECT cam_id, round(500000 + 0.9996 * {_RADIUS!r}::double * (eta + {' + '.join(f'{a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, a in enumerate(_ALPHA, 1))}), 3) AS east,
  round(0.9996 * {_RADIUS!r}::double * (xi + {' + '.join(f'{a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, a in enumerate(_ALPHA, 1))}), 3) AS north FROM c""")
def utm_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.utm_forward("lon", "lat", 45)
    return load(spark, sf_dir, "cameras").where("lat is not null").select("cam_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


_SIZE = 2 * geo.ORIGIN / (1 << 20)


@query(f"""WITH b AS (SELECT min(radians(lon)) * {geo.EARTH}::double AS west, max(radians(lon)) * {geo.EARTH}::double AS east, min(ln(tan(pi() / 4 + radians(lat) / 2))) * {geo.EARTH}::double AS south,
  max(ln(tan(pi() / 4 + radians(lat) / 2))) * {geo.EARTH}::double AS north FROM cameras WHERE lat IS NOT NULL),
x AS (SELECT unnest(range(floor((west + {geo.ORIGIN!r}::double) / {_SIZE!r}::double)::bigint, floor((east + {geo.ORIGIN!r}::double) / {_SIZE!r}::double)::bigint + 1)) AS tx FROM b),
y AS (SELECT unnest(range(floor(({geo.ORIGIN!r}::double - north) / {_SIZE!r}::double)::bigint, floor(({geo.ORIGIN!r}::double - south) / {_SIZE!r}::double)::bigint + 1)) AS ty FROM b)
SELECT tx, ty FROM x CROSS JOIN y ORDER BY ty, tx LIMIT 500""")
def tiles_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tiles, row by row, of the rectangle that the geotags span: the cap is the feature."""
    tagged = load(spark, sf_dir, "cameras").where("lat is not null").select(geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y"))
    e = tagged.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north")).first()
    return tiles.tiles_in_bounds(spark, e.west, e.south, e.east, e.north, 20, 500)


_TILES = """tiles AS (SELECT DISTINCT z, floor((lon + 180) / 360 * (1 << z))::bigint AS x, floor((0.5 - lat / 360) * (1 << z))::bigint AS y
  FROM cameras CROSS JOIN (SELECT unnest([14, 15, 16, 17]) AS z) WHERE lat IS NOT NULL)"""


def _camera_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pow(F.lit(2.0), F.col("z"))
    rows = load(spark, sf_dir, "cameras").where("lat is not null").withColumn("z", F.explode(F.array(*map(F.lit, (14, 15, 16, 17)))))
    return rows.select("z", F.floor((F.col("lon") + 180) / 360 * n).alias("x"), F.floor((0.5 - F.col("lat") / 360) * n).alias("y")).distinct()


@query(f"WITH {_TILES} SELECT a.z, a.x, a.y, b.x AS cx, b.y AS cy FROM tiles a JOIN tiles b ON b.z = a.z + 1 AND b.x // 2 = a.x AND b.y // 2 = a.y")
def tile_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.children(_camera_tiles(spark, sf_dir))


@query(f"WITH {_TILES} SELECT z, count(*) AS tiles FROM tiles GROUP BY z")
def tiles_per_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.per_zoom(_camera_tiles(spark, sf_dir))


@query()
def kml_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.kml(_camera_tiles(spark, sf_dir), 14, 17)


# --- text sources -----------------------------------------------------------------------------


@query("""WITH t AS (SELECT pos, string_split(value, ' ') AS t, lead(value) OVER (ORDER BY pos) AS pts FROM image_lines), p AS (SELECT regexp_extract(array_to_string(t[10:], ' '), '[^/]*$') AS name, t, pos FROM t WHERE len(t) >= 10)
SELECT name, t[2]::double AS qw, t[3]::double AS qx, t[4]::double AS qy, t[5]::double AS qz, t[6]::double AS tx, t[7]::double AS ty, t[8]::double AS tz, t[9]::bigint AS camera_id FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) = 1""")
def sfm_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses, _ = text_models.model_images(load(spark, sf_dir, "image_lines"))
    return poses.select("name", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id")


@query("""WITH t AS (SELECT pos, string_split(value, ' ') AS t FROM image_lines), p AS (SELECT pos, regexp_extract(array_to_string(t[10:], ' '), '[^/]*$') AS name FROM t WHERE len(t) >= 10),
m AS (SELECT p.name, t.t, unnest(range(0, len(t.t) // 3)) AS i FROM p JOIN t ON t.pos = p.pos + 1)
SELECT name, t[3 * i + 3]::bigint AS pid, t[3 * i + 1]::double AS u, t[3 * i + 2]::double AS v FROM m WHERE t[3 * i + 3]::bigint >= 0""")
def sfm_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_models.model_images(load(spark, sf_dir, "image_lines"))[1]


@query("""SELECT cam_id AS camera_id, 3000.5::double AS fx, CASE WHEN cam_id % 3 = 0 THEN 3001.5 ELSE 3000.5 END::double AS fy, CASE WHEN cam_id % 3 = 0 THEN 2640 ELSE 3001.5 END::double AS cx,
  CASE WHEN cam_id % 3 = 0 THEN cam_id % 100 ELSE 2640 END::double AS cy FROM cameras""")
def sfm_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("cam_id"), F.when(F.col("cam_id") % 3 == 0, "OPENCV").otherwise("SIMPLE_RADIAL"), F.lit("5280 3956 3000.5 3001.5 2640"), (F.col("cam_id") % 100).cast("string"))
    return text_models.model_cameras(load(spark, sf_dir, "cameras").select(line.alias("value")))


@query("SELECT pt_id AS pid, x, y, z, r, g, b, (pt_id % 9)::double AS err FROM points")
def sfm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "points")
    line = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("pt_id", "x", "y", "z", "r", "g", "b")], (F.col("pt_id") % 9).cast("string"), F.lit("1 2 3 4"))
    return text_models.model_points(p.select(line.alias("value")))


@query("SELECT gcp_id + 1 AS pos, label, x + 0.25 AS x, y, z, gcp_id % 4 IN (1, 2) AS is_check FROM gcps WHERE gcp_id % 8 <> 3")
def gcp_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_models.control_points(load(spark, sf_dir, "gcp_lines"))


@query("SELECT page_id, (page_id % 360)::double AS yaw, CASE WHEN page_id % 2 = 0 THEN -90.0 END::double AS pitch, (page_id % 50 + 0.5)::double AS rel_alt FROM pages")
def xmp_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    packet = F.concat(F.lit('\x01\x02 x <x:xmpmeta a="1" drone:GimbalYawDegree="+'), (n % 360).cast("string"), F.lit('.0" drone:RelativeAltitude="'), (n % 50).cast("string"), F.lit('.50"'),
                      F.when(n % 2 == 0, ' drone:GimbalPitchDegree="-90.00"').otherwise(""), F.lit("></x:xmpmeta>"), F.substring("html", 1, 200))
    files = load(spark, sf_dir, "pages").select("page_id", packet.cast("binary").alias("content"))
    return text_models.attitude(files).select("page_id", "yaw", "pitch", "rel_alt")


@query("SELECT vid, CASE WHEN vid % 2 = 0 THEN format('v {:.4f} {:.4f} {:.4f}', 0.0 - 2.0 * y, 2.0 * x - 100, 2.0 * z) ELSE 'f 1 2 3' END AS value FROM (SELECT pt_id AS vid, floor(x) / 4 AS x, floor(y) / 4 AS y, floor(z) / 4 AS z FROM points)")
def obj_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "points").select(F.col("pt_id").alias("vid"), *[(F.floor(c) / 4).alias(c) for c in "xyz"])
    line = F.when(F.col("vid") % 2 == 0, F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"])).otherwise("f 1 2 3")
    sim = control.similarity_from([2, 0, -1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0])
    return text_models.transform_obj(p.select("vid", line.alias("value")), sim, (0.0, 100.0, 0.0)).select("vid", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
