"""Text sources: sparse-model exports, control-point lists, photo metadata packets, OBJ and DXF."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyraster.functions import geo

TWO_FOCAL = ["PINHOLE", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "THIN_PRISM_FISHEYE"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value): whole files as numbered lines."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?|\n$", "\n"), "\n")).alias("pos", "value"))


def _tokens(c: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def model_images(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(poses, tracks) from an images list: a pose line, then its points line.

    Lines are numbered without comments; pairs form by number, each line read once.
    """
    numbered = lines.where("not startswith(value, '#')").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1)
    pairs = numbered.groupBy("path", F.floor(F.col("n") / 2).alias("k")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("value"))).alias("pose"), F.max(F.when(F.col("n") % 2 == 1, F.col("value"))).alias("points"))
    rows = pairs.withColumn("t", _tokens("pose")).where(F.size("t") >= 10)
    number = lambda i: F.col("t")[i].cast("double")
    whole = F.array_join(F.slice("t", 10, F.size("t")), " ")
    rows = rows.select("k", F.element_at(F.split(whole, r"[/\\]"), -1).alias("name"), *[number(i).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), 1)], F.col("t")[8].cast("long").alias("camera_id"), _tokens("points").alias("p"))
    # A later pose of the same name replaces the earlier one.
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("k"))))
    c = geo.centre(geo.quaternion_rows())
    poses = rows.where("r = 1").select("name", "qw", "qx", "qy", "qz", "tx", "ty", "tz", c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), "camera_id")
    i = F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1)).alias("i")
    marks = rows.where(F.size("p") >= 3).select("name", "p", i)
    at = lambda d: F.col("p")[F.col("i") * 3 + d].cast("double")
    tracks = marks.select("name", at(2).cast("long").alias("pid"), at(0).alias("u"), at(1).alias("v")).where("pid >= 0")
    return poses, tracks


def model_cameras(lines: DataFrame) -> DataFrame:
    """(camera_id, fx, fy, cx, cy) from a cameras list."""
    rows = lines.where("not startswith(value, '#')").withColumn("t", _tokens()).where(F.size("t") >= 5)
    p = lambda i: F.get("t", F.lit(4 + i)).cast("double")
    two = F.col("t")[1].isin(TWO_FOCAL) & (F.size("t") >= 8)
    pick = lambda a, b: F.when(two, p(a)).otherwise(F.coalesce(p(b), F.lit(0.0)))
    return rows.select(F.col("t")[0].cast("long").alias("camera_id"), pick(0, 0).alias("fx"), pick(1, 0).alias("fy"), pick(2, 1).alias("cx"), pick(3, 2).alias("cy"))


def model_points(lines: DataFrame) -> DataFrame:
    """(pid, x, y, z, r, g, b, err) from a points list."""
    rows = lines.where("not startswith(value, '#')").withColumn("t", _tokens()).where(F.size("t") >= 8)
    t = lambda i, kind: F.col("t")[i].cast(kind)
    return rows.select(t(0, "long").alias("pid"), *[t(i, "double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], *[t(i, "int").alias(c) for i, c in ((4, "r"), (5, "g"), (6, "b"))], t(7, "double").alias("err"))


def mean_error(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.avg("err"), F.lit(0.0)).alias("mean_reproj_px"))


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Whatever of images.txt, cameras.txt and points3D.txt a folder has."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(hadoop(f"{folder}/{name}"))
    out: dict[str, DataFrame] = {}
    if has("images.txt"):
        out["poses"], out["tracks"] = model_images(read_lines(spark, f"{folder}/images.txt"))
    if has("cameras.txt"):
        out["intrinsics"] = model_cameras(read_lines(spark, f"{folder}/cameras.txt"))
    if has("points3D.txt"):
        out["points"] = model_points(read_lines(spark, f"{folder}/points3D.txt"))
    return out


def largest_model(files: DataFrame) -> DataFrame:
    """(folder, size) of the folder with the largest file; of equals, the first by name.

    ``files`` has path and length, as ``binaryFile`` gives them.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    sizes = files.groupBy(folder.alias("folder")).agg(F.max("length").alias("size"))
    return sizes.orderBy(F.desc("size"), "folder").limit(1)


def control_points(lines: DataFrame, has_header: bool = True, literal_types: bool = False) -> DataFrame:
    """(pos, label, x, y, z, is_check) from a control-point list.

    The delimiter is the commonest of comma, semicolon, tab and space in the text; empty fields
    go, short and non-numeric rows too. A type ``check...``, ``chk...`` or ``c`` is a check point; with
    ``literal_types`` any type starting with c is.
    """
    rows = lines.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    seen = rows.agg(*[F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit(d)))).alias(n) for d, n in ((",", "comma"), (";", "semicolon"), ("\t", "tab"), (" ", "space"))])
    best = F.when(F.greatest("comma", "semicolon", "tab") == 0, " ").when((F.col("comma") >= F.col("semicolon")) & (F.col("comma") >= F.col("tab")), ",").when(F.col("semicolon") >= F.col("tab"), ";").otherwise("\t")
    rows = rows.crossJoin(F.broadcast(seen.select(best.alias("d"))))  # one row
    if has_header:
        rows = rows.join(rows.agg(F.min("pos").alias("pos")), "pos", "left_anti")
    fields = F.filter(F.transform(F.split(F.replace(F.col("value"), F.col("d"), F.lit("\x01")), "\x01"), lambda x: F.trim(F.replace(x, F.lit('"')))), lambda x: x != "")
    rows = rows.withColumn("f", fields).where(F.size("f") >= 4)
    kind = F.lower(F.coalesce(F.get("f", F.lit(4)), F.lit("")))
    check = kind.startswith("c") if literal_types else kind.startswith("check") | kind.startswith("chk") | (kind == "c")
    out = rows.select("pos", F.col("f")[0].alias("label"), *[F.col("f")[i].try_cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], check.alias("is_check"))
    return out.where("x is not null and y is not null and z is not null")


# Attribute names of the attitude packet.
XMP = {"yaw": "GimbalYawDegree", "pitch": "GimbalPitchDegree", "roll": "GimbalRollDegree", "rel_alt": "RelativeAltitude"}


def attitude(files: DataFrame) -> DataFrame:
    """files (content) with yaw, pitch, roll, rel_alt from the packet in the first 128 KiB."""
    head = F.decode(F.substring("content", 1, 131072), "ISO-8859-1")
    packet = F.regexp_extract(head, r"(?s)<x:xmpmeta.*?</x:xmpmeta>", 0)
    return files.withColumns({c: F.regexp_extract(packet, rf'{key}\s*=\s*"([+-]?[0-9.]+)"', 1).try_cast("double") for c, key in XMP.items()})


# --- OBJ, DXF, GeoJSON lines ------------------------------------------------------------------


def first_vertex(lines: DataFrame) -> DataFrame:
    rows = lines.where("startswith(value, 'v ')").orderBy("path", "pos").limit(1).withColumn("t", _tokens())
    return rows.select(*[F.col("t")[i].cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])


def transform_obj(lines: DataFrame, sim=None, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """OBJ lines with vertices moved by a similarity and an offset, and normals turned."""
    t = _tokens()
    xyz = [F.get("_t", F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    moved = list(sim.columns(*xyz)) if sim is not None else xyz
    moved = [m - o for m, o in zip(moved, offset, strict=True)]
    rest = F.when(F.size("_t") > 4, F.concat(F.lit(" "), F.array_join(F.slice("_t", 5, F.greatest(F.size("_t") - 4, F.lit(1))), " "))).otherwise("")
    vertex = F.concat(F.format_string("v %.4f %.4f %.4f", *moved), rest)
    out = F.when(F.startswith("value", F.lit("v ")), vertex)
    if sim is not None:
        n = [r[0] * xyz[0] + r[1] * xyz[1] + r[2] * xyz[2] for r in sim.R.tolist()]
        size = F.greatest(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]), F.lit(1e-12))
        out = out.when(F.startswith("value", F.lit("vn ")), F.format_string("vn %.4f %.4f %.4f", *[c / size for c in n]))
    return lines.withColumn("_t", t).withColumn("value", out.otherwise(F.col("value"))).drop("_t")


def obj_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.startswith("value", F.lit("v "))).alias("vertices"), F.count_if(F.startswith("value", F.lit("f "))).alias("faces"))


def mesh_lines(verts: DataFrame, faces: DataFrame, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(part, pos, value): OBJ lines with colours, vertices before faces."""
    v = verts.select(F.lit(0).alias("part"), F.col("vid").alias("pos"), F.format_string(
        "v %.4f %.4f %.4f %.4f %.4f %.4f", *[F.col(c) - o for c, o in zip("xyz", offset, strict=True)], *[F.col(c) / 255.0 for c in "rgb"]).alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("a").alias("pos"), F.format_string("f %d %d %d", *[F.col(c) + 1 for c in "abc"]).alias("value"))
    return v.unionByName(f)


def geojson(contours: DataFrame) -> DataFrame:
    """(level, line_id, value): the feature of each contour line."""
    points = F.transform("coords", lambda p: F.array(F.round(p["x"], 3), F.round(p["y"], 3)))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.round("level", 3).alias("elevation"), F.col("is_index").cast("int").alias("index")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry")))
    return contours.select("level", "line_id", feature.alias("value"))


def geojson_pieces(contours: DataFrame, epsg: int | None = None) -> Iterator[bytes]:
    """A FeatureCollection of contour lines in order of level and line, feature by feature."""
    yield b'{"type":"FeatureCollection","features":['
    for k, r in enumerate(geojson(contours).orderBy("level", "line_id").toLocalIterator()):
        yield ("," * (k > 0) + r.value).encode()
    crs = "" if not epsg else ',"crs":' + json.dumps({"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{epsg}"}})
    yield f"]{crs}}}".encode()


def dxf(contours: DataFrame) -> DataFrame:
    """(level, line_id, value): the entity text of each contour line, R12 polylines."""
    layer = F.when(F.col("is_index"), "CONTOUR_MAJOR").otherwise("CONTOUR_MINOR")
    vertex = F.transform("coords", lambda p: F.concat_ws("\n", F.lit("0\nVERTEX\n8"), layer, F.format_string("10\n%.3f\n20\n%.3f\n30\n%.3f\n70\n32", p["x"], p["y"], F.col("level"))))
    text = F.concat_ws("\n", F.lit("0\nPOLYLINE\n8"), layer, F.lit("66\n1\n70\n8"), vertex, F.lit("0\nSEQEND"))
    return contours.select("level", "line_id", text.alias("value"))


def dxf_pieces(contours: DataFrame) -> Iterator[bytes]:
    """A whole drawing: header, two layers, and the lines one after the other."""
    layers = "".join(f"0\nLAYER\n2\n{name}\n70\n0\n62\n{color}\n6\nCONTINUOUS\n" for name, color in (("CONTOUR_MINOR", 8), ("CONTOUR_MAJOR", 1)))
    head = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1009\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n70\n2\n" + layers + "0\nENDTAB\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"
    yield head.encode("ascii")
    for r in dxf(contours).orderBy("level", "line_id").toLocalIterator():
        yield (r.value + "\n").encode("ascii")
    yield b"0\nENDSEC\n0\nEOF\n"
