"""Column builders for photo metadata, classes, names and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyraster.schema import SENSORS


def file_name(path: str = "path") -> Column:
    return F.element_at(F.split(F.col(path), r"[/\\]"), -1)


def has_geotag() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def sensor_width(make: str = "make", model: str = "model") -> Column:
    """Width of the first listed sensor whose key is part of the camera's name."""
    name = F.lower(F.concat(F.coalesce(F.col(make), F.lit("")), F.lit(" "), F.coalesce(F.col(model), F.lit(""))))
    out = F.lit(None).cast("double")
    for key, width in reversed(SENSORS):
        out = F.when(name.contains(key), F.lit(width)).otherwise(out)
    return out


def focal_px() -> Column:
    """Focal length in pixels; zero counts as missing."""
    width = F.nullif(F.col("width").cast("double"), F.lit(0.0))
    by_sensor = width * F.nullif(F.col("focal_mm"), F.lit(0.0)) / sensor_width()
    return F.coalesce(by_sensor, width * F.nullif(F.col("focal35_mm"), F.lit(0.0)) / 36.0)


def height_agl(ground: Column | None = None) -> Column:
    """Height above ground: solved height over known ground if above 2 m, else relative altitude."""
    own = F.when(F.col("est_z") - ground > 2, F.col("est_z") - ground) if ground is not None else F.lit(None).cast("double")
    return F.coalesce(own, F.when(F.col("rel_alt") > 2, F.col("rel_alt")))


def median_gsd(cameras: DataFrame, ground: float | None = None, solved: DataFrame | None = None) -> DataFrame:
    """One row: gsd, the median of height / focal over enabled photos.

    ``solved`` (cam_id, f_px) goes before the focal length from metadata.
    """
    rows = cameras.where("enabled")
    focal = focal_px()
    if solved is not None:
        rows = rows.join(solved.select("cam_id", F.col("f_px").alias("_f")), "cam_id", "left")
        focal = F.coalesce(F.nullif(F.col("_f"), F.lit(0.0)), focal)
    height = height_agl(None if ground is None else F.lit(float(ground)))
    return rows.select((height / focal).alias("g")).agg(F.median("g").alias("gsd"))


def band(height: str = "hag", vegetation: str = "veg") -> Column:
    """Class of a non-ground point by height and roughness or colour."""
    h, v = F.col(height), F.col(vegetation)
    return F.when(v & (h <= 2), 3).when(v & (h <= 5), 4).when(v, 5).when(h > 2.5, 6).otherwise(1)


def green(r: str = "r", g: str = "g", b: str = "b") -> Column:
    r, g, b = (F.col(c).cast("int") for c in (r, g, b))
    return (g > r + 10) & (g > b + 10)


def grade(error: str = "error") -> Column:
    e = F.col(error)
    return F.when(e.isNull(), "").when(e < 0.05, "good").when(e < 0.2, "warn").otherwise("bad")


def duration(seconds: str | Column) -> Column:
    """'42 s', '2 min 05 s', '1 h 02 min'."""
    s = F.rint(F.col(seconds) if isinstance(seconds, str) else seconds).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(s < 60, F.format_string("%d s", s))
        .when(s < 3600, F.format_string("%d min %02d s", minutes, s % 60))
        .otherwise(F.format_string("%d h %02d min", F.floor(s / 3600).cast("long"), minutes % 60))
    )


def camera_name() -> Column:
    return F.trim(F.concat(F.coalesce(F.col("make"), F.lit("")), F.lit(" "), F.coalesce(F.col("model"), F.lit(""))))


def exif_time(text: str = "datetime") -> Column:
    return F.try_to_timestamp(F.col(text), F.lit("yyyy:MM:dd HH:mm:ss"))


def dms(degrees: str, minutes: str, seconds: str, ref: str) -> Column:
    """Signed degrees; south and west are negative."""
    value = F.col(degrees) + F.col(minutes) / 60.0 + F.col(seconds) / 3600.0
    return F.when(F.upper(F.col(ref)).isin("S", "W"), -value).otherwise(value)
