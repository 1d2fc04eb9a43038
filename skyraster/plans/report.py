"""Quality report of a survey as one HTML page, from small aggregates."""

from __future__ import annotations

import base64
from datetime import datetime
from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.functions import photo
from skyraster.operators import cloud, grid, tiles
from skyraster.sources.project import Survey


def hms(seconds: float) -> str:
    s = round(seconds)
    return f"{s} s" if s < 60 else f"{s // 60} min {s % 60:02d} s" if s < 3600 else f"{s // 3600} h {s // 60 % 60:02d} min"


def number(value, places: int = 3, unit: str = "") -> str:
    return "–" if value is None else f"{value:,.{places}f}{unit}"


def thumbnail(cells: DataFrame, nx: int, ny: int, most: int = 512) -> str:
    """A false-colour preview as a data URI."""
    step = max(1, -(-max(nx, ny) // most))
    image = np.zeros((-(-ny // step), -(-nx // step), 4), np.uint8)
    for r in grid.stretch(grid.decimate(cells, step)).toLocalIterator():
        image[r.row, r.col] = (r.r, r.g, r.b, 255)
    return "data:image/png;base64," + base64.b64encode(tiles.png(image)).decode()


def camera_map(cameras: DataFrame, size: int = 400, pad: int = 20) -> DataFrame:
    """cam_id, u, v: positions on a square sketch, north up."""
    e = cameras.agg(F.min("est_x").alias("x0"), F.max("est_x").alias("x1"), F.min("est_y").alias("y0"), F.max("est_y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    rows = cameras.where("est_x is not null").crossJoin(F.broadcast(e))  # one row
    inner = float(size - 2 * pad)
    return rows.select("cam_id", (pad + (F.col("est_x") - F.col("x0")) / span * inner).alias("u"), (pad + (F.col("y1") - F.col("est_y")) / span * inner).alias("v"))


def generate(survey: Survey, cameras: DataFrame, gcps: DataFrame, points: DataFrame | None = None, previews: dict[str, str] | None = None, now: datetime | None = None) -> str:
    c = cameras.agg(F.count(F.lit(1)).alias("n"), F.count_if(photo.has_geotag()).alias("tagged"), F.array_sort(F.collect_set(F.when(F.col("model") != "", photo.camera_name()))).alias("models")).first()
    stats = survey.stats
    method = stats.get("georef_method")
    rmse = stats.get("control_rmse_m") if method == "gcp" else stats.get("georef_rmse_m")
    rows = [("Photos", f"{c.n} ({c.tagged} geotagged)"), ("Cameras", ", ".join(c.models) or "–"), ("Aligned", number(stats.get("cameras_aligned"), 0)),
            ("Reprojection error", number(stats.get("mean_reproj_px"), 2, " px")), ("Georeferencing", f"{method or '–'}, RMSE {number(rmse, 3, ' m')}"),
            ("Check points RMSE", number(stats.get("check_rmse_m"), 3, " m")), ("Dense cloud", f"{number(stats.get('dense_points'), 0)} points"), ("Image GSD", number(stats.get("image_gsd_m"), 4, " m"))]
    parts = [f"<h1>{escape(survey.name)}</h1>", "<table>" + "".join(f"<tr><th>{escape(k)}</th><td>{escape(str(v))}</td></tr>" for k, v in rows) + "</table>"]
    points_table = gcps.select("label", "is_check", "error", photo.grade().alias("grade")).orderBy("gcp_id").collect()  # a survey's control points
    if points_table:
        parts.append("<h2>Control points</h2><table>" + "".join(
            f"<tr class='{r.grade}'><td>{escape(r.label or '')}</td><td>{'check' if r.is_check else 'control'}</td><td>{number(r.error, 3, ' m')}</td></tr>" for r in points_table) + "</table>")
    if points is not None:
        bars = cloud.histogram(points).orderBy("cls").collect()  # ten classes
        parts.append("<h2>Classes</h2>" + "".join(f"<div><span style='background:rgb({r.red},{r.green},{r.blue});width:{r.pct:.1f}%'></span>{escape(r.name)} {r.n:,} ({r.pct:.1f} %)</div>" for r in bars))
    if seconds := stats.get("stage_seconds"):
        parts.append("<h2>Processing</h2><table>" + "".join(f"<tr><td>{escape(k)}</td><td>{hms(v)}</td></tr>" for k, v in seconds.items()) + f"<tr><th>Total</th><td>{hms(sum(seconds.values()))}</td></tr></table>")
    parts += [f"<h2>{escape(k)}</h2><img src='{uri}'>" for k, uri in (previews or {}).items()]
    stamp = (now or datetime.now()).strftime("%Y-%m-%d %H:%M")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(survey.name)}</title></head><body>{''.join(parts)}<footer>{stamp}</footer></body></html>"
