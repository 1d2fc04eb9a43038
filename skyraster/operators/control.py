"""Control points: marks, automatic marking, similarity fits, triangulation, bundle adjustment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyraster.functions import geo, photo
from skyraster.operators.cloud import sample
from skyraster.plans.tables import numbered

MAX_SMALL = 1_000_000  # rows of a table that is sent to every task
POINT_BLOCK = 128
MOST_TIES = 4000  # tie points that are adjusted on the driver


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size is checked; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.count() <= MAX_SMALL else df


# --- catalog changes --------------------------------------------------------------------------


def upsert_marks(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Marks by (gcp_id, cam_id); a change replaces, a change with null px removes."""
    both = marks.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("gcp_id", "cam_id").orderBy(F.desc("_n"), "px", "py"))
    return both.withColumn("_r", last).where("_r = 1 and px is not null").drop("_n", "_r")


def clamp_marks(marks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Marks held inside their photo."""
    size = cameras.select("cam_id", "width", "height")
    hold = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(top).cast("double"))
    return marks.join(size, "cam_id").select("gcp_id", "cam_id", hold("px", "width").alias("px"), hold("py", "height").alias("py"))


def remove_cameras(cameras: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cameras and marks without the given cam_ids."""
    return cameras.join(gone, "cam_id", "left_anti"), marks.join(gone, "cam_id", "left_anti")


def remove_gcps(gcps: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return gcps.join(gone, "gcp_id", "left_anti"), marks.join(gone, "gcp_id", "left_anti")


def append_gcps(gcps: DataFrame, added: DataFrame, next_id: int) -> DataFrame:
    """New control points (label, and x, y, z and is_check if known) with ids from a counter that never goes back, by label."""
    rows = numbered(added, [c for c in ("label", "x", "y", "z") if c in added.columns], "gcp_id", next_id)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in added.columns else F.lit(v) for c, v in (("x", 0.0), ("y", 0.0), ("z", 0.0), ("is_check", False), ("enabled", True))})
    return gcps.unionByName(rows, allowMissingColumns=True)


def append_photos(cameras: DataFrame, photos: DataFrame, next_id: int) -> DataFrame:
    """New photos with ids from a counter that never goes back (ordered by path)."""
    return cameras.unionByName(numbered(photos, ["path"], "cam_id", next_id), allowMissingColumns=True)


def by_file_name(cameras: DataFrame) -> DataFrame:
    """Cameras keyed by file name; of several, the last added."""
    w = Window.partitionBy("name").orderBy(F.desc("cam_id"))
    return cameras.withColumn("name", photo.file_name()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def solved(poses: DataFrame, cameras: DataFrame, intrinsics: DataFrame) -> DataFrame:
    """Poses with their camera and intrinsics; those without either go."""
    named = by_file_name(cameras).select("name", "cam_id", "width", "height", "enabled")
    return poses.join(named, "name").join(small(intrinsics.select("camera_id", "fx", "fy", F.col("cx").alias("ppx"), F.col("cy").alias("ppy"))), "camera_id")


def usable_tracks(tracks: DataFrame, kept_cameras: DataFrame, kept_points: DataFrame) -> DataFrame:
    return tracks.join(kept_cameras, "name", "left_semi").join(kept_points, "pid", "left_semi")


def rays(marks: DataFrame, views: DataFrame) -> DataFrame:
    """Marks with their solved view, for control points seen from two views or more."""
    seen = marks.join(views, "cam_id")
    enough = seen.groupBy("gcp_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return seen.join(enough.select("gcp_id"), "gcp_id", "left_semi")


def project_position(cameras: DataFrame, epsg: int | None) -> DataFrame:
    """est_x/y/z of geotagged cameras from their geotag."""
    x, y = geo.forward("lon", "lat", epsg)
    tag = photo.has_geotag()
    return cameras.withColumn("est_x", F.when(tag, x).otherwise(F.col("est_x"))).withColumn("est_y", F.when(tag, y).otherwise(F.col("est_y"))).withColumn(
        "est_z", F.when(tag, F.coalesce("alt", F.lit(0.0))).otherwise(F.col("est_z")))


def first_geotag(cameras: DataFrame) -> DataFrame:
    """One row: lon, lat and UTM code of the first geotagged camera."""
    best = cameras.where(photo.has_geotag()).agg(F.min_by(F.struct("lon", "lat"), "cam_id").alias("b")).select("b.lon", "b.lat")
    return best.withColumn("epsg", geo.utm_epsg("lon", "lat"))


def sort_photos(cameras: DataFrame, by: str = "name", gcp: tuple[float, float] | None = None) -> DataFrame:
    """Photos by name, by capture time, or by distance to a control point (unsolved last)."""
    name = F.lower(photo.file_name())
    if by == "time":
        return cameras.orderBy(F.coalesce("datetime", F.lit("")), name, "cam_id")
    if by == "gcp" and gcp is not None:
        dx, dy = F.col("est_x") - gcp[0], F.col("est_y") - gcp[1]
        return cameras.orderBy((dx * dx + dy * dy).asc_nulls_last(), "cam_id")  # squared: a root would round different distances to one
    return cameras.orderBy(name, "cam_id") if by == "name" else cameras


# --- automatic marks --------------------------------------------------------------------------


def markable(gcps: DataFrame, ids: list[int] | None = None) -> DataFrame:
    rows = gcps.where("enabled and not (x = 0 and y = 0 and z = 0)")
    return rows if ids is None else rows.where(F.col("gcp_id").isin(ids))


def _best(hits: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """The best views of each control point, then without those that have a mark already."""
    rank = F.row_number().over(Window.partitionBy("gcp_id").orderBy("metric", "cam_id", "px", "py"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= most).join(marks, ["gcp_id", "cam_id"], "left_anti").select("gcp_id", "cam_id", "px", "py")


def _within_reach(views: DataFrame, points: DataFrame) -> DataFrame:
    """Views (wx, wy, reach) with the points (x, y) that lie within reach of them, and some more; reach is null where it has no bound.

    A view takes the cells, of the least power of two that is twice its reach, which its square touches: four at most.
    A point takes its cell of each of the sizes that occur. Views without bound and points meet in one cell of a size of its own.
    """
    level = F.when(F.col("reach").isNull(), _NO_BOUND).otherwise(F.greatest(F.ceil(F.log2(F.greatest(2 * F.col("reach"), F.lit(1e-3)))), F.lit(-10)).cast("int"))
    cell = lambda c, n="_level": F.when(F.col(n) == _NO_BOUND, F.lit(0)).otherwise(F.floor(c / F.pow(F.lit(2.0), n))).cast("long")
    reach = F.coalesce("reach", F.lit(0.0))
    views = views.withColumn("_level", level)
    views = views.withColumns({f"_{c}": F.explode(F.sequence(cell(F.col(f"w{c}") - reach), cell(F.col(f"w{c}") + reach))) for c in "x"})
    views = views.withColumn("_y", F.explode(F.sequence(cell(F.col("wy") - reach), cell(F.col("wy") + reach))))
    sizes = views.select("_level").distinct()  # powers of two: some dozens
    spots = points.crossJoin(F.broadcast(sizes)).withColumn("_x", cell(F.col("x"))).withColumn("_y", cell(F.col("y")))
    return views.join(spots, ["_level", "_x", "_y"]).drop("_level", "_x", "_y")


_NO_BOUND = 1000
_STEEP = math.radians(89.5)  # rays that are flatter than this may meet the ground anywhere


def _reach(height: Column, off: Column, half: Column) -> Column:
    """How far from a view's foot the ground can be that it sees: from its height over the lowest ground, its angle from nadir, and half its field of view."""
    return F.when(off + half < _STEEP, F.greatest(height, F.lit(0.0)) * F.tan(off + half) * 1.0001 + 1e-3)


def mark_solved(gcps: DataFrame, views: DataFrame, marks: DataFrame, sim: Similarity, most: int = 8) -> DataFrame:
    """Marks from solved views (qw..qz, tx..tz, fx, fy, ppx, ppy, width, height), most central first.

    Views meet the points within reach of their foot in the world; which they see is then worked out exactly.
    """
    inv = sim.inverse()
    x, y, z = geo.similarity(inv.s, inv.R.tolist(), inv.t.tolist())
    points = markable(gcps).select("gcp_id", "x", "y", x.alias("lx"), y.alias("ly"), z.alias("lz"), "z")
    lowest = points.agg(F.min("z")).first()[0]
    rows = geo.quaternion_rows()
    wx, wy, wz = geo.similarity(sim.s, sim.R.tolist(), sim.t.tolist(), *geo.centre(rows))
    down = sum(-float(sim.R[2, k]) * rows[2][k] for k in range(3))  # of the view's axis, in the world
    side = lambda p, n, f: F.greatest(F.abs(F.col(p)), F.abs(F.col(n) - F.col(p))) / F.abs(F.col(f))
    half = F.atan(F.hypot(side("ppx", "width", "fx"), side("ppy", "height", "fy")))
    off = F.acos(F.least(F.greatest(down, F.lit(-1.0)), F.lit(1.0)))
    seen = views.where("width > 0").withColumns({"wx": wx, "wy": wy, "reach": _reach(wz - F.lit(lowest), off, half)})
    both = _within_reach(seen, points.drop("z"))
    xc, yc, zc = geo.camera_point(rows, "lx", "ly", "lz", "tx", "ty", "tz")
    u, v = geo.pinhole(xc, yc, zc, "fx", "fy", "ppx", "ppy")
    hits = both.withColumn("px", u).withColumn("py", v).where(geo.inside("px", "py", "width", "height", 0.02))
    du, dv = F.col("px") - F.col("width") / 2, F.col("py") - F.col("height") / 2
    return _best(hits.withColumn("metric", du * du + dv * dv), marks, most)


def mark_geotagged(gcps: DataFrame, cameras: DataFrame, marks: DataFrame, epsg: int | None, geoid: float = 0.0, most: int = 8) -> DataFrame:
    """Marks from geotags and gimbal angles alone, nearest camera first. Cameras meet the points within reach, as in ``mark_solved``."""
    x, y = geo.forward("lon", "lat", epsg)
    cams = cameras.where(F.col("enabled") & photo.has_geotag() & (F.col("width") > 0)).withColumn("f", photo.focal_px()).where("f > 0")
    cams = cams.select("cam_id", "width", "height", "f", "yaw", "pitch", "rel_alt", x.alias("wx"), y.alias("wy"), (F.coalesce("alt", F.lit(0.0)) - geoid).alias("alt0"))
    points = markable(gcps).select("gcp_id", "x", "y", "z")
    lowest = points.agg(F.min("z")).first()[0]
    tilt = F.abs(F.radians(F.coalesce("pitch", F.lit(-90.0)) + 90))
    half = F.atan(F.hypot(F.col("width") / 2, F.col("height") / 2) / F.col("f"))
    height = F.greatest(F.col("alt0") - F.lit(lowest), F.coalesce("rel_alt", F.lit(0.0)))
    both = _within_reach(cams.withColumn("reach", _reach(height, tilt, half)), points)
    low = F.col("alt0") - F.col("z") < 5
    both = both.withColumn("camz", F.when(~low, F.col("alt0")).when(F.col("rel_alt") > 5, F.col("z") + F.col("rel_alt"))).where("camz is not null")
    both = both.withColumn("dx", F.col("x") - F.col("wx")).withColumn("dy", F.col("y") - F.col("wy")).withColumn("dz", F.col("z") - F.col("camz"))
    xc, yc, zc = geo.camera_point(geo.nadir_rows(), "dx", "dy", "dz", F.lit(0.0), F.lit(0.0), F.lit(0.0))
    u, v = geo.pinhole(xc, yc, zc, "f", "f", F.col("width") / 2, F.col("height") / 2)
    hits = both.withColumn("px", u).withColumn("py", v).where(geo.inside("px", "py", "width", "height", 0.05))
    return _best(hits.withColumn("metric", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), marks, most)


def auto_mark(gcps: DataFrame, cameras: DataFrame, marks: DataFrame, views: DataFrame | None = None, sim: Similarity | None = None, epsg: int | None = None,
              geoid: float = 0.0, ids: list[int] | None = None, most: int = 8) -> tuple[DataFrame, str]:
    """(all marks, what the new ones come from): solved views if there are any, else geotags. Marks that are there stay."""
    wanted = markable(gcps, ids)
    if views is not None and sim is not None and not views.isEmpty():
        found, method = mark_solved(wanted, views, marks, sim, most), "reconstruction"
    else:
        found, method = mark_geotagged(wanted, cameras, marks, epsg, geoid, most), "geotags"
    return upsert_marks(marks, found), method


# --- similarity -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Similarity:
    """world = s * R @ local + t."""

    s: float
    R: np.ndarray
    t: np.ndarray

    def inverse(self) -> Similarity:
        return Similarity(1 / self.s, self.R.T, -(self.R.T @ self.t) / self.s)

    def columns(self, x="x", y="y", z="z") -> tuple[Column, ...]:
        return geo.similarity(self.s, self.R.tolist(), self.t.tolist(), x, y, z)

    def apply(self, points: DataFrame) -> DataFrame:
        x, y, z = self.columns()
        return points.withColumns({"x": x, "y": y, "z": z})


def fit_similarity(pairs: DataFrame, with_scale: bool = True) -> Similarity:
    """Least-squares similarity from (sx, sy, sz) to (dx, dy, dz).

    Eighteen sums in one pass over the pairs; only they reach the driver. Sums are taken around
    the first pair, so that large coordinates lose nothing.
    """
    src, dst = ("sx", "sy", "sz"), ("dx", "dy", "dz")
    first = pairs.select(*src, *dst).first()
    if first is None:
        raise ValueError("no pairs to fit")
    near = pairs.select(*[(F.col(c) - first[c]).alias(c) for c in (*src, *dst)])
    one = near.agg(*[F.avg(c).alias(f"m_{c}") for c in (*src, *dst)], *[F.covar_pop(a, b).alias(f"{b}_{a}") for a in src for b in dst], *[F.var_pop(c).alias(f"v_{c}") for c in src]).first()
    cov = np.array([[one[f"{b}_{a}"] for a in src] for b in dst])
    left, scale, right = np.linalg.svd(cov)
    flip = np.array([1, 1, np.sign(np.linalg.det(left) * np.linalg.det(right)) or 1.0])
    rotation = (left * flip) @ right
    spread = sum(one[f"v_{c}"] for c in src)
    s = float((scale * flip).sum() / spread) if with_scale and spread > 0 else 1.0
    middle = {c: one[f"m_{c}"] + first[c] for c in (*src, *dst)}
    return Similarity(s, rotation, np.array([middle[c] for c in dst]) - s * rotation @ np.array([middle[c] for c in src]))


def residuals(pairs: DataFrame, sim: Similarity) -> DataFrame:
    """pairs with ex, ey, ez and error."""
    p = sim.columns("sx", "sy", "sz")
    out = pairs.withColumns({f"e{c}": q - F.col(f"d{c}") for c, q in zip("xyz", p, strict=True)})
    return out.withColumn("error", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))


def rmse(found: DataFrame, *by: str) -> DataFrame:
    """n, rmse and the three axes' rmse, by group."""
    square = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), square("error").alias("rmse"), *[square(f"e{c}").alias(f"rmse_{c}") for c in "xyz"])


# --- triangulation and bundle adjustment ------------------------------------------------------


def triangulate(rays_: DataFrame, key: str = "gcp_id") -> DataFrame:
    """(key, x, y, z): linear triangulation of each point from its rays (p00..p23, px, py)."""
    names = [f"p{i}{j}" for i in range(3) for j in range(4)]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows[names].to_numpy(float).reshape(-1, 3, 4)
        u, v = rows["px"].to_numpy(float), rows["py"].to_numpy(float)
        a = np.concatenate([u[:, None] * m[:, 2] - m[:, 0], v[:, None] * m[:, 2] - m[:, 1]])
        # The null vector of all rays' rows, from their singular values: a normal matrix would square the errors.
        w = np.linalg.svd(a, full_matrices=False)[2][-1]
        x = w[:3] if abs(w[3]) < 1e-12 else w[:3] / w[3]
        return pd.DataFrame({key: rows[key].iloc[:1], "x": x[:1], "y": x[1:2], "z": x[2:3]})

    return rays_.select(key, *names, "px", "py").groupBy(key).applyInPandas(solve, f"{key} long, x double, y double, z double")


def projection_columns() -> dict[str, Column]:
    """p00..p23 of K [R | t] from qw..qz, tx..tz, fx, fy, ppx, ppy."""
    rows, t = geo.quaternion_rows(), [F.col(c) for c in ("tx", "ty", "tz")]
    full = [[*r, s] for r, s in zip(rows, t, strict=True)]
    out = {}
    for j in range(4):
        out[f"p0{j}"] = F.col("fx") * full[0][j] + F.col("ppx") * full[2][j]
        out[f"p1{j}"] = F.col("fy") * full[1][j] + F.col("ppy") * full[2][j]
        out[f"p2{j}"] = full[2][j]
    return out


@dataclass
class Adjustment:
    rvecs: np.ndarray
    tvecs: np.ndarray
    points: np.ndarray
    rmse_before: float
    rmse_after: float
    n_obs: int
    intrinsics: np.ndarray | None = None


def rotation_matrix(r: np.ndarray) -> np.ndarray:
    """Rodrigues' formula for rows of rotation vectors."""
    r = np.atleast_2d(r)
    angle = np.linalg.norm(r, axis=1)[:, None, None]
    k = np.zeros((len(r), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -r[:, 2], r[:, 1], -r[:, 0]
    k = k - k.transpose(0, 2, 1)
    safe = np.maximum(angle, 1e-12)
    return np.eye(3) + np.sinc(angle / np.pi) * k + (1 - np.cos(angle)) / safe**2 * (k @ k) * (angle > 1e-9)


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """The inverse of ``rotation_matrix`` for (n, 3, 3), by way of the quaternion's greatest component."""
    t = np.trace(r, axis1=1, axis2=2)
    four = np.empty((len(r), 4, 4))  # 4 q q^T
    four[:, 0, 0] = 1 + t
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        four[:, i + 1, i + 1] = 1 + 2 * r[:, i, i] - t
        four[:, 0, i + 1] = four[:, i + 1, 0] = r[:, k, j] - r[:, j, k]
        four[:, j + 1, k + 1] = four[:, k + 1, j + 1] = r[:, j, k] + r[:, k, j]
    best = np.argmax(np.einsum("nii->ni", four), axis=1)
    q = four[np.arange(len(r)), best]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q *= np.where(q[:, :1] < 0, -1, 1)
    sine = np.linalg.norm(q[:, 1:], axis=1)
    angle = 2 * np.arctan2(sine, q[:, 0])
    return q[:, 1:] * (angle / np.maximum(sine, 1e-300))[:, None] * (sine > 0)[:, None]


@dataclass
class Refined:
    centres: dict[int, np.ndarray]  # cam_id -> world position
    rmse_before: float
    rmse_after: float
    n_obs: int
    lens: np.ndarray | None


def refine(views: DataFrame, ties: DataFrame, tracks: DataFrame, gcps: DataFrame, marks: DataFrame, sim: Similarity) -> Refined | None:
    """Adjusts world poses and tie points to tracks and marks; control points stay where they were surveyed.

    None if there is too little to hold on to: two views, three marked control points with six
    marks, six observations a view. One shared lens is calibrated too if all views have one camera
    model and fifteen observations each. Views reach the driver. Up to MOST_TIES tie points are
    solved there too; more stay in tables (``bundle.adjust``), all of them.
    """
    cams = views.select("cam_id", "name", "camera_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "fx", "fy", "ppx", "ppy").orderBy("cam_id").toPandas()
    marked = marks.join(small(views.select("cam_id")), "cam_id", "left_semi").select("cam_id", "gcp_id", "px", "py")
    fixed = markable(gcps).select("gcp_id", "x", "y", "z").join(marks.select("gcp_id").distinct(), "gcp_id", "left_semi")
    marked = marked.join(fixed.select("gcp_id"), "gcp_id", "left_semi")
    held = marked.agg(F.count_distinct("gcp_id").alias("points"), F.count(F.lit(1)).alias("n")).first()
    if len(cams) < 2 or fixed.count() < 3 or held.points < 3 or held.n < 6:
        return None
    world_ties = sim.apply(ties.select("pid", "x", "y", "z"))
    tables = ties.limit(MOST_TIES + 1).count() > MOST_TIES
    seen = usable_tracks(tracks, small(views.select("name")), ties.select("pid")).select("name", "pid", "u", "v")
    n_obs = seen.count() + held.n
    if n_obs < 6 * len(cams):
        return None
    w, x, y, z = cams[["qw", "qx", "qy", "qz"]].to_numpy(float).T
    local = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
                      2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)
    world = local @ sim.R.T
    # projected coordinates are large; around the control points' middle nothing is lost
    middle = np.array(fixed.agg(*[F.avg(c) for c in "xyz"]).first(), float)
    shift = sim.s * cams[["tx", "ty", "tz"]].to_numpy(float) - world @ (sim.t - middle)
    shared = cams["camera_id"].nunique() == 1 and n_obs > 15 * len(cams)
    lens = np.column_stack([(cams["fx"] + cams["fy"]) / 2, cams["ppx"], cams["ppy"], np.zeros(len(cams))])
    start = (rotation_vector(world), shift, lens[:1] if shared else lens)
    near = [(F.col(c) - float(m)).alias(c) for c, m in zip("xyz", middle, strict=True)]
    if tables:
        from skyraster.operators import bundle

        number = small(views.sparkSession.createDataFrame([(int(c), n, k) for k, (c, n) in enumerate(zip(cams["cam_id"], cams["name"], strict=True))], "cam_id long, name string, cam int"))
        own = (-1 - F.col("gcp_id")).alias("pid")  # beside the tie points' ids, which are not negative
        points = world_ties.select("pid", *near, F.lit(False).alias("fixed")).unionByName(fixed.select(own, *near, F.lit(True).alias("fixed")))
        observed = seen.join(number, "name").select("pid", "cam", "u", "v").unionByName(marked.join(number, "cam_id").select(own, "cam", F.col("px").alias("u"), F.col("py").alias("v")))
        out = bundle.adjust(points, observed, *start, refine_intrinsics=shared)
        found = out.intrinsics[0] if shared else None
    else:
        free, still = world_ties.select("pid", *near).orderBy("pid").toPandas(), fixed.select("gcp_id", *near).orderBy("gcp_id").toPandas()
        seen, marked = seen.orderBy("name", "pid", "u", "v").toPandas(), marked.orderBy("cam_id", "gcp_id").toPandas()
        by_name, by_id = {x: k for k, x in enumerate(cams["name"])}, {x: k for k, x in enumerate(cams["cam_id"])}
        tie_row, gcp_row = {x: k for k, x in enumerate(free["pid"])}, {x: len(free) + k for k, x in enumerate(still["gcp_id"])}
        obs = np.concatenate([
            np.column_stack([seen["name"].map(by_name), seen["pid"].map(tie_row), seen["u"], seen["v"]]).astype(float).reshape(-1, 4),
            np.column_stack([marked["cam_id"].map(by_id), marked["gcp_id"].map(gcp_row), marked["px"], marked["py"]]).astype(float).reshape(-1, 4)])
        points = np.concatenate([free[["x", "y", "z"]].to_numpy(float), still[["x", "y", "z"]].to_numpy(float)])
        out = bundle_adjust(*start, points, np.arange(len(points)) >= len(free), obs, refine_intrinsics=shared)
        found = out.intrinsics if shared else None
    centres = -np.einsum("nji,nj->ni", rotation_matrix(out.rvecs), out.tvecs) + middle
    return Refined({int(c): p for c, p in zip(cams["cam_id"], centres, strict=True)}, out.rmse_before, out.rmse_after, out.n_obs, found)


def bundle_adjust(rvecs: np.ndarray, tvecs: np.ndarray, intrinsics: np.ndarray, points: np.ndarray, fixed: np.ndarray, obs: np.ndarray,
                  refine_intrinsics: bool = False, rounds: int = 60) -> Adjustment:
    """Levenberg-Marquardt over poses, free points and, if asked, shared [f, cx, cy, k1].

    ``intrinsics`` is one [f, cx, cy, k1] row or one row a camera; ``obs`` rows are (camera, point,
    u, v). The problem is the one the survey bounds beforehand (a few thousand tie points), so it
    is solved on the driver: points are eliminated POINT_BLOCK at a time (Schur complement), which leaves
    a dense system of six unknowns a camera. Beside that system memory goes with the observations.
    """
    cam, pt, uv = obs[:, 0].astype(int), obs[:, 1].astype(int), obs[:, 2:4].astype(float)
    intr = np.atleast_2d(np.asarray(intrinsics, float))
    shared = len(intr) == 1
    refine_intrinsics = refine_intrinsics and shared
    poses = np.hstack([rvecs, tvecs]).astype(float)
    pts = np.array(points, float)
    free = ~np.asarray(fixed, bool)
    nc, ni = len(poses), 4 if refine_intrinsics else 0

    def project(poses: np.ndarray, pts: np.ndarray, intr: np.ndarray) -> np.ndarray:
        local = np.einsum("nij,nj->ni", rotation_matrix(poses[cam, :3]), pts[pt]) + poses[cam, 3:]
        n = local[:, :2] / local[:, 2:3]
        k = intr[np.zeros_like(cam)] if shared else intr[cam]
        d = 1 + k[:, 3] * (n * n).sum(1)
        return n * (k[:, 0] * d)[:, None] + k[:, 1:3]

    def jacobian(f, n: int, step: float) -> np.ndarray:
        return np.stack([(f(k, step) - f(k, -step)) / (2 * step) for k in range(n)], axis=2)

    def moved_pose(k: int, h: float) -> np.ndarray:
        p = poses.copy()
        p[:, k] += h
        return project(p, pts, intr)

    def moved_point(k: int, h: float) -> np.ndarray:
        p = pts.copy()
        p[:, k] += h
        return project(poses, p, intr)

    def moved_lens(k: int, h: float) -> np.ndarray:
        p = intr.copy()
        p[:, k] += h * max(1.0, abs(p[0, k]))
        return project(poses, pts, p) / max(1.0, abs(intr[0, k]))

    size = lambda r: float(np.sqrt(np.mean(r**2))) if len(r) else 0.0
    res = project(poses, pts, intr) - uv
    before, lam = size(res), 1e-3
    n = 6 * nc + ni
    order = np.argsort(pt, kind="stable")
    edges = np.searchsorted(pt[order], np.arange(0, len(pts) + POINT_BLOCK, POINT_BLOCK))
    place = 6 * cam[:, None] + np.arange(6)
    for _ in range(rounds):
        a = jacobian(moved_pose, 6, 1e-6)
        b = jacobian(moved_point, 3, 1e-6) * free[pt][:, None, None]
        c = jacobian(moved_lens, 4, 1e-6) if ni else np.zeros((len(obs), 2, 0))
        u, v = np.zeros((n, n)), np.zeros((len(pts), 3, 3))
        gc, gp = np.zeros(n), np.zeros((len(pts), 3))
        own, cross = np.zeros((nc, 6, 6)), np.zeros((nc, 6, ni))
        np.add.at(own, cam, np.einsum("oai,oaj->oij", a, a))
        np.add.at(cross, cam, np.einsum("oai,oaj->oij", a, c))
        for k in range(nc):
            u[6 * k : 6 * k + 6, 6 * k : 6 * k + 6] = own[k]
        u[: 6 * nc, 6 * nc :] = cross.reshape(6 * nc, ni)
        u[6 * nc :, : 6 * nc] = u[: 6 * nc, 6 * nc :].T
        u[6 * nc :, 6 * nc :] = np.einsum("oai,oaj->ij", c, c)
        np.add.at(gc, place, np.einsum("oai,oa->oi", a, res))
        gc[6 * nc :] = np.einsum("oai,oa->i", c, res)
        np.add.at(v, pt, np.einsum("oai,oaj->oij", b, b))
        np.add.at(gp, pt, np.einsum("oai,oa->oi", b, res))
        ab, cb = np.einsum("oai,oaj->oij", a, b), np.einsum("oai,oaj->oij", c, b)

        def blocks(ab: np.ndarray = ab, cb: np.ndarray = cb):
            """(first point, what cameras and lens share with each point of a block)."""
            for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                some, first = order[lo:hi], k * POINT_BLOCK
                w = np.zeros((min(POINT_BLOCK, len(pts) - first), n, 3))
                np.add.at(w, (pt[some][:, None] - first, place[some]), ab[some])
                if ni:
                    np.add.at(w, (pt[some][:, None] - first, 6 * nc + np.arange(ni)[None, :]), cb[some])
                yield first, w

        better = False
        for _ in range(10):
            v2 = v + np.einsum("pij,ij->pij", v * lam, np.eye(3)) + np.eye(3) * 1e-12
            inv = np.linalg.inv(v2 + np.eye(3) * ~free[:, None, None])
            s, g = u + np.diag(lam * np.diag(u) + 1e-12), gc.copy()
            for first, w in blocks():
                here = slice(first, first + len(w))
                wv = w @ inv[here]
                s -= wv.transpose(1, 0, 2).reshape(n, -1) @ w.transpose(1, 0, 2).reshape(n, -1).T
                g -= np.einsum("pij,pj->i", wv, gp[here])
            dc = -np.linalg.solve(s, g)
            back = np.concatenate([np.einsum("pij,i->pj", w, dc) for _, w in blocks()]) if len(pts) else gp
            dp = -np.einsum("pij,pj->pi", inv, gp + back) * free[:, None]
            p2, t2 = poses + dc[: 6 * nc].reshape(nc, 6), pts + dp
            i2 = intr + dc[6 * nc :] if ni else intr
            r2 = project(p2, t2, i2) - uv
            if size(r2) < size(res):
                better = size(res) - size(r2) > 1e-12 * max(size(res), 1e-12)
                poses, pts, intr, res, lam = p2, t2, i2, r2, lam / 5
                break
            lam *= 5
        if not better:
            break
    return Adjustment(poses[:, :3], poses[:, 3:], pts, before, size(res), len(obs), intr[0] if shared else None)


def tie_sample(points: DataFrame, most: int = 4000) -> DataFrame:
    """The tie points that enter an adjustment."""
    return sample(points, most, "pid")


def similarity_from(values: Sequence[float]) -> Similarity:
    """From thirteen numbers: s, R by rows, t."""
    v = np.asarray(values, float)
    return Similarity(float(v[0]), v[1:10].reshape(3, 3), v[10:13])
