"""Point clouds: thinning, outliers, local shape, features and rule-based classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions.photo import band, green
from skyraster.operators import grid, knn, morph
from skyraster.plans.tables import cut
from skyraster.schema import CLASSES


def voxel_key(cell: float) -> Column:
    """Hash of the voxel; colliding voxels are one."""
    i, j, k = (F.floor(F.col(c) / cell).cast("long") for c in ("x", "y", "z"))
    return (i * 73856093).bitwiseXOR(j * 19349663).bitwiseXOR(k * 83492791)


def thin(points: DataFrame, density: float) -> DataFrame:
    """One point (the first by pt_id) of each voxel, for about ``density`` points a square metre."""
    if density <= 0:
        return points
    keyed = points.withColumn("_key", voxel_key(1 / math.sqrt(density)))
    first = keyed.groupBy("_key").agg(F.min("pt_id").alias("pt_id"))
    return points.join(first.select("pt_id"), "pt_id", "left_semi")


def drop_noise(points: DataFrame) -> DataFrame:
    """Without class 7, unless everything is class 7."""
    some = points.agg(F.bool_or(F.col("cls") != 7).alias("some"))
    return points.crossJoin(F.broadcast(some)).where("cls <> 7 or not some").drop("some")  # some is one row


def neighbour_distance(points: DataFrame, k: int = 8) -> DataFrame:
    """(pt_id, mean_d): mean distance to the k nearest points."""
    return knn.neighbours(points, k).groupBy("pt_id").agg(F.avg(F.sqrt("d2")).alias("mean_d"))


def outliers(points: DataFrame, k: int = 8, sigma: float = 3.0) -> DataFrame:
    """(pt_id, mean_d, noisy): mean neighbour distance beyond mean + sigma standard deviations."""
    mean = cut(neighbour_distance(points, k), "spread")
    limit = mean.agg((F.avg("mean_d") + sigma * F.stddev_pop("mean_d")).alias("limit"))
    few = points.limit(k + 1).count() < k + 1
    noisy = F.lit(False) if few else F.col("mean_d") > F.col("limit")
    return mean.crossJoin(F.broadcast(limit)).select("pt_id", "mean_d", noisy.alias("noisy"))  # limit is one row


def _covariances(points: DataFrame, k: int, extra: list[Column]) -> DataFrame:
    """Population covariance of each point's k nearest points (itself included)."""
    near = knn.neighbours(points, k, include_self=True)
    cloud = points.select(F.col("pt_id").alias("nbr_id"), "x", "y", "z")
    rows = near.join(cloud, "nbr_id")
    # Differences from the point itself: covariances do not change, and large coordinates cancel exactly.
    own = points.select("pt_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    rows = rows.join(own, "pt_id").select("pt_id", "z", *[(F.col(c) - F.col(f"_{c}")).alias(f"d{c}") for c in "xyz"])
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return rows.groupBy("pt_id").agg(*[F.covar_pop(f"d{a}", f"d{b}").alias(f"c{a}{b}") for a, b in pairs], *extra)


def eigenvalues(a: str = "c") -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in closed form, largest first."""
    xx, yy, zz, xy, xz, yz = (F.col(f"{a}{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    bx, by, bz = xx - q, yy - q, zz - q
    det = bx * (by * bz - yz * yz) - xy * (xy * bz - yz * xz) + xz * (xy * yz - by * xz)
    r = F.least(F.greatest(det / F.greatest(2 * p * p * p, F.lit(1e-300)), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return high, 3 * q - high - low, low


def plane_residual(points: DataFrame, k: int = 12) -> DataFrame:
    """(pt_id, residual): root of the smallest eigenvalue of the neighbourhood's covariance."""
    low = eigenvalues()[2]
    return _covariances(points, k, []).select("pt_id", F.sqrt(F.greatest(low, F.lit(0.0))).alias("residual"))


FEATURES = ["hag", "planarity", "linearity", "sphericity", "surface_variation", "verticality", "z_range", "greenness", "brightness"]


def height_over_lowest(points: DataFrame, cell: float = 3.0) -> DataFrame:
    """Adds hag: z above the lowest point of the cell; cells count from the south-west corner."""
    e = grid.extent(points).first()
    last = {c: max(math.ceil((hi - lo) / cell), 0) for c, lo, hi in (("x", e.minx, e.maxx), ("y", e.miny, e.maxy))}
    rows = points.withColumn("_i", F.least(F.floor((F.col("x") - e.minx) / cell), F.lit(last["x"])).cast("long"))
    rows = rows.withColumn("_j", F.least(F.floor((F.col("y") - e.miny) / cell), F.lit(last["y"])).cast("long"))
    lowest = rows.groupBy("_i", "_j").agg(F.min("z").alias("_low"))
    return rows.join(lowest, ["_i", "_j"]).withColumn("hag", F.col("z") - F.col("_low")).drop("_i", "_j", "_low")


def features(points: DataFrame, k: int = 15) -> DataFrame:
    """points with the nine FEATURES of each neighbourhood."""
    cov = _covariances(points, k, [(F.max("z") - F.min("z")).alias("z_range")])

    def normals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for (i, j), name in zip(((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)), ("cxx", "cyy", "czz", "cxy", "cxz", "cyz"), strict=True):
                m[:, i, j] = m[:, j, i] = b[name]
            value, vector = np.linalg.eigh(m)
            yield pd.DataFrame({"pt_id": b["pt_id"], "z_range": b["z_range"], "l3": value[:, 0], "l2": value[:, 1], "l1": value[:, 2], "verticality": 1 - np.abs(vector[:, 2, 0])})

    shape = cov.mapInPandas(normals, "pt_id long, z_range double, l3 double, l2 double, l1 double, verticality double")
    l1 = F.greatest("l1", F.lit(1e-9))
    total = F.greatest(l1 + F.col("l2") + F.col("l3"), F.lit(1e-9))
    shape = shape.select("pt_id", "z_range", "verticality", ((F.col("l2") - F.col("l3")) / l1).alias("planarity"), ((l1 - F.col("l2")) / l1).alias("linearity"),
                         (F.col("l3") / l1).alias("sphericity"), (F.col("l3") / total).alias("surface_variation"))
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    light = r + g + b + 1e-6
    out = height_over_lowest(points).join(shape, "pt_id")
    return out.withColumn("greenness", (2 * g - r - b) / light).withColumn("brightness", light / 3 / 255)


def classify(points: DataFrame, cell: float | None = None, rough: float = 0.18, denoise: bool = True) -> DataFrame:
    """points with class: outliers 7, ground 2, and the rest by height, roughness and colour."""
    points = cut(points.drop("cls"), "cloud")
    cell = cell or morph.ground_cell(points)
    noisy = points.limit(0).select("pt_id")
    if denoise and points.limit(101).count() > 100:
        noisy = cut(outliers(points).where("noisy").select("pt_id"), "noisy")
    kept = cut(points.join(noisy, "pt_id", "left_anti"), "kept")
    flagged = points.join(noisy, "pt_id", "left_semi").withColumn("cls", F.lit(7))
    if kept.limit(10).count() < 10:
        return flagged.unionByName(kept.withColumn("cls", F.lit(1)))
    meta = grid.plan(kept, cell)
    high = cut(morph.height_above(kept, morph.ground_surface(kept, meta), meta), "heights")
    ground = high.where("hag <= 0.35").withColumn("cls", F.lit(2)).drop("hag")
    other = high.where("hag > 0.35")
    residual = plane_residual(other) if other.limit(3).count() == 3 else other.select("pt_id", F.lit(0.0).alias("residual"))
    other = other.join(residual, "pt_id").withColumn("veg", (F.col("residual") > rough) | green())
    other = other.withColumn("cls", band()).drop("hag", "residual", "veg")
    return flagged.unionByName(ground).unionByName(other)


def class_rules(points: DataFrame) -> DataFrame:
    """Classes from height above ground and flatness alone (columns hag, coplanar): later rules win."""
    h = F.col("hag")
    cls = F.when(F.col("coplanar") & (h > 2.5), 6).when(h > 5, 5).when(h > 2, 4).when(h > 0.35, 3).otherwise(F.col("cls"))
    return points.withColumn("cls", cls)


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "code int, name string, red int, green int, blue int")


def histogram(points: DataFrame) -> DataFrame:
    """cls, n, pct, name and colour (150, 150, 150 for unknown classes)."""
    n = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    out = n.crossJoin(F.broadcast(total)).join(F.broadcast(class_table(points.sparkSession)), F.col("cls") == F.col("code"), "left")  # one row; ten rows
    return out.select("cls", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), F.coalesce("name", F.concat(F.lit("Class "), F.col("cls").cast("string"))).alias("name"),
                      *[F.coalesce(c, F.lit(150)).alias(c) for c in ("red", "green", "blue")])


def ground_height(points: DataFrame) -> DataFrame:
    """One row: median z of the ground class, or the 5th percentile of all."""
    rows = points.agg(F.expr("median(z) filter (where cls = 2)").alias("g"), F.percentile("z", F.lit(0.05)).alias("low"))
    return rows.select(F.coalesce("g", "low").alias("ground_z"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by hash of a key: the same rows every time, on any cluster. Only those with low hashes are sorted."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    total = rows.count()
    if total > 8 * n:
        low = hashed.where(F.col("_h") < int(-(2**63) + 4 * n / total * 2**64))
        if low.limit(n).count() == n:  # else the hashes are of few keys
            hashed = low
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def render_top(points: DataFrame, width: int, height: int) -> DataFrame:
    """Top view: colour of the highest point in each pixel (row, col, r, g, b, z)."""
    e = grid.extent(points).first()
    sx, sy = max(e.maxx - e.minx, 1e-9), max(e.maxy - e.miny, 1e-9)
    col = F.floor((F.col("x") - e.minx) / sx * (width - 1)).cast("long")
    row = F.floor((e.maxy - F.col("y")) / sy * (height - 1)).cast("long")
    top = F.max(F.struct("z", "pt_id", "r", "g", "b")).alias("top")
    return points.groupBy(row.alias("row"), col.alias("col")).agg(top).select("row", "col", "top.r", "top.g", "top.b", "top.z")
