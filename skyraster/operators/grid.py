"""Grids from point clouds: planning, binning, dense scaffolds, filling, resampling.

A grid table is (row, col, value); row 0 is the north edge. Planning reads one aggregated row;
everything else stays in tables, keyed by (row, col), so a grid may be larger than any one
machine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyraster.operators import blocks
from skyraster.plans.tables import cut
from skyraster.schema import RasterMeta

KEY = ["row", "col"]


def extent(points: DataFrame) -> DataFrame:
    """One row: minx, miny, maxx, maxy, n."""
    return points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count(F.lit(1)).alias("n"))


def mean_spacing(points: DataFrame) -> DataFrame:
    """One row: the square root of area per point."""
    area = F.greatest((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), F.lit(1e-6))
    return extent(points).select(F.sqrt(area / F.greatest("n", F.lit(1))).alias("spacing"))


def plan(points: DataFrame, cell: float, frame: tuple[float, float, float, float] | None = None) -> RasterMeta:
    """Grid that covers the points (or the frame) at a cell size."""
    if frame is None:
        e = extent(points).first()
        if e.minx is None:
            raise ValueError("no points to grid")
        frame = (e.minx, e.miny, e.maxx, e.maxy)
    nx, ny = (max(math.ceil(d / cell) + 1, 1) for d in (frame[2] - frame[0], frame[3] - frame[1]))
    return RasterMeta(frame[0], frame[3], cell, nx, ny)


def native_cell(points: DataFrame, target: float, factor: float = 1.5) -> float:
    """The finest cell that the cloud can fill."""
    return max(target, mean_spacing(points).first().spacing * factor)


def target_cell(points: DataFrame, gsd: float | None, mode: str, custom: float, max_dim: int) -> float:
    """Cell from settings, photo resolution or density, coarsened to at most max_dim cells a side."""
    e = extent(points).first()
    if mode == "custom" and custom > 0:
        cell = custom
    else:
        cell = gsd or max(mean_spacing(points).first().spacing, 0.02)
    span = max(e.maxx - e.minx, e.maxy - e.miny, 1.0)
    return max(cell, span / max(max_dim, 1000))


def cell_row(meta: RasterMeta, y: str = "y") -> Column:
    return F.least(F.greatest(F.floor((meta.maxy - F.col(y)) / meta.cell), F.lit(0)), F.lit(meta.ny - 1)).cast("long")


def cell_col(meta: RasterMeta, x: str = "x") -> Column:
    return F.least(F.greatest(F.floor((F.col(x) - meta.minx) / meta.cell), F.lit(0)), F.lit(meta.nx - 1)).cast("long")


def indexed(points: DataFrame, meta: RasterMeta) -> DataFrame:
    return points.withColumn("row", cell_row(meta)).withColumn("col", cell_col(meta))


def binned(points: DataFrame, meta: RasterMeta, how: str = "max", value: str = "z", by: str | None = None) -> DataFrame:
    """(row, col, value): max, min or mean of a value, or the value at the greatest (by, pt_id)."""
    if by is not None:
        out = F.max_by(value, F.struct(by, "pt_id"))
    else:
        out = {"max": F.max, "min": F.min, "mean": F.avg}[how](value)
    return indexed(points, meta).groupBy(*KEY).agg(out.alias("value"))


def scaffold(spark: SparkSession, meta: RasterMeta) -> DataFrame:
    """Every (row, col) of the grid."""
    i = F.col("id")
    return spark.range(meta.nx * meta.ny).select(F.floor(i / meta.nx).cast("long").alias("row"), (i % meta.nx).alias("col"))


def dense(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Every cell, null where the cells have none."""
    return scaffold(cells.sparkSession, meta).join(cells, KEY, "left")


def fill_nearest(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Dense grid with nulls taken from the nearest valid cell; ties by row, then column. Values are numbers, or structs of them."""
    kind = cells.schema["value"].dataType
    valid = cells.where("value is not null")
    if valid.isEmpty():
        raise ValueError("no valid cell to fill from")
    names = [f.name for f in kind.fields] if isinstance(kind, StructType) else []
    planes = {"_valid": F.lit(1.0), **{f"_{n}": F.col(f"value.{n}") for n in names}} if names else {"_value": F.col("value")}
    packed = blocks.pack(valid.select(*KEY, *[c.alias(n) for n, c in planes.items()]), meta, list(planes))
    full = blocks.unpack(blocks.nearest(packed, meta, len(planes)), meta, list(planes))
    value = F.struct(*[F.col(f"_{f.name}").cast(f.dataType).alias(f.name) for f in kind.fields]) if names else F.col("_value").cast(kind)
    return full.select(*KEY, value.alias("value"))


def native(points: DataFrame, meta: RasterMeta, how: str = "max", value: str = "z", by: str | None = None) -> DataFrame:
    """Binned and filled grid."""
    return fill_nearest(binned(points, meta, how, value, by), meta)


def bilinear(grid: DataFrame, meta: RasterMeta, target: RasterMeta, shift: float = 0.0) -> DataFrame:
    """Dense target grid interpolated between the four nearest cells of ``grid``, minus ``shift``."""
    ratio = target.cell / meta.cell
    out = scaffold(grid.sparkSession, target)
    r, c = (F.col("row") + 0.5) * ratio - 0.5, (F.col("col") + 0.5) * ratio - 0.5
    return sample(out.withColumn("_r", r).withColumn("_c", c), grid, meta).select("row", "col", (F.col("value") - shift).alias("value"))


def sample(rows: DataFrame, grid: DataFrame, meta: RasterMeta) -> DataFrame:
    """Adds ``value`` at fractional (_r, _c), edges clamped."""
    r = F.least(F.greatest("_r", F.lit(0.0)), F.lit(float(meta.ny - 1)))
    c = F.least(F.greatest("_c", F.lit(0.0)), F.lit(float(meta.nx - 1)))
    out = rows.withColumn("_r", r).withColumn("_c", c).withColumn("_r0", F.floor("_r").cast("long")).withColumn("_c0", F.floor("_c").cast("long"))
    for dr in (0, 1):
        for dc in (0, 1):
            corner = grid.select(F.col("row").alias("_gr"), F.col("col").alias("_gc"), F.col("value").alias(f"_v{dr}{dc}"))
            at = (F.least(F.col("_r0") + dr, F.lit(meta.ny - 1)) == F.col("_gr")) & (F.least(F.col("_c0") + dc, F.lit(meta.nx - 1)) == F.col("_gc"))
            out = out.join(corner, at, "left").drop("_gr", "_gc")
    fr, fc = F.col("_r") - F.col("_r0"), F.col("_c") - F.col("_c0")
    value = (F.col("_v00") * (1 - fr) * (1 - fc) + F.col("_v01") * (1 - fr) * fc + F.col("_v10") * fr * (1 - fc) + F.col("_v11") * fr * fc)
    return out.withColumn("value", value).drop("_r", "_c", "_r0", "_c0", "_v00", "_v01", "_v10", "_v11")


def decimate(grid: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column."""
    return grid.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).select(
        F.floor(F.col("row") / step).cast("long").alias("row"), F.floor(F.col("col") / step).cast("long").alias("col"), "value")


def stretch(grid: DataFrame) -> DataFrame:
    """False colour between the 2nd and 98th percentile: row, col, r, g, b (0..255)."""
    limits = grid.agg(F.percentile("value", F.lit(0.02)).alias("lo"), F.percentile("value", F.lit(0.98)).alias("hi"))
    n = F.least(F.greatest((F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    out = grid.where("value is not null").crossJoin(F.broadcast(limits)).withColumn("n", n)  # limits is one row
    green = F.abs(F.sin(math.pi * F.col("n"))) * 200 + 40
    return out.select("row", "col", (F.col("n") * 255).cast("int").alias("r"), F.least(green, F.lit(255.0)).cast("int").alias("g"), ((1 - F.col("n")) * 255).cast("int").alias("b"))


def covered_hectares(alpha: DataFrame, cell: float) -> DataFrame:
    """One row: area of the cells whose alpha is above zero."""
    return alpha.agg((F.count_if(F.col("value") > 0) * cell * cell / 1e4).alias("area_ha"))


def pyramid_fill(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Dense grid whose holes take the mean of ever larger 2 x 2 blocks of means."""
    level = cut(dense(cells, meta), "pyramid-0")
    nx, ny, levels = meta.nx, meta.ny, []
    while min(nx, ny) > 2 and not level.where("value is null").isEmpty():
        levels.append(level)
        half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in KEY]
        level = cut(level.select(*half, "value").groupBy(*KEY).agg(F.avg("value").alias("value")), f"pyramid-{len(levels)}")
        nx, ny = (nx + 1) // 2, (ny + 1) // 2
    if not level.where("value is null").isEmpty():
        mean = level.agg(F.avg("value").alias("mean"))
        level = level.crossJoin(F.broadcast(mean)).select(*KEY, F.coalesce("value", "mean").alias("value"))  # one row
    for finer in reversed(levels):
        coarse = level.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("value").alias("coarse"))
        at = (F.floor(F.col("row") / 2) == F.col("r2")) & (F.floor(F.col("col") / 2) == F.col("c2"))
        level = finer.join(coarse, at).select(*KEY, F.coalesce("value", "coarse").alias("value"))
    return level
