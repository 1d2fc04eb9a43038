"""Neighbourhood filters on dense grids: opening, median, Gaussian, ground and projection surfaces.

All of them work on blocks with a margin (``blocks.filtered``), so that a task holds one block, however
large the grid. Edges mirror: the edge cell is repeated. Of an opening that is the same as cutting the frame off.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.operators import blocks, grid
from skyraster.plans.tables import cut
from skyraster.schema import RasterMeta

Filter = Callable[[np.ndarray, int, int], np.ndarray]


def _opened(meta: RasterMeta, w: int) -> Filter:
    """Opening of a window that has 2w more cells on all sides."""

    def f(window: np.ndarray, row: int, col: int) -> np.ndarray:
        low = blocks.running(blocks.running(window, 2 * w + 1, np.fmin, 1), 2 * w + 1, np.fmin, 2)
        r, c = (np.arange(n) + first - w for n, first in zip(low.shape[1:], (row, col), strict=True))
        low[:, (r < 0) | (r >= meta.ny)] = np.nan  # outside the grid there is nothing to grow from
        low[:, :, (c < 0) | (c >= meta.nx)] = np.nan
        return blocks.running(blocks.running(low, 2 * w + 1, np.fmax, 1), 2 * w + 1, np.fmax, 2)

    return f


def _median(meta: RasterMeta, size: int) -> Filter:
    h = size // 2

    def f(window: np.ndarray, row: int, col: int) -> np.ndarray:
        whole = blocks.mirrored(window, meta, row, col, h)
        n, m = whole.shape[1] - 2 * h, whole.shape[2] - 2 * h
        around = np.stack([whole[:, a : a + n, b : b + m] for a in range(size) for b in range(size)])
        return np.partition(around, size * size // 2, axis=0)[size * size // 2]

    return f


def _gaussian(meta: RasterMeta, sigma: float) -> tuple[int, Filter]:
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]

    def f(window: np.ndarray, row: int, col: int) -> np.ndarray:
        whole = np.nan_to_num(blocks.mirrored(window, meta, row, col, reach))
        n, m = whole.shape[1] - 2 * reach, whole.shape[2] - 2 * reach
        flat = sum(w * whole[:, :, k : k + m] for k, w in enumerate(weights))
        return sum(w * flat[:, k : k + n] for k, w in enumerate(weights))

    return reach, f


def _cells(cells: DataFrame, meta: RasterMeta, reach: int, f: Filter, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    packed = blocks.pack(cells, meta, list(columns))
    return blocks.unpack(blocks.filtered(packed, meta, reach, f, len(columns)), meta, list(columns))


def opening(cells: DataFrame, meta: RasterMeta, w: int) -> DataFrame:
    """Grey opening by a (2w+1) square."""
    return _cells(cells, meta, 2 * w, _opened(meta, w))


def median(cells: DataFrame, meta: RasterMeta, size: int = 3) -> DataFrame:
    """Median over a size x size square."""
    return _cells(cells, meta, size // 2, _median(meta, size))


def gaussian(cells: DataFrame, meta: RasterMeta, sigma: float, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Gaussian blur of dense columns, cut off at four sigmas."""
    return _cells(cells, meta, *_gaussian(meta, sigma), columns)


def smooth_valid(cells: DataFrame, meta: RasterMeta, sigma: float = 1.0) -> DataFrame:
    """Blur of the valid cells only: blurred values over blurred weights; other cells go."""
    reach, blur = _gaussian(meta, sigma)

    def f(window: np.ndarray, row: int, col: int) -> np.ndarray:
        both = blur(np.concatenate([window, (~np.isnan(window)).astype(float)]), row, col)
        inner = window[:, reach : window.shape[1] - reach, reach : window.shape[2] - reach]
        return np.where(np.isnan(inner), np.nan, both[:1] / np.maximum(both[1:], 1e-9))

    return _cells(cells.where("value is not null"), meta, reach, f).where("value is not null")


def knock_out(cells: DataFrame, meta: RasterMeta, height: float = 15.0, size: int = 9) -> DataFrame:
    """Cells without those that tower over the median of their (filled) neighbourhood."""
    valid = cells.where("value is not null")
    if valid.isEmpty():
        return valid.select("row", "col", "value")
    full = blocks.nearest(blocks.pack(valid, meta, ["value"]), meta)
    around = blocks.unpack(blocks.filtered(full, meta, size // 2, _median(meta, size)), meta, ["around"])
    return cells.join(around, ["row", "col"]).where(F.col("value") - F.col("around") <= height).select("row", "col", "value")


def projection_surface(points: DataFrame, cell: float, frame: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, RasterMeta]:
    """Smooth top surface (dense) for orthorectification, at 1 m or coarser."""
    if frame is not None:
        points = points.where(F.col("x").between(frame[0], frame[2]) & F.col("y").between(frame[1], frame[3]))
    meta = grid.plan(points, max(cell, 1.0), frame)
    cells = knock_out(cut(grid.binned(points, meta, "max"), "top"), meta)
    full = blocks.pack(grid.pyramid_fill(cells, meta), meta, ["value"])
    opened = blocks.filtered(full, meta, 4, _opened(meta, 2))
    return blocks.unpack(blocks.filtered(opened, meta, 1, _median(meta, 3)), meta, ["value"]), meta


def ground_cell(points: DataFrame) -> float:
    """Cell of the ground filter from the point spacing."""
    return min(max(4 * grid.mean_spacing(points).first().spacing, 0.5), 3.0)


def ground_surface(points: DataFrame, meta: RasterMeta, max_window: int = 33, slope: float = 0.15, base: float = 0.25, max_drop: float = 2.5) -> DataFrame:
    """Progressive morphological filter: cells that drop too far at a scale take the opened height.

    Blocks stay packed from round to round; a round is one exchange of margins.
    """
    lowest = grid.binned(points, meta, "min")
    if lowest.isEmpty():
        raise ValueError("no points to filter")
    surface = blocks.nearest(blocks.pack(lowest, meta, ["value"]), meta)
    w = 1
    while w <= max_window:

        def lower(window: np.ndarray, row: int, col: int, w: int = w, limit: float = min(base + slope * (w * meta.cell), max_drop)) -> np.ndarray:
            n, m = window.shape[1] - 4 * w, window.shape[2] - 4 * w
            here, opened = window[:, 2 * w : 2 * w + n, 2 * w : 2 * w + m], _opened(meta, w)(window, row, col)
            return np.where(here - opened > limit, opened, here)

        surface = blocks.filtered(surface, meta, 2 * w, lower)
        w *= 2
    return blocks.unpack(blocks.filtered(surface, meta, 1, _median(meta, 3)), meta, ["value"])


def height_above(points: DataFrame, surface: DataFrame, meta: RasterMeta) -> DataFrame:
    """Adds ``hag``: z above the surface's cell."""
    cells = surface.withColumnRenamed("value", "_ground")
    return grid.indexed(points, meta).join(cells, ["row", "col"]).withColumn("hag", F.col("z") - F.col("_ground")).drop("_ground", "row", "col")
