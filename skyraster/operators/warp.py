"""Colour rasters in web mercator by inverse sampling: web tiles and previews.

Each target tile works out where its pixels lie in the source, asks for the source blocks that they touch (with
a cell of margin), and interpolates between the four nearest cells. Blocks come from the overview that has one to
two cells a target pixel, so that a tile of any zoom touches a few blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.functions import geo
from skyraster.operators import blocks
from skyraster.schema import RasterMeta

BANDS = ["red", "green", "blue", "alpha"]
_KEY = "z int, x long, y long"
_PLACE = f"{_KEY}, west double, north double, res double"


def bounds(meta: RasterMeta) -> tuple[float, float, float, float]:
    """west, south, east, north of a raster in mercator metres, its edges followed in steps."""
    if meta.epsg is None:
        raise ValueError("the raster has no coordinate system: georeference the project first")
    t = np.linspace(0, 1, 23)
    x, y = meta.minx + t * (meta.maxx - meta.minx), meta.miny + t * (meta.maxy - meta.miny)
    ends = np.ones(len(t))
    mx, my = geo.to_mercator(np.concatenate([x, x, ends * meta.minx, ends * meta.maxx]), np.concatenate([ends * meta.miny, ends * meta.maxy, y, y]), meta.epsg)
    return float(mx.min()), float(my.min()), float(mx.max()), float(my.max())


def _spot(meta: RasterMeta, west: float, north: float, res: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col), in cells of the source from its corner, of the centres of a tile's pixels."""
    step = (np.arange(size) + 0.5) * res
    mx, my = np.meshgrid(west + step, north - step)
    x, y = geo.mercator_to(mx, my, meta.epsg)
    return (meta.maxy - y) / meta.cell, (x - meta.minx) / meta.cell


def _level(row: np.ndarray, col: np.ndarray, most: int) -> int:
    """The overview with one to two cells a pixel."""
    n = row.shape[0] - 1
    ratio = (np.hypot(row[-1, 0] - row[0, 0], col[-1, 0] - col[0, 0]) + np.hypot(row[0, -1] - row[0, 0], col[0, -1] - col[0, 0])) / 2 / n
    return min(max(math.floor(math.log2(ratio) + 1e-9), 0), most)


def _at_level(meta: RasterMeta, level: int) -> RasterMeta:
    nx, ny = meta.nx, meta.ny
    for _ in range(level):
        nx, ny = (nx + 1) // 2, (ny + 1) // 2
    return RasterMeta(meta.minx, meta.maxy, meta.cell * 2**level, nx, ny, meta.epsg)


def _halved(block: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 cells: colours weighted by alpha, which counts the cells that there are."""
    _, h, w = block.shape
    wide = np.zeros((len(block), h + h % 2, w + w % 2))
    wide[:, :h, :w] = block
    there = np.zeros(wide.shape[1:])
    there[:h, :w] = 1
    four = lambda a: a.reshape(*a.shape[:-2], a.shape[-2] // 2, 2, a.shape[-1] // 2, 2).sum((-3, -1))
    alpha, n = four(wide[3]), four(there)
    out = np.concatenate([four(wide[:3] * wide[3]) / np.maximum(alpha, 1), (alpha / n)[None]])
    return np.rint(out)


def pyramid(cells: DataFrame, meta: RasterMeta, most: int) -> DataFrame:
    """(level, br, bc, data): blocks of bytes of a colour raster (row, col, BANDS) and of its overviews."""
    raw = blocks.pack(cells.select("row", "col", *BANDS), meta, BANDS)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["data"] = [np.clip(np.rint(np.nan_to_num(np.frombuffer(x))), 0, 255).astype(np.uint8).tobytes() for x in batch["data"]]
            yield batch[["br", "bc", "data"]]

    level = raw.mapInPandas(shrink, blocks.BLOCKS)
    out = level.select(F.lit(0).alias("level"), "br", "bc", "data")
    for k in range(1, most + 1):
        level = _coarser(level, _at_level(meta, k - 1), _at_level(meta, k))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "br", "bc", "data"))
    return out


def _coarser(level: DataFrame, below: RasterMeta, here: RasterMeta) -> DataFrame:
    """Blocks of the next overview: each block is halved where it is, and four quarters are put together."""
    half = blocks.SIDE // 2

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for br, bc, data in zip(batch["br"], batch["bc"], batch["data"], strict=True):
                h, w = blocks.spans(below, br, bc)[2:]
                rows.append((br // 2, bc // 2, br % 2, bc % 2, _halved(np.frombuffer(data, np.uint8).reshape(4, h, w).astype(float)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["br", "bc", "down", "right", "data"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(rows["br"].iloc[0]), int(rows["bc"].iloc[0])
        h, w = blocks.spans(here, br, bc)[2:]
        block = np.zeros((4, h, w), np.uint8)
        for x in rows.itertuples():
            r, c = x.down * half, x.right * half
            n, m = min(half, h - r), min(half, w - c)
            block[:, r : r + n, c : c + m] = np.frombuffer(x.data, np.uint8).reshape(4, n, m)
        return pd.DataFrame({"br": [br], "bc": [bc], "data": [block.tobytes()]})

    return level.mapInPandas(halve, "br long, bc long, down int, right int, data binary").groupBy("br", "bc").applyInPandas(join, blocks.BLOCKS)


def _drawn(source: dict[tuple[int, int], np.ndarray], meta: RasterMeta, row: np.ndarray, col: np.ndarray, level: int) -> np.ndarray:
    """RGBA pixels at (row, col) of the full raster, from the blocks of a level."""
    here = _at_level(meta, level)
    inside = (row >= 0) & (row < meta.ny) & (col >= 0) & (col < meta.nx)
    out = np.zeros((*row.shape, 4), np.uint8)
    if not inside.any():
        return out
    r, c = row[inside] / 2**level - 0.5, col[inside] / 2**level - 0.5
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    low_r, low_c = max(int(r0.min()), 0), max(int(c0.min()), 0)
    window = np.zeros((4, min(int(r0.max()) + 2, here.ny) - low_r, min(int(c0.max()) + 2, here.nx) - low_c))
    for (br, bc), block in source.items():
        br0, bc0, h, w = blocks.spans(here, br, bc)
        a, b, x, y = max(br0, low_r), min(br0 + h, low_r + window.shape[1]), max(bc0, low_c), min(bc0 + w, low_c + window.shape[2])
        if a < b and x < y:
            window[:, a - low_r : b - low_r, x - low_c : y - low_c] = block[:, a - br0 : b - br0, x - bc0 : y - bc0]
    weight, alpha, colour = np.zeros(len(r)), np.zeros(len(r)), np.zeros((3, len(r)))
    for dr in (0, 1):
        for dc in (0, 1):
            i, j = r0 + dr, c0 + dc
            ok = (i >= 0) & (i < here.ny) & (j >= 0) & (j < here.nx)
            w = np.where(ok, np.abs(1 - dr - (r - r0)) * np.abs(1 - dc - (c - c0)), 0.0)
            cell = window[:, np.clip(i - low_r, 0, window.shape[1] - 1), np.clip(j - low_c, 0, window.shape[2] - 1)]
            weight, alpha, colour = weight + w, alpha + w * cell[3], colour + w * cell[3] * cell[:3]
    out[inside] = np.rint(np.concatenate([np.where(alpha > 0, colour / np.where(alpha > 0, alpha, 1), 0), (alpha / weight)[None]])).T
    return out


def warp(cells: DataFrame, meta: RasterMeta, targets: DataFrame, most: int, size: int = geo.TILE) -> DataFrame:
    """(z, x, y, pixels) of targets (z, x, y, west, north, res): size x size RGBA bytes; wholly transparent ones are left out."""
    if meta.epsg is None:
        raise ValueError("the raster has no coordinate system: georeference the project first")
    most = min(most, math.ceil(math.log2(max(meta.nx, meta.ny, 1))))

    def touched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.itertuples(index=False):
                row, col = _spot(meta, t.west, t.north, t.res, size)
                level = _level(row, col, most)
                here, inside = _at_level(meta, level), (row >= 0) & (row < meta.ny) & (col >= 0) & (col < meta.nx)
                if not inside.any():
                    continue
                span = []
                for v, n in ((row[inside], here.ny), (col[inside], here.nx)):
                    low, high = math.floor(v.min() / 2**level - 0.5), math.floor(v.max() / 2**level - 0.5) + 1
                    span.append(range(max(low, 0) // blocks.SIDE, min(high, n - 1) // blocks.SIDE + 1))
                rows += [(*t, level, br, bc) for br in span[0] for bc in span[1]]
            yield pd.DataFrame(rows, columns=[*batch.columns, "level", "br", "bc"])

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        level = int(first["level"])
        here = _at_level(meta, level)
        source = {(x.br, x.bc): np.frombuffer(x.data, np.uint8).reshape(4, *blocks.spans(here, x.br, x.bc)[2:]) for x in rows.itertuples()}
        pixels = _drawn(source, meta, *_spot(meta, first["west"], first["north"], first["res"], size), level)
        keys = {c: rows[c].iloc[:1] for c in ("z", "x", "y")}
        return pd.DataFrame({**keys, "pixels": [pixels.tobytes()]}) if pixels[..., 3].any() else pd.DataFrame({"z": [], "x": [], "y": [], "pixels": []})

    wanted = targets.select("z", "x", "y", "west", "north", "res").mapInPandas(touched, f"{_PLACE}, level int, br long, bc long")
    asked = wanted.join(pyramid(cells, meta, most), ["level", "br", "bc"])
    return asked.groupBy("z", "x", "y").applyInPandas(draw, f"{_KEY}, pixels binary")


def levels_for(meta: RasterMeta, res: float) -> int:
    """Overviews that targets of a resolution in mercator metres may ask for."""
    west, south, east, north = bounds(meta)
    ratio = res / max(min((east - west) / meta.nx, (north - south) / meta.ny), 1e-12)
    return max(0, math.ceil(math.log2(max(ratio, 1))) + 1)


def preview(cells: DataFrame, meta: RasterMeta, max_dim: int = 1400) -> tuple[DataFrame, RasterMeta]:
    """(row, col, BANDS) in web mercator, with at most about ``max_dim`` pixels a side, and where they lie.

    Pixels are as wide as those of the thinned source, measured along the raster's diagonal.
    """
    west, south, east, north = bounds(meta)
    scale = max(max(meta.nx, meta.ny) / max_dim, 1.0)
    w, h = max(int(meta.nx / scale), 1), max(int(meta.ny / scale), 1)
    res = math.hypot(east - west, north - south) / math.hypot(w, h)
    target = RasterMeta(west, north, res, max(math.ceil((east - west) / res - 1e-9), 1), max(math.ceil((north - south) / res - 1e-9), 1), 3857)
    down, wide = -(-target.ny // geo.TILE), -(-target.nx // geo.TILE)
    i = F.col("id")
    tiles = cells.sparkSession.range(down * wide).select(F.lit(0).alias("z"), (i % wide).alias("x"), F.floor(i / wide).cast("long").alias("y"))
    side = geo.TILE * res
    drawn = warp(cells, meta, tiles.select("*", (west + F.col("x") * side).alias("west"), (north - F.col("y") * side).alias("north"), F.lit(res).alias("res")), levels_for(meta, res))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, data in zip(batch["x"], batch["y"], batch["pixels"], strict=True):
                image = np.frombuffer(data, np.uint8).reshape(geo.TILE, geo.TILE, 4)
                r, c = np.nonzero(image[..., 3])
                found = image[r, c]
                yield pd.DataFrame({"row": r + y * geo.TILE, "col": c + x * geo.TILE, **{n: found[:, k].astype(np.int32) for k, n in enumerate(BANDS)}})

    return drawn.mapInPandas(rows, "row long, col long, red int, green int, blue int, alpha int"), target
