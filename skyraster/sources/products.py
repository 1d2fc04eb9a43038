"""Product files from finished tables: shapefiles, meshes, tiles, and rasters, whose tiles are packed on executors."""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.functions import geo
from skyraster.operators import tiles, warp
from skyraster.plans.tables import cut, drop
from skyraster.schema import RasterMeta
from skyraster.sources import binary, files, text_models

TILE = 256


def write_shapefile(contours: DataFrame, path: str, epsg: int | None = None) -> int:
    """POLYLINEZ with ELEV and INDEX; returns the number of lines. Lines stream one partition at a time."""
    shapes, records, index = [], [], []
    box = [np.inf, np.inf, -np.inf, -np.inf]
    heights = [np.inf, -np.inf]
    at = 50
    for r in contours.orderBy("level", "line_id").toLocalIterator():
        xy = np.array([(p.x, p.y) for p in r.coords])
        low, high = xy.min(0), xy.max(0)
        box = [min(box[0], low[0]), min(box[1], low[1]), max(box[2], high[0]), max(box[3], high[1])]
        heights = [min(heights[0], r.level), max(heights[1], r.level)]
        z = np.full(len(xy), r.level)
        body = struct.pack("<i4dii", 13, *low, *high, 1, len(xy)) + struct.pack("<i", 0) + xy.astype("<f8").tobytes()
        body += struct.pack("<2d", r.level, r.level) + z.astype("<f8").tobytes() + struct.pack("<2d", 0.0, 0.0) + np.zeros(len(xy)).tobytes()
        shapes.append(struct.pack(">ii", len(shapes) + 1, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += 4 + len(body) // 2
        records.append(f" {r.level:20.3f}{int(r.is_index):>10d}".encode())
    if not shapes:
        box, heights = [0.0] * 4, [0.0, 0.0]

    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 13, *box, *heights, 0.0, 0.0)

    base, spark = os.path.splitext(path)[0], contours.sparkSession
    files.write(spark, f"{base}.shp", head(at) + b"".join(shapes))
    files.write(spark, f"{base}.shx", head(50 + 4 * len(index)) + b"".join(index))
    fields = b"".join(name.ljust(11, b"\x00") + b"N" + b"\x00" * 4 + bytes([size, places]) + b"\x00" * 14 for name, size, places in ((b"ELEV", 20, 3), (b"INDEX", 10, 0)))
    dbf = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(records), 32 + len(fields) + 1, 31) + fields + b"\r" + b"".join(records) + b"\x1a"
    files.write(spark, f"{base}.dbf", dbf)
    if epsg:
        files.write(spark, f"{base}.prj", f"EPSG:{epsg}".encode())
    return len(shapes)


def write_contours(contours: DataFrame, folder: str, name: str, epsg: int | None = None, formats: tuple[str, ...] = ("shp", "dxf", "geojson")) -> list[str]:
    done, spark = [], contours.sparkSession
    for kind in formats:
        path = f"{folder}/{name}.{kind}"
        if kind == "shp":
            write_shapefile(contours, path, epsg)
        elif kind == "dxf":
            files.write(spark, path, text_models.dxf_pieces(contours))
        elif kind == "geojson":
            files.write(spark, path, text_models.geojson_pieces(contours, epsg))
        else:
            raise ValueError(f"unknown contour format {kind}")
        done.append(path)
    return done


def write_mesh(verts: DataFrame, faces: DataFrame, path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), epsg: int | None = None) -> None:
    """OBJ with vertex colours, and the offset in a file beside it."""
    note = f"{offset[0]:.3f} {offset[1]:.3f} {offset[2]:.3f}"
    spark = verts.sparkSession

    def pieces() -> Iterator[bytes]:
        yield f"# mesh with vertex colours\n# add to vertices: {note}\n".encode()
        yield from files.lines(text_models.mesh_lines(verts, faces, offset), "part", "pos", "value")

    files.write(spark, path, pieces())
    files.write(spark, os.path.splitext(path)[0] + "_offset.txt", (note + "\n" + (f"EPSG:{epsg}\n" if epsg else "")).encode())


def _tiles(cells: DataFrame, meta: RasterMeta, bands: list[str], dtype: np.dtype, nodata: float | None, predictor: int) -> DataFrame:
    """(k, data): compressed tiles of a grid, each made where its cells are; tiles without cells are left out."""
    empty = np.nan if dtype.kind == "f" and nodata is None else nodata or 0
    across = -(-meta.nx // TILE)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full((TILE, TILE, len(bands)), empty, dtype)
        r, c = (rows[x].to_numpy() % TILE for x in ("row", "col"))
        for b, name in enumerate(bands):
            v = rows[name].to_numpy(float)
            ok = np.isfinite(v)
            top = v[ok] if dtype.kind == "f" else np.clip(np.rint(v[ok]), np.iinfo(dtype).min, np.iinfo(dtype).max)
            block[r[ok], c[ok], b] = top
        return pd.DataFrame({"k": rows["k"].iloc[:1], "data": [binary.packed_tile(block, TILE, predictor)]})

    at = (F.floor(F.col("row") / TILE) * across + F.floor(F.col("col") / TILE)).cast("long")
    return cells.select(at.alias("k"), "row", "col", *[F.col(b).cast("double").alias(b) for b in bands]).groupBy("k").applyInPandas(pack, "k long, data binary")


def _halved(cells: DataFrame, bands: list[str], dtype: np.dtype) -> DataFrame:
    """Means of 2 x 2 cells that have a value."""
    half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in ("row", "col")]
    mean = (lambda b: F.avg(b)) if dtype.kind == "f" else (lambda b: F.rint(F.avg(b)))
    return cells.select(*half, *bands).groupBy("row", "col").agg(*[mean(b).alias(b) for b in bands])


def write_grid(cells: DataFrame, meta: RasterMeta, path: str, bands: list[str], dtype: str, nodata: float | None = None, predictor: int = 1, overviews: int = 0) -> str:
    """A grid as a GeoTIFF: tiles are packed on executors; here pass by their sizes, then one tile after the other."""
    kind = np.dtype(dtype)
    binary.check_predictor(kind, predictor)
    empty = np.full((1, 1, len(bands)), np.nan if kind.kind == "f" and nodata is None else nodata or 0, kind)
    blank = binary.packed_tile(np.broadcast_to(empty, (TILE, TILE, len(bands))), TILE, predictor)
    sizes, tables, nx, ny = [], [], meta.nx, meta.ny
    for level in range(overviews + 1):
        cells = cells if level == 0 else _halved(cells, bands, kind)
        made = cut(_tiles(cells, RasterMeta(0.0, 0.0, 1.0, nx, ny), bands, kind, nodata, predictor), "raster-tiles")
        lengths = np.full(-(-nx // TILE) * -(-ny // TILE), len(blank))
        for r in made.select("k", F.length("data").alias("n")).toLocalIterator():
            lengths[r.k] = r.n
        sizes.append((nx, ny, lengths.tolist()))
        tables.append(made)
        nx, ny = (nx + 1) // 2, (ny + 1) // 2
    head = binary.tiff_head(sizes, kind, len(bands), meta.minx, meta.maxy, meta.cell, meta.epsg, nodata, TILE, predictor, None)

    def pieces() -> Iterator[bytes]:
        yield head
        for (_, _, lengths), made in zip(reversed(sizes), reversed(tables), strict=True):
            at = 0
            for r in made.orderBy("k").toLocalIterator():
                yield from [blank] * (r.k - at)
                yield bytes(r.data)
                at = r.k + 1
            yield from [blank] * (len(lengths) - at)

    done = files.write(cells.sparkSession, path, pieces())
    for made in tables:
        drop(made)
    return done


def write_raster(cells: DataFrame, meta: RasterMeta, path: str, dtype: str = "float32", nodata: float | None = None) -> str:
    """One band as a tiled GeoTIFF."""
    return write_grid(cells, meta, path, ["value"], dtype, nodata)


def write_ortho(cells: DataFrame, meta: RasterMeta, path: str) -> str:
    return write_grid(cells, meta, path, [c for c in ("red", "green", "blue", "alpha") if c in cells.columns], "uint8")


def write_cog(cells: DataFrame, meta: RasterMeta, path: str, dtype: str = "float32", nodata: float | None = None) -> str:
    """One band with its overviews, halved down to one tile, in one file that readers of byte ranges can use."""
    overviews = max(0, math.ceil(math.log2(max(meta.nx, meta.ny) / TILE)))
    return write_grid(cells, meta, path, ["value"], dtype, nodata, 3 if dtype.startswith("f") else 2, overviews)


def write_tiles(cells: DataFrame, meta: RasterMeta, folder: str, zooms: tuple[int, int] | None = None, kml: bool = True, title: str = "Orthomosaic") -> dict:
    """z/x/y.png of a colour raster, tiles.json and, if asked, the KML overlay. Tiles are written where they are drawn."""
    box = warp.bounds(meta)
    zooms = zooms or tiles.zoom_range(meta.nx, *box)
    spark = cells.sparkSession
    made = cut(tiles.cut_tiles(cells, meta, zooms), "web-tiles")
    files.write_each(made.select(F.concat_ws("/", "z", "x", F.concat(F.col("y").cast("string"), F.lit(".png"))).alias("path"), F.col("png").alias("data")), folder)
    n = made.count()
    found = {"format": "xyz", "min_zoom": zooms[0], "max_zoom": zooms[1], "tiles": n, "bounds_3857": list(box), "tile_size": geo.TILE}
    files.write(spark, f"{folder}/tiles.json", json.dumps(found, indent=2).encode())
    if kml and n:
        overlay = tiles.kml(made.select("z", "x", "y"), *zooms, title)
        files.write_each(overlay.select("path", F.col("kml").cast("binary").alias("data")), folder)
    drop(made)
    return found
