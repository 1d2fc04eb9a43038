"""Web tiles: zoom planning, tile cutting, PNG encoding, KML superoverlays."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import geo
from skyraster.operators import warp
from skyraster.schema import RasterMeta


def tiles_in_bounds(spark: SparkSession, west: float, south: float, east: float, north: float, zoom: int, cap: int | None = None) -> DataFrame:
    """(tx, ty) of the tiles that meet a mercator rectangle, row by row; ``cap`` keeps the first."""
    size, last = 2 * geo.ORIGIN / (1 << zoom), (1 << zoom) - 1
    hold = lambda v: min(max(math.floor(v), 0), last)
    x0, x1 = hold((west + geo.ORIGIN) / size), hold((east + geo.ORIGIN) / size)
    y0, y1 = hold((geo.ORIGIN - north) / size), hold((geo.ORIGIN - south) / size)
    wide = x1 - x0 + 1
    out = spark.range(wide * (y1 - y0 + 1)).select((F.col("id") % wide + x0).alias("tx"), (F.floor(F.col("id") / wide) + y0).cast("long").alias("ty"))
    return out.orderBy("ty", "tx").limit(cap) if cap is not None else out


def zoom_range(width_px: int, west: float, south: float, east: float, north: float, low: int | None = None, high: int | None = None) -> tuple[int, int]:
    """Zoom of the raster's own resolution, down to the one where it still fills a tile."""
    if high is None:
        high = min(max(round(math.log2(2 * geo.ORIGIN / (geo.TILE * (east - west) / width_px))), 1), 22)
    if low is None:
        low = max(min(int(math.log2(2 * geo.ORIGIN / max(east - west, north - south))), high), 1)
    return (low, high) if low <= high else (high, low)


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image as PNG."""
    h, w, _ = rgba.shape
    lines = np.zeros((h, 1 + 4 * w), np.uint8)
    lines[:, 1:] = rgba.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The pixels of a PNG written by ``png``."""
    w, h = struct.unpack(">II", data[16:24])
    body, at = b"", 8
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)


def targets(spark: SparkSession, box: tuple[float, float, float, float], zooms: tuple[int, int]) -> DataFrame:
    """(z, x, y, west, north, res) of the tiles that meet a mercator rectangle (west, south, east, north)."""
    rows = None
    for z in range(zooms[0], zooms[1] + 1):
        some = tiles_in_bounds(spark, *box, z).select(F.lit(z).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"))
        rows = some if rows is None else rows.unionByName(some)
    place = geo.tile_box("x", "y", "z")
    return rows.select("z", "x", "y", place["west"].alias("west"), place["north"].alias("north"), geo.resolution("z").alias("res"))


def cut_tiles(cells: DataFrame, meta: RasterMeta, zooms: tuple[int, int]) -> DataFrame:
    """(z, x, y, png) of a colour raster (row, col, red, green, blue, alpha): bilinear, alpha as weight; wholly transparent tiles are left out."""
    drawn = warp.warp(cells, meta, targets(cells.sparkSession, warp.bounds(meta), zooms), warp.levels_for(meta, 2 * geo.ORIGIN / (geo.TILE << zooms[0])))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [png(np.frombuffer(x, np.uint8).reshape(geo.TILE, geo.TILE, 4)) for x in batch["pixels"]]
            yield pd.DataFrame({"z": batch["z"], "x": batch["x"], "y": batch["y"], "png": images})

    return drawn.mapInPandas(pack, "z int, x long, y long, png binary")


def children(tiles: DataFrame) -> DataFrame:
    """(z, x, y, cx, cy): each tile with its existing children."""
    below = tiles.select((F.col("z") - 1).alias("z"), F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return tiles.select("z", "x", "y").join(below, ["z", "x", "y"])


def _box(tx, ty, z) -> dict[str, Column]:
    return {k: F.format_string("%.10f", v) for k, v in geo.tile_lonlat(tx, ty, z).items()}


def _corners(box: dict[str, Column]) -> Column:
    return F.concat(*[p for k in ("north", "south", "east", "west") for p in (F.lit(f"<{k}>"), box[k], F.lit(f"</{k}>"))])


def _region(box: dict[str, Column], low, high) -> Column:
    return F.concat(F.lit("<Region><LatLonAltBox>"), _corners(box), F.lit("</LatLonAltBox><Lod><minLodPixels>"), F.lit(low).cast("string") if not isinstance(low, Column) else low.cast("string"),
                    F.lit("</minLodPixels><maxLodPixels>"), F.lit(high).cast("string") if not isinstance(high, Column) else high.cast("string"), F.lit("</maxLodPixels></Lod></Region>"))


def _link(z, x, y, low: int, up: str) -> Column:
    name = F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))
    return F.concat(F.lit("<NetworkLink><name>"), name, F.lit("</name>"), _region(_box(x, y, z), low, -1), F.lit(f"<Link><href>{up}"), name,
                    F.lit(".kml</href><viewRefreshMode>onRegion</viewRefreshMode></Link></NetworkLink>"))


def kml(tiles: DataFrame, low: int, high: int, title: str = "Orthomosaic") -> DataFrame:
    """(path, kml): one document a tile, with links to its children, and doc.kml with the coarsest."""
    head = lambda name: F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document><name>'), name, F.lit("</name>"))
    links = children(tiles).withColumn("cz", F.col("z") + 1).withColumn("link", _link(F.col("cz"), F.col("cx"), F.col("cy"), 64, "../../"))
    links = links.groupBy("z", "x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("cx", "cy", "link"))), lambda s: s["link"]).alias("links"))  # four at most
    rows = tiles.select("z", "x", "y").join(links, ["z", "x", "y"], "left")
    zs, xs, ys = (F.col(c).cast("string") for c in "zxy")
    box = _box("x", "y", "z")
    overlay = F.concat(F.lit("<GroundOverlay><drawOrder>"), zs, F.lit("</drawOrder><Icon><href>"), ys, F.lit(".png</href></Icon><LatLonBox>"), _corners(box), F.lit("</LatLonBox></GroundOverlay>"))
    region = _region(box, F.when(F.col("z") > low, 64).otherwise(0), F.when(F.col("z") == high, -1).otherwise(2048))
    body = F.concat_ws("\n", F.array(head(F.concat_ws("/", zs, xs, ys)), region, overlay), F.coalesce("links", F.expr("cast(array() as array<string>)")), F.lit("</Document></kml>"))
    each = rows.select(F.concat(F.concat_ws("/", zs, xs, ys), F.lit(".kml")).alias("path"), body.alias("kml"))
    roots = tiles.where(F.col("z") == low).withColumn("link", _link(F.col("z"), F.col("x"), F.col("y"), 0, ""))
    links = roots.agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "x", "y", "link"))), lambda s: s["link"]).alias("links"))  # the coarsest zoom: a few tiles
    doc = links.select(F.lit("doc.kml").alias("path"), F.concat_ws("\n", F.array(head(F.lit(title))), "links", F.lit("</Document></kml>")).alias("kml"))
    return each.unionByName(doc)


def per_zoom(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"))
