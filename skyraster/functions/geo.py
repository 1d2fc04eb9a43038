"""Column builders for coordinates: web mercator, tiles, UTM, similarity, rotation, projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
ORIGIN = math.pi * EARTH
TILE = 256
MAX_LAT = 85.05112878


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- web mercator and tiles -------------------------------------------------------------------


def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * EARTH


def mercator_y(lat) -> Column:
    held = F.least(F.greatest(_c(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    return F.log(F.tan(math.pi / 4 + F.radians(held) / 2)) * EARTH


def mercator_lon(mx) -> Column:
    return F.degrees(_c(mx) / EARTH)


def mercator_lat(my) -> Column:
    return F.degrees(2 * F.atan(F.exp(_c(my) / EARTH)) - math.pi / 2)


def tile_size(zoom) -> Column:
    return 2 * ORIGIN / F.pow(F.lit(2.0), _c(zoom))


def resolution(zoom) -> Column:
    return tile_size(zoom) / TILE


def zoom_for_resolution(metres, low: int = 1, high: int = 19) -> Column:
    best = F.bround(F.log2(2 * ORIGIN / (TILE * _c(metres)))).cast("int")
    return F.when(_c(metres) <= 0, high).otherwise(F.least(F.greatest(best, F.lit(low)), F.lit(high)))


def _held_tile(value: Column, zoom) -> Column:
    return F.least(F.greatest(value.cast("long"), F.lit(0)), (F.pow(F.lit(2.0), _c(zoom)) - 1).cast("long"))


def tile_x(mx, zoom) -> Column:
    return _held_tile(F.floor((_c(mx) + ORIGIN) / tile_size(zoom)), zoom)


def tile_y(my, zoom) -> Column:
    return _held_tile(F.floor((ORIGIN - _c(my)) / tile_size(zoom)), zoom)


def tile_box(tx, ty, zoom) -> dict[str, Column]:
    """west, south, east, north of a tile in mercator metres."""
    size = tile_size(zoom)
    west, north = -ORIGIN + _c(tx) * size, ORIGIN - _c(ty) * size
    return {"west": west, "south": north - size, "east": west + size, "north": north}


def tile_lonlat(tx, ty, zoom) -> dict[str, Column]:
    box = tile_box(tx, ty, zoom)
    return {"west": mercator_lon(box["west"]), "south": mercator_lat(box["south"]), "east": mercator_lon(box["east"]), "north": mercator_lat(box["north"])}


# --- UTM --------------------------------------------------------------------------------------


def utm_zone(lon) -> Column:
    return F.least(F.greatest(F.floor((_c(lon) + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm_epsg(lon, lat) -> Column:
    return F.when(_c(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def _series() -> tuple[float, float, list[float], list[float], list[float]]:
    """n, the rectifying radius, and Krueger's coefficients to the fourth order in n: forward, back, and of latitude (WGS84)."""
    flat = 1 / 298.257223563
    n = flat / (2 - flat)
    forward_ = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    latitude = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return n, EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64), forward_, back, latitude


# The functions that the series takes, by their names for columns.
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, atan2=np.arctan2, sqrt=np.sqrt, radians=np.radians)


def utm_forward(lon, lat, zone: int, south: bool = False, m=F) -> tuple:
    """Easting and northing by Krueger's series, of columns or (m=ARRAYS) of arrays."""
    n, radius, alpha, _, _ = _series()
    lon, lat = (lon, lat) if m is ARRAYS else (_c(lon), _c(lat))
    phi, lam = m.radians(lat), m.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * east, (10_000_000 if south else 0) + 0.9996 * radius * north


def utm_inverse(east: np.ndarray, north: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of arrays of eastings and northings."""
    _, radius, _, beta, delta = _series()
    xi, eta = (north - (10_000_000 if south else 0)) / (0.9996 * radius), (east - 500_000) / (0.9996 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        y = y - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(y), np.cos(x))), np.degrees(phi)


def mercator_to(mx: np.ndarray, my: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of mercator metres in another system."""
    if epsg == 3857:
        return mx, my
    lon, lat = np.degrees(mx / EARTH), np.degrees(2 * np.arctan(np.exp(my / EARTH)) - math.pi / 2)
    if epsg == 4326:
        return lon, lat
    if not is_valid_epsg(epsg):
        raise ValueError(f"EPSG:{epsg} is not supported")
    return utm_forward(lon, lat, epsg % 100, epsg > 32700, ARRAYS)


def to_mercator(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Mercator metres of arrays of coordinates."""
    if epsg == 3857:
        return x, y
    if not is_valid_epsg(epsg):
        raise ValueError(f"EPSG:{epsg} is not supported")
    lon, lat = (x, y) if epsg == 4326 else utm_inverse(x, y, epsg % 100, epsg > 32700)
    return np.radians(lon) * EARTH, np.log(np.tan(math.pi / 4 + np.radians(np.clip(lat, -MAX_LAT, MAX_LAT)) / 2)) * EARTH


def forward(lon, lat, epsg: int | None) -> tuple[Column, Column]:
    """Project coordinates of lon/lat: None (unchanged), 3857, or a UTM zone; others are an error."""
    if epsg is None or epsg == 4326:
        return _c(lon), _c(lat)
    if epsg == 3857:
        return mercator_x(lon), mercator_y(lat)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm_forward(lon, lat, epsg % 100, epsg > 32700)
    raise ValueError(f"EPSG:{epsg} is not supported")


def is_valid_epsg(epsg: int) -> bool:
    return epsg in (3857, 4326) or 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760


def describe_epsg(epsg: int | None) -> str:
    if epsg is None:
        return "Local coordinates"
    if epsg in (3857, 4326):
        return {3857: "WGS 84 / Pseudo-Mercator", 4326: "WGS 84"}[epsg] + f" (EPSG:{epsg})"
    if not is_valid_epsg(epsg):
        raise ValueError(f"EPSG:{epsg} is not supported")
    return f"WGS 84 / UTM zone {epsg % 100}{'S' if epsg > 32700 else 'N'} (EPSG:{epsg})"


# --- similarity, rotation, projection ---------------------------------------------------------


def similarity(scale: float, rotation: Sequence[Sequence[float]], shift: Sequence[float], x="x", y="y", z="z") -> tuple[Column, ...]:
    """scale * R @ (x, y, z) + shift."""
    p = (_c(x), _c(y), _c(z))
    return tuple(scale * (r[0] * p[0] + r[1] * p[1] + r[2] * p[2]) + t for r, t in zip(rotation, shift, strict=True))


def quaternion_rows(w="qw", x="qx", y="qy", z="qz") -> list[list[Column]]:
    """World-to-camera rotation of a unit quaternion."""
    w, x, y, z = map(_c, (w, x, y, z))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def nadir_rows(yaw="yaw", pitch="pitch") -> list[list[Column]]:
    """World-to-camera rotation of a gimbal: heading of the image top, pitch -90 is straight down."""
    psi = F.radians(F.coalesce(_c(yaw), F.lit(0.0)))
    tilt = F.radians(F.coalesce(_c(pitch), F.lit(-90.0)) + 90)
    c, s, ct, st = F.cos(psi), F.sin(psi), F.cos(tilt), F.sin(tilt)
    zero = F.lit(0.0)
    return [[c, -s, zero], [-ct * s, -ct * c, -st], [st * s, st * c, -ct]]


def camera_point(rows: list[list[Column]], x, y, z, tx, ty, tz) -> tuple[Column, ...]:
    """R @ X + t."""
    p = tuple(map(_c, (x, y, z)))
    return tuple(r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + _c(t) for r, t in zip(rows, (tx, ty, tz), strict=True))


def centre(rows: list[list[Column]], tx="tx", ty="ty", tz="tz") -> tuple[Column, ...]:
    """Camera centre: -R' @ t."""
    t = tuple(map(_c, (tx, ty, tz)))
    return tuple(-(rows[0][k] * t[0] + rows[1][k] * t[1] + rows[2][k] * t[2]) for k in range(3))


def pinhole(xc, yc, zc, fx, fy, cx, cy, k1=None) -> tuple[Column, Column]:
    """(u, v) before the camera, null behind; k1: one radial coefficient."""
    xc, yc, zc = map(_c, (xc, yc, zc))
    front = zc > 1e-6
    xn, yn = xc / zc, yc / zc
    d = 1 + _c(k1) * (xn * xn + yn * yn) if k1 is not None else F.lit(1.0)
    return F.when(front, _c(fx) * xn * d + _c(cx)), F.when(front, _c(fy) * yn * d + _c(cy))


def inside(u, v, width, height, margin: float) -> Column:
    u, v, w, h = map(_c, (u, v, width, height))
    return u.between(w * margin, w - w * margin) & v.between(h * margin, h - h * margin)
