"""Binary sources and sinks as Python data sources: LAS, PLY, GeoTIFF; and photo headers.

Readers open files where the task runs, so paths must be reachable from every executor (a
mounted store); ``binaryFile`` readers go through Spark's own file systems.
"""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyraster.sources import files

RECORDS = 500_000


# --- LAS --------------------------------------------------------------------------------------

_LAS3 = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])
# Record lengths of point formats 0..3 and where their colours start.
_LAS_FORMATS = {0: (20, None), 1: (28, None), 2: (26, 20), 3: (34, 28)}


def las_header(path: str) -> dict:
    with open(path, "rb") as f:
        h = f.read(227)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    start, _, kind, size, n = struct.unpack_from("<IIBHI", h, 96)
    scale, offset = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    if kind & 0x3F not in _LAS_FORMATS:
        raise ValueError(f"point format {kind} is not supported")
    return {"start": start, "kind": kind & 0x3F, "size": size, "n": n, "scale": scale, "offset": offset}


def las_records(xyz: np.ndarray, rgb: np.ndarray, cls: np.ndarray, offset: np.ndarray) -> bytes:
    """Records of point format 3 in millimetre steps from an offset."""
    steps = np.rint((xyz - offset) / 0.001).astype("<i4")
    out = np.zeros(len(xyz), _LAS3)
    for k, c in enumerate("xyz"):
        out[c] = steps[:, k]
    for k, c in enumerate("rgb"):
        out[c] = rgb[:, k].astype(np.uint16) * 257
    out["cls"] = cls
    return out.tobytes()


def las_head(n: int, low: np.ndarray, high: np.ndarray) -> bytes:
    """Header of a LAS 1.2 file of n points between two corners."""
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<IIBHI", head, 96, 227, 0, 3, _LAS3.itemsize, n)
    struct.pack_into("<I", head, 111, n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, *low)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(head)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Range]:
        n = las_header(self.path)["n"]
        return [_Range(self.path, a, min(RECORDS, n - a)) for a in range(0, n, RECORDS)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h = las_header(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(h["start"] + partition.first * h["size"])
            raw = np.frombuffer(f.read(partition.n * h["size"]), np.uint8).reshape(-1, h["size"])
        size, color = _LAS_FORMATS[h["kind"]]
        xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(float) * h["scale"] + h["offset"]
        rgb = np.ascontiguousarray(raw[:, color : color + 6]).view("<u2") // 257 if color else np.zeros((len(raw), 3), np.uint16)
        cls = raw[:, 15] & 31
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(partition.first, partition.first + len(raw))), *[pa.array(xyz[:, k]) for k in range(3)], *[pa.array(rgb[:, k].astype(np.int16)) for k in range(3)], pa.array(cls.astype(np.int8))],
            names=["pt_id", "x", "y", "z", "r", "g", "b", "cls"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "pt_id long, x double, y double, z double, r short, g short, b short, cls byte"

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"])


# --- PLY --------------------------------------------------------------------------------------

_PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
              "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(content: bytes) -> tuple[pd.DataFrame, np.ndarray]:
    """(vertices, faces) of an ASCII or binary PLY; missing colours are (200, 200, 200)."""
    end = content.index(b"end_header")
    head = content[:end].decode("ascii", "replace").splitlines()
    body = content[content.index(b"\n", end) + 1 :]
    form, elements = "ascii", []
    for line in head:
        t = line.split()
        if t[:1] == ["format"]:
            form = t[1]
        elif t[:1] == ["element"]:
            elements.append((t[1], int(t[2]), []))
        elif t[:1] == ["property"]:
            elements[-1][2].append(t[1:])
    order = ">" if "big" in form else "<"
    words, at, verts, faces = body.split() if form == "ascii" else [], 0, pd.DataFrame(columns=["x", "y", "z"]), np.zeros((0, 3), np.int64)
    for name, n, props in elements:
        if all(p[0] != "list" for p in props):
            if form == "ascii":
                rows = np.array(words[at : at + n * len(props)], float).reshape(n, len(props))
                table, at = pd.DataFrame(rows, columns=[p[1] for p in props]), at + n * len(props)
            else:
                kind = np.dtype([(p[1], order + _PLY_TYPES[p[0]]) for p in props])
                table, at = pd.DataFrame({c: np.frombuffer(body, kind, n, at)[c].astype(float) for c in kind.names}), at + n * kind.itemsize
            if name == "vertex":
                verts = table
        else:
            out = []
            for _ in range(n):
                for p in props:
                    if form == "ascii":
                        k = int(words[at]) if p[0] == "list" else 0
                        values = [int(float(w)) for w in words[at + 1 : at + 1 + k]]
                        at += 1 + k
                    elif p[0] == "list":
                        count, item = np.dtype(order + _PLY_TYPES[p[1]]), np.dtype(order + _PLY_TYPES[p[2]])
                        k = int(np.frombuffer(body, count, 1, at)[0])
                        values = np.frombuffer(body, item, k, at + count.itemsize).tolist()
                        at += count.itemsize + k * item.itemsize
                    else:
                        at += np.dtype(_PLY_TYPES[p[0]]).itemsize
                        continue
                    if name == "face" and len(values) >= 3:
                        out += [(values[0], values[j], values[j + 1]) for j in range(1, len(values) - 1)]
            if name == "face":
                faces = np.array(out, np.int64).reshape(-1, 3)
    for c, long in zip("rgb", ("red", "green", "blue"), strict=True):
        verts[c] = verts[long] if long in verts else 200
    return verts, faces


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(pt_id, x, y, z, r, g, b) of one or more PLY files; ids go on from file to file, in order of path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.regexp_extract(F.substring_index(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), "end_header", 1), r"element vertex (\d+)", 1)
    at, first = 0, {}
    for r in files.select("path", F.coalesce(n.try_cast("long"), F.lit(0)).alias("n")).orderBy("path").collect():  # one row a file
        first[r.path], at = at, at + r.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                v = parse_ply(bytes(content))[0]
                yield pd.DataFrame({"pt_id": first[name] + np.arange(len(v)), **{c: v[c].astype(float) for c in "xyz"}, **{c: v[c].astype(int) for c in "rgb"}})

    return files.mapInPandas(run, "pt_id long, x double, y double, z double, r int, g int, b int")


def ply_faces(files: DataFrame) -> DataFrame:
    """files (path, content) with the face count of the header (0 if none)."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    head = F.substring_index(head, "end_header", 1)
    return files.withColumn("faces", F.coalesce(F.regexp_extract(head, r"element face (\d+)", 1).try_cast("long"), F.lit(0)).cast("long"))


# --- GeoTIFF ----------------------------------------------------------------------------------

_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_TIFF_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def _tiff_form(data: bytes) -> tuple[str, bool]:
    """(byte order, whether offsets have 64 bits) of a TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] not in (42, 43):
        raise ValueError("not a TIFF")
    return order, struct.unpack_from(order + "H", data, 2)[0] == 43


def tiff_tags(data: bytes, at: int | None = None) -> dict[int, tuple]:
    """Tags of a TIFF directory (the first, or the one at an offset); ``data`` may be a mapped file. Key -1: the next directory."""
    e, big = _tiff_form(data)
    if at is None:
        at = struct.unpack_from(e + "Q", data, 8)[0] if big else struct.unpack_from(e + "I", data, 4)[0]
    n_tags, first, width, room, word = (struct.unpack_from(e + "Q", data, at)[0], at + 8, 20, 8, "Q") if big else (struct.unpack_from(e + "H", data, at)[0], at + 2, 12, 4, "I")
    out: dict[int, tuple] = {}
    for k in range(n_tags):
        spot = first + width * k
        tag, kind, n = struct.unpack_from(e + "HH" + word, data, spot)
        size = _TIFF_SIZE.get(kind, 1) * n
        value = spot + width - room
        where = value if size <= room else struct.unpack_from(e + word, data, value)[0]
        if where + size > len(data):
            continue
        if kind in (2, 7):
            out[tag] = (data[where : where + n],)
        elif kind in (5, 10):
            pairs = struct.unpack_from(e + ("I" if kind == 5 else "i") * 2 * n, data, where)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        elif kind in _TIFF_CODE:
            out[tag] = struct.unpack_from(f"{e}{n}{_TIFF_CODE[kind]}", data, where)
    end = first + width * n_tags
    out[-1] = struct.unpack_from(e + word, data, end) if end + room <= len(data) else (0,)
    return out


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes from 9 bits, high bits first, early change."""
    out, table, width, bits, have = [], [], 9, 0, 0
    last = b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            code = bits >> (have - width) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [], 9, b""
                continue
            entry = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else last + last[:1]
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            width = 9 + (len(table) + 258 >= 511) + (len(table) + 258 >= 1023) + (len(table) + 258 >= 2047)
    return b"".join(out)


def _predicted(block: np.ndarray, predictor: int) -> bytes:
    """Bytes of a (rows, cols, bands) block as the predictor has them, low byte first but for predictor 3."""
    rows, cols, n = block.shape
    if predictor == 2:
        before = np.concatenate([np.zeros((rows, 1, n), block.dtype), block[:, :-1]], axis=1)
        return (block - before).astype(block.dtype.newbyteorder("<")).tobytes()
    if predictor == 3:  # bytes of like weight side by side, highest first, then differences along the row
        planes = block.astype(block.dtype.newbyteorder(">")).reshape(rows, cols * n).view(np.uint8).reshape(rows, cols * n, -1).transpose(0, 2, 1).reshape(rows, -1)
        out = planes.copy()
        out[:, n:] -= planes[:, :-n]
        return out.tobytes()
    return block.astype(block.dtype.newbyteorder("<")).tobytes()


def _unpredicted(data: bytes, kind: np.dtype, rows: int, cols: int, n: int, predictor: int) -> np.ndarray:
    """The inverse of ``_predicted`` for values of ``kind``, whose byte order is the file's."""
    size = cols * n * kind.itemsize
    rows = min(rows, len(data) // size)
    if predictor == 3:
        planes = np.frombuffer(data, np.uint8, rows * size).reshape(rows, -1, n)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, n)
    block = np.frombuffer(data, kind, rows * cols * n).reshape(rows, cols, n)
    if predictor == 2:
        return np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return block


def halved(bands: np.ndarray, nodata: float | None = None) -> np.ndarray:
    """Means of 2 x 2 cells; cells without data do not count."""
    n, h, w = bands.shape
    padded = np.pad(bands, ((0, 0), (0, h % 2), (0, w % 2)), "edge").astype(float)
    parts = padded.reshape(n, (h + 1) // 2, 2, (w + 1) // 2, 2)
    valid = np.isfinite(parts) & (True if nodata is None else parts != nodata)
    count = valid.sum((2, 4))
    empty = np.nan if nodata is None else nodata
    mean = np.where(count > 0, np.where(valid, parts, 0).sum((2, 4)) / np.maximum(count, 1), empty if bands.dtype.kind == "f" or nodata is not None else 0)
    return (np.rint(mean) if bands.dtype.kind in "ui" else mean).astype(bands.dtype)


def packed_tile(part: np.ndarray, tile: int, predictor: int) -> bytes:
    """A (rows, cols, bands) piece as a whole tile's compressed bytes."""
    block = np.zeros((tile, tile, part.shape[2]), part.dtype)
    block[: part.shape[0], : part.shape[1]] = part
    return zlib.compress(_predicted(block, predictor), 6)


def check_predictor(dtype: np.dtype, predictor: int) -> None:
    if predictor not in (1, 2, 3) or (predictor == 2 and dtype.kind == "f") or (predictor == 3 and dtype.kind != "f"):
        raise ValueError(f"predictor {predictor} does not go with {dtype}")


def tiff_head(sizes: list[tuple[int, int, list[int]]], dtype: np.dtype, n: int, minx: float, maxy: float, cell: float, epsg: int | None, nodata: float | None,
              tile: int, predictor: int, big: bool | None) -> bytes:
    """Everything before the blocks of a tiled, deflated GeoTIFF.

    sizes: (columns, rows, bytes of each tile) of the raster and its overviews. Directories stand before
    the blocks, coarse blocks before fine ones, as a reader of byte ranges wants it.
    """
    check_predictor(dtype, predictor)
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1]
    if epsg:
        keys[3] = 3
        keys += [3072, 0, 1, epsg]
    if big is None:
        big = sum(sum(x[2]) for x in sizes) + 40 * sum(len(x[2]) for x in sizes) + 100_000 > 0xFFFFFFFF

    def directory(k: int, at: int, places: list[int], following: int) -> bytes:
        """Directory k, to stand at an offset, with its long values behind it."""
        w, h, lengths = sizes[k]
        tags: list[tuple[int, str, list]] = [
            (254, "I", [int(k > 0)]), (256, "I", [w]), (257, "I", [h]), (258, "H", [dtype.itemsize * 8] * n), (259, "H", [8]), (262, "H", [2 if n >= 3 else 1]), (277, "H", [n]),
            (284, "H", [1]), (317, "H", [predictor]), (322, "H", [tile]), (323, "H", [tile]), (324, "Q" if big else "I", places), (325, "I", lengths)]
        if n > (3 if n >= 3 else 1):
            tags.append((338, "H", [2 if n == 4 else 0] * (n - (3 if n >= 3 else 1))))
        tags += [(339, "H", [kind] * n), (33550, "d", [cell * 2**k, cell * 2**k, 0.0]), (33922, "d", [0.0, 0.0, 0.0, minx, maxy, 0.0]), (34735, "H", keys)]
        if nodata is not None:
            tags.append((42113, "s", [repr(float(nodata)).encode() + b"\x00"]))
        room, word, count = (8, "Q", "Q") if big else (4, "I", "H")
        entries, extra = b"", b""
        behind = at + struct.calcsize(count) + (4 + 2 * room) * len(tags) + room
        for tag, code, values in tags:
            raw = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            entries += struct.pack("<HH" + word, tag, {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}[code], len(raw) if code == "s" else len(values))
            if len(raw) <= room:
                entries += raw.ljust(room, b"\x00")
            else:
                entries += struct.pack("<" + word, behind + len(extra))
                extra += raw + b"\x00" * (len(raw) % 2)
        return struct.pack("<" + count, len(tags)) + entries + struct.pack("<" + word, following) + extra

    head = b"II+\x00" + struct.pack("<HHQ", 8, 0, 16) if big else b"II*\x00" + struct.pack("<I", 8)
    starts = np.cumsum([len(head), *[len(directory(k, 0, [0] * len(x[2]), 0)) for k, x in enumerate(sizes)]]).tolist()
    at, places = starts[-1], {}
    for k in range(len(sizes) - 1, -1, -1):
        places[k] = np.cumsum([at, *sizes[k][2]]).tolist()
        at = places[k].pop()
    return b"".join([head, *[directory(k, starts[k], places[k], starts[k + 1] if k + 1 < len(sizes) else 0) for k in range(len(sizes))]])


def write_geotiff(path: str, bands: np.ndarray, minx: float, maxy: float, cell: float, epsg: int | None = None, nodata: float | None = None, tile: int = 256,
                  predictor: int = 1, overviews: int = 0, big: bool | None = None) -> str:
    """A tiled, deflated GeoTIFF of an array (bands, rows, cols).

    predictor: 1 none, 2 differences (integers), 3 differences of bytes (floats). overviews: that many
    levels of half the size each follow in the same file. big: 64-bit offsets; by default where the
    file needs them.
    """
    bands = bands if bands.ndim == 3 else bands[None]
    check_predictor(bands.dtype, predictor)
    levels = [bands]
    for _ in range(overviews):
        levels.append(halved(levels[-1], nodata))
    packed = [[packed_tile(level[:, r : r + tile, c : c + tile].transpose(1, 2, 0), tile, predictor) for r in range(0, level.shape[1], tile) for c in range(0, level.shape[2], tile)] for level in levels]
    sizes = [(level.shape[2], level.shape[1], [len(b) for b in blocks]) for level, blocks in zip(levels, packed, strict=True)]
    head = tiff_head(sizes, bands.dtype, bands.shape[0], minx, maxy, cell, epsg, nodata, tile, predictor, big)
    return files.write(None, path, [head, *[b for blocks in reversed(packed) for b in blocks]])


def _tiff_level(path: str, level: int) -> tuple[dict[int, tuple], str]:
    """Tags of the n-th directory, wherever it stands in the file, and the byte order."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        t = tiff_tags(data)
        for _ in range(level):
            if not t[-1][0]:
                raise ValueError(f"{path} has no overview {level}")
            t = tiff_tags(data, t[-1][0])
        return t, _tiff_form(data)[0]


def geotiff_info(path: str, level: int = 0) -> dict:
    t, order = _tiff_level(path, level)
    keys = t.get(34735, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] == 3072), None)
    scale, tie = t.get(33550, (1.0, 1.0, 0.0)), t.get(33922, (0.0,) * 6)
    nodata = float(t[42113][0].split(b"\x00")[0]) if 42113 in t else None
    return {"w": t[256][0], "h": t[257][0], "bands": t.get(277, (1,))[0], "minx": tie[3], "maxy": tie[4], "cell": scale[0], "epsg": epsg, "nodata": nodata, "tags": t, "order": order}


def _tiff_block(raw: bytes, t: dict, rows: int, cols: int, order: str = "<") -> np.ndarray:
    compression, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    if compression in (8, 32946):
        data = zlib.decompress(raw)
    elif compression == 5:
        data = lzw_decode(raw)
    elif compression == 1:
        data = raw
    else:
        raise ValueError(f"TIFF compression {compression} is not supported")
    if predictor not in (1, 2, 3):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    if t.get(284, (1,))[0] != 1 and t.get(277, (1,))[0] > 1:
        raise ValueError("TIFF bands in planes of their own are not supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(339, (1,))[0]] }{t[258][0] // 8}")
    return _unpredicted(data, kind, rows, cols, t.get(277, (1,))[0], predictor)


class GeoTiffReader(DataSourceReader):
    """One partition a block; filters on row and col skip blocks."""

    def __init__(self, path: str, level: int = 0):
        self.path, self.level, self.window = path, level, {"row": [0, 1 << 62], "col": [0, 1 << 62]}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  (the interface's name)
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name in self.window and isinstance(value, int):
                low, high = self.window[name]
                kind = type(f).__name__
                if kind in ("GreaterThanOrEqual", "GreaterThan", "EqualTo"):
                    low = max(low, value + (kind == "GreaterThan"))
                if kind in ("LessThanOrEqual", "LessThan", "EqualTo"):
                    high = min(high, value - (kind == "LessThan"))
                self.window[name] = [low, high]
            yield f  # Spark checks every row again

    def partitions(self) -> list[_Range]:
        t = geotiff_info(self.path, self.level)["tags"]
        w, h = t[256][0], t[257][0]
        if 322 in t:
            tw, th = t[322][0], t[323][0]
            across = -(-w // tw)
            spots = [(k // across * th, k % across * tw, th, tw, k) for k in range(len(t[324]))]
        else:
            th = min(t.get(278, (h,))[0], h)
            spots = [(k * th, 0, min(th, h - k * th), w, k) for k in range(len(t[273]))]
        (r0, r1), (c0, c1) = self.window["row"], self.window["col"]
        kept = [s for s in spots if s[0] <= r1 and s[0] + s[2] > r0 and s[1] <= c1 and s[1] + s[3] > c0]
        return [InputPartition(s) for s in kept] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        row, col, rows, cols, k = partition.value
        info = geotiff_info(self.path, self.level)
        t = info["tags"]
        at, size = (t[324][k], t[325][k]) if 322 in t else (t[273][k], t[279][k])
        with open(self.path, "rb") as f:
            f.seek(at)
            block = _tiff_block(f.read(size), t, rows, cols, info["order"])
        r, c = np.meshgrid(np.arange(row, row + block.shape[0]), np.arange(col, col + block.shape[1]), indexing="ij")
        inside = (r < info["h"]) & (c < info["w"])
        for band in range(block.shape[2]):
            v = block[..., band][inside].astype(float)
            missing = ~np.isfinite(v) if info["nodata"] is None or info["nodata"] != info["nodata"] else ~np.isfinite(v) | (v == info["nodata"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), band + 1, np.int32)), pa.array(r[inside]), pa.array(c[inside]), pa.array(v, mask=missing)], names=["band", "row", "col", "value"])


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "band int, row long, col long, value double"

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("overview", "0")))


def register(spark: SparkSession) -> None:
    """Make the formats ``las`` and ``geotiff`` known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    spark.dataSource.register(GeoTiffSource)


# --- photo headers ----------------------------------------------------------------------------

EXIF = "width int, height int, make string, model string, datetime string, focal_mm double, focal35_mm double, lat double, lon double, alt double"


def parse_exif(content: bytes) -> dict:
    """Size, camera, focal lengths and position of a JPEG or TIFF header; unreadable ones are empty."""
    out: dict = dict.fromkeys(["width", "height", "make", "model", "datetime", "focal_mm", "focal35_mm", "lat", "lon", "alt"])
    out |= {"width": 0, "height": 0, "make": "", "model": ""}
    try:
        tiff = content if content[:2] in (b"II", b"MM") else b""
        at = 2
        while not tiff and content[:2] == b"\xff\xd8" and at + 4 < len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
            if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\x00\x00":
                tiff = content[at + 10 : at + 2 + size]
            if marker in (0xC0, 0xC1, 0xC2):
                out["height"], out["width"] = struct.unpack_from(">HH", content, at + 5)
            at += 2 + size
        scan = 2
        while content[:2] == b"\xff\xd8" and not out["width"] and scan + 9 < len(content) and content[scan] == 0xFF:
            if content[scan + 1] in (0xC0, 0xC1, 0xC2):
                out["height"], out["width"] = struct.unpack_from(">HH", content, scan + 5)
            scan += 2 + struct.unpack_from(">H", content, scan + 2)[0]
        if not tiff:
            return out
        first = tiff_tags(tiff)
        text = lambda t, k: t[k][0].split(b"\x00")[0].decode("latin-1").strip("\x00 ") if k in t else ""
        out["make"], out["model"] = text(first, 271), text(first, 272)
        sub = tiff_tags(tiff, first[34665][0]) if 34665 in first else {}
        gps = tiff_tags(tiff, first[34853][0]) if 34853 in first else {}
        out["width"] = out["width"] or (sub.get(40962) or first.get(256) or (0,))[0]
        out["height"] = out["height"] or (sub.get(40963) or first.get(257) or (0,))[0]
        out["datetime"] = text(sub, 36867) or text(first, 306) or None
        out["focal_mm"] = (sub.get(37386) or (None,))[0] or None
        out["focal35_mm"] = float(sub[41989][0]) if sub.get(41989, (0,))[0] else None
        for name, value, ref, low in (("lat", 2, 1, "S"), ("lon", 4, 3, "W")):
            if value in gps and len(gps[value]) == 3:
                d = gps[value]
                degrees = d[0] + d[1] / 60 + d[2] / 3600
                out[name] = -degrees if text(gps, ref).upper() == low else degrees
        if 6 in gps:
            out["alt"] = -gps[6][0] if gps.get(5, (0,))[0] in (1, b"\x01") else gps[6][0]
    except (struct.error, KeyError, IndexError, UnicodeDecodeError, ValueError):
        pass
    return out


def photo_headers(files: DataFrame) -> DataFrame:
    """(path, EXIF columns) from files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_exif(bytes(c)) for c in b["content"]]
            yield pd.DataFrame(rows).assign(path=b["path"].to_numpy())[["path", *[x.split()[0] for x in EXIF.split(", ")]]]

    return files.select("path", "content").mapInPandas(run, "path string, " + EXIF)


def exif_bytes(make: str, model: str, lat: float, lon: float, alt: float, focal: float, when: str, size: tuple[int, int]) -> bytes:
    """A small TIFF header with the tags that ``parse_exif`` reads (for fixtures and samples)."""

    def dms(v: float) -> list[tuple[int, int]]:
        v = abs(v)
        d, m = int(v), int(v * 60 % 60)
        return [(d, 1), (m, 1), (round((v * 3600 - d * 3600 - m * 60) * 10000), 10000)]

    def directory(tags: list[tuple], at: int) -> bytes:
        body, extra, base = b"", b"", at + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            raw = values if kind == 2 else struct.pack("<" + "II" * len(values), *[x for p in values for x in p]) if kind == 5 else struct.pack("<" + {1: "B", 3: "H", 4: "I"}[kind] * len(values), *values)
            body += struct.pack("<HHI", tag, kind, len(values))
            if len(raw) <= 4:
                body += raw.ljust(4, b"\x00")
            else:
                body += struct.pack("<I", base + len(extra))
                extra += raw + b"\x00" * (len(raw) % 2)
        return struct.pack("<H", len(tags)) + body + b"\x00" * 4 + extra

    sub = [(36867, 2, when.encode() + b"\x00"), (37386, 5, [(round(focal * 1000), 1000)]), (40962, 4, [size[0]]), (40963, 4, [size[1]])]
    gps = [(1, 2, (b"S" if lat < 0 else b"N") + b"\x00"), (2, 5, dms(lat)), (3, 2, (b"W" if lon < 0 else b"E") + b"\x00"), (4, 5, dms(lon)), (5, 1, [int(alt < 0)]), (6, 5, [(round(abs(alt) * 100), 100)])]
    main = lambda s, g: [(271, 2, make.encode() + b"\x00"), (272, 2, model.encode() + b"\x00"), (34665, 4, [s]), (34853, 4, [g])]
    s = 8 + len(directory(main(0, 0), 8))
    g = s + len(directory(sub, s))
    return b"II*\x00" + struct.pack("<I", 8) + directory(main(s, g), 8) + directory(sub, s) + directory(gps, g)
