"""Large PLY files by ranges: many tasks read one file.

Elements of one size (vertices, as a rule) are read by ranges of records. Faces are lists, so where one begins depends on
those before it: if all have as many corners as the first, which tasks make sure of side by side, ranges are known;
else one pass notes the offset of every so many faces. Text files are cut by bytes: tasks count their lines, and read the lines
that begin in their part. The file must be on a store that all tasks have mounted; ``binary.read_ply`` reads others whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.sources.binary import _PLY_TYPES

RECORDS, BYTES = 500_000, 32_000_000
_POINT = "pt_id long, x double, y double, z double, r int, g int, b int"
_FACE = "face_id long, a long, b long, c long"
_LONG = {"r": "red", "g": "green", "b": "blue"}


@dataclass
class Element:
    name: str
    n: int
    props: list[list[str]]
    order: str

    @property
    def lists(self) -> bool:
        return any(p[0] == "list" for p in self.props)

    def record(self) -> np.dtype:
        return np.dtype([(p[1], self.order + _PLY_TYPES[p[0]]) for p in self.props])

    def record_of(self, corners: int) -> np.dtype:
        """A record whose lists have so many entries."""
        out = []
        for p in self.props:
            out += [(f"{p[-1]}_n", self.order + _PLY_TYPES[p[1]]), (p[-1], self.order + _PLY_TYPES[p[2]], (corners,))] if p[0] == "list" else [(p[1], self.order + _PLY_TYPES[p[0]])]
        return np.dtype(out)

    def size(self, data: np.ndarray, at: int) -> int:
        """Bytes of the record at a place."""
        start = at
        for p in self.props:
            if p[0] == "list":
                count = np.dtype(self.order + _PLY_TYPES[p[1]])
                n = int(data[at : at + count.itemsize].view(count)[0])
                at += count.itemsize + n * np.dtype(_PLY_TYPES[p[2]]).itemsize
            else:
                at += np.dtype(_PLY_TYPES[p[0]]).itemsize
        return at - start


def header(path: str) -> tuple[bool, int, list[Element]]:
    """(whether it is text, where the body begins, its elements)."""
    head, end = b"", -1
    with open(path, "rb") as f:
        while end < 0 and (more := f.read(1 << 16)):
            head += more
            end = head.find(b"end_header")
    stop = head.find(b"\n", end)
    if not head.startswith(b"ply") or end < 0 or stop < 0:
        raise ValueError(f"{path} is not a PLY file")
    form, out = "ascii", []
    for t in (line.split() for line in head[:end].decode("ascii", "replace").splitlines()):
        if t[:1] == ["format"]:
            form = t[1]
        elif t[:1] == ["element"]:
            out.append(Element(t[1], int(t[2]), [], ">" if "big" in form else "<"))
        elif t[:1] == ["property"]:
            out[-1].props.append(t[1:])
    return form == "ascii", stop + 1, out


def _ranges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A row for each range, each a task of its own."""
    return spark.createDataFrame(rows, "first long, n long, at long").repartitionByRange(max(1, len(rows)), "first")


def _steps(spark: SparkSession, path: str, e: Element, start: int) -> tuple[list[tuple[int, int, int]], int, int | None]:
    """(ranges (first, n, offset), where the element ends, corners if they are as many in all) of an element of a binary file."""
    if not e.lists or not e.n:
        size = 0 if e.lists else e.record().itemsize
        return [(k, min(RECORDS, e.n - k), start + k * size) for k in range(0, e.n, RECORDS)], start + e.n * size, None
    data = np.memmap(path, np.uint8, "r")
    corners = next(int(data[start + offset : start + offset + kind.itemsize].view(kind)[0]) for offset, kind in [_first_count(e)])
    kind = e.record_of(corners)
    whole = [(k, min(RECORDS, e.n - k), start + k * kind.itemsize) for k in range(0, e.n, RECORDS)]
    if start + e.n * kind.itemsize <= len(data):
        names = [f"{p[-1]}_n" for p in e.props if p[0] == "list"]

        def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    some = np.memmap(path, kind, "r", r.at, (r.n,))
                    yield pd.DataFrame({"ok": [all(bool((some[c] == corners).all()) for c in names)]})

        if _ranges(spark, whole).mapInPandas(same, "ok boolean").where("not ok").isEmpty():
            return whole, start + e.n * kind.itemsize, corners

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            data, at = np.memmap(path, np.uint8, "r"), start
            for k in range(e.n + 1):
                if k % RECORDS == 0 or k == e.n:
                    yield pd.DataFrame({"k": [k], "at": [at]})
                if k < e.n:
                    at += e.size(data, at)

    found = sorted((r["k"], r["at"]) for r in spark.range(1, numPartitions=1).mapInPandas(index, "k long, at long").collect())
    return [(k, m - k, at) for (k, at), (m, _) in zip(found, found[1:], strict=False)], found[-1][1], None


def _first_count(e: Element) -> tuple[int, np.dtype]:
    """Offset and type of a record's first list count."""
    offset = 0
    for p in e.props:
        if p[0] == "list":
            return offset, np.dtype(e.order + _PLY_TYPES[p[1]])
        offset += np.dtype(_PLY_TYPES[p[0]]).itemsize
    raise ValueError("no list")


def _fans(face: np.ndarray, corners: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """Triangles of polygons: corners of each, values one after the other."""
    start = np.cumsum(corners) - corners
    many = np.maximum(corners - 2, 0)
    which = np.repeat(np.arange(len(corners)), many)
    j = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + 1
    return pd.DataFrame({"face_id": face[which], "a": values[start[which]], "b": values[start[which] + j], "c": values[start[which] + j + 1]})


def _points(first: int, table: dict[str, np.ndarray], n: int) -> pd.DataFrame:
    whole = lambda c: table[c].astype(int) if c in table else np.full(n, 200)
    return pd.DataFrame({"pt_id": first + np.arange(n), **{c: table[c].astype(float) for c in "xyz"}, **{c: whole(long) for c, long in _LONG.items()}})


def _lines(spark: SparkSession, path: str, body: int, first: int, n: int, schema: str, make) -> DataFrame:
    """make(index in the element, lines as lists of words) over lines first .. first + n - 1 of a text body."""
    size = os.path.getsize(path)
    cuts = list(range(body, size, BYTES)) or [body]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                part = np.memmap(path, np.uint8, "r", r.at, (r.n,)) if r.n else np.zeros(0, np.uint8)
                yield pd.DataFrame({"first": [r.first], "lines": [int((part == 10).sum())]})

    parts = [(k, min(BYTES, size - at), at) for k, at in enumerate(cuts)]
    held = {r["first"]: r.lines for r in _ranges(spark, parts).mapInPandas(count, "first long, lines long").collect()}
    before = np.concatenate([[0], np.cumsum([held[k] for k in range(len(parts))])]).tolist()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if before[r.first] > first + n or before[r.first + 1] < first:
                    continue
                with open(path, "rb") as f:
                    f.seek(r.at)
                    lines = f.read(r.n).split(b"\n")
                    lines[-1] += f.readline().rstrip(b"\n")  # the last line goes on in the next part
                # the first piece belongs to the line before, but for the first part
                number, lines = (before[r.first], lines) if r.first == 0 else (before[r.first] + 1, lines[1:])
                some = [(number + k - first, x.split()) for k, x in enumerate(lines) if first <= number + k < first + n]
                if some:
                    yield make(np.array([k for k, _ in some]), [x for _, x in some])

    return _ranges(spark, parts).mapInPandas(read, schema)


def _place(elements: list[Element], name: str) -> int | None:
    return next((k for k, e in enumerate(elements) if e.name == name), None)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(pt_id, x, y, z, r, g, b) of a PLY file's vertices; missing colours are 200."""
    text, body, elements = header(path)
    k = _place(elements, "vertex")
    if k is None or not elements[k].n:
        return spark.createDataFrame([], _POINT)
    e = elements[k]
    names = [p[1] for p in e.props]
    if text:
        def make(at: np.ndarray, words: list[list[bytes]]) -> pd.DataFrame:
            columns = np.array(words, float).T
            return _points(0, dict(zip(names, columns, strict=True)), len(at)).assign(pt_id=at)

        return _lines(spark, path, body, sum(x.n for x in elements[:k]), e.n, _POINT, make)
    at = body
    for x in elements[:k]:
        at = _steps(spark, path, x, at)[1]
    kind = e.record()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                some = np.fromfile(path, kind, r.n, offset=r.at)
                yield _points(r.first, {c: some[c] for c in names}, len(some))

    return _ranges(spark, _steps(spark, path, e, at)[0]).mapInPandas(read, _POINT)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """(face_id, a, b, c) of a PLY file's faces; polygons become fans of triangles."""
    text, body, elements = header(path)
    k = _place(elements, "face")
    if k is None or not elements[k].n or not elements[k].lists:
        return spark.createDataFrame([], _FACE)
    e = elements[k]
    if text:
        def make(at: np.ndarray, words: list[list[bytes]]) -> pd.DataFrame:
            lists = []
            for w in words:
                i = 0
                for p in e.props:  # as in binary files, every list of a face is one of corners
                    if p[0] == "list":
                        lists.append([int(float(v)) for v in w[i + 1 : i + 1 + int(w[i])]])
                        i += 1 + int(w[i])
                    else:
                        i += 1
            per = len(lists) // max(len(words), 1)
            return _fans(np.repeat(at, per), np.array([len(x) for x in lists]), np.array([v for x in lists for v in x], np.int64))

        return _lines(spark, path, body, sum(x.n for x in elements[:k]), e.n, _FACE, make)
    at = body
    for x in elements[:k]:
        at = _steps(spark, path, x, at)[1]
    ranges, _, corners = _steps(spark, path, e, at)
    lists = [p for p in e.props if p[0] == "list"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                face = r.first + np.arange(r.n)
                if corners is not None:
                    some = np.fromfile(path, e.record_of(corners), r.n, offset=r.at)
                    for p in lists:
                        yield _fans(face, np.full(r.n, corners), some[p[-1]].astype(np.int64).ravel())
                    continue
                data, place, counts, values, owner = np.memmap(path, np.uint8, "r"), r.at, [], [], []
                for i in range(r.n):
                    for p in e.props:
                        if p[0] == "list":
                            count, item = np.dtype(e.order + _PLY_TYPES[p[1]]), np.dtype(e.order + _PLY_TYPES[p[2]])
                            n = int(data[place : place + count.itemsize].view(count)[0])
                            place += count.itemsize
                            values += data[place : place + n * item.itemsize].view(item).tolist()
                            counts.append(n)
                            owner.append(r.first + i)
                            place += n * item.itemsize
                        else:
                            place += np.dtype(_PLY_TYPES[p[0]]).itemsize
                yield _fans(np.array(owner), np.array(counts), np.array(values, np.int64))

    return _ranges(spark, ranges).mapInPandas(read, _FACE)
