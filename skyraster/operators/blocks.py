"""Grids as blocks: halo exchange for neighbourhood filters, and nearest cells by a distance transform.

A block is SIDE x SIDE cells of a dense grid in one row: (br, bc, data), with NaN where a cell has
no value. Filters get each block with a margin that its neighbours sent it once; summaries of a strip of blocks
are as long as its borders. So no task holds a whole row or column of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.schema import RasterMeta

SIDE = 256
BLOCKS = "br long, bc long, data binary"
_FAR = 1 << 62


def across(meta: RasterMeta, side: int = SIDE) -> tuple[int, int]:
    """Numbers of blocks down and across."""
    return -(-meta.ny // side), -(-meta.nx // side)


def spans(meta: RasterMeta, br: int, bc: int, side: int = SIDE) -> tuple[int, int, int, int]:
    """First row, first column, rows and columns of a block."""
    r, c = br * side, bc * side
    return r, c, min(side, meta.ny - r), min(side, meta.nx - c)


def pack(cells: DataFrame, meta: RasterMeta, columns: list[str], side: int = SIDE) -> DataFrame:
    """Every block of the grid, from the cells (row, col, columns) that there are."""
    names = [f"_v{k}" for k in range(len(columns))]

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(rows["br"].iloc[0]), int(rows["bc"].iloc[0])
        r, c, h, w = spans(meta, br, bc, side)
        out = np.full((len(names), h, w), np.nan)
        real = rows["row"].notna().to_numpy()
        at = rows["row"].to_numpy()[real].astype(int) - r, rows["col"].to_numpy()[real].astype(int) - c
        for k, name in enumerate(names):
            out[k][at] = rows[name].to_numpy(float)[real]
        return pd.DataFrame({"br": [br], "bc": [bc], "data": [out.tobytes()]})

    down, wide = across(meta, side)
    i, empty = F.col("id"), F.lit(None)
    every = cells.sparkSession.range(down * wide).select(F.floor(i / wide).cast("long").alias("br"), (i % wide).alias("bc"), empty.cast("long").alias("row"), empty.cast("long").alias("col"), *[empty.cast("double").alias(n) for n in names])
    block = lambda x: F.floor(F.col(x) / side).cast("long")
    inside = cells.where(F.col("row").between(0, meta.ny - 1) & F.col("col").between(0, meta.nx - 1))
    rows = inside.select(block("row").alias("br"), block("col").alias("bc"), "row", "col", *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    return rows.unionByName(every).groupBy("br", "bc").applyInPandas(put, BLOCKS)


def unpack(blocks: DataFrame, meta: RasterMeta, columns: list[str], side: int = SIDE) -> DataFrame:
    """(row, col, columns) of every cell; NaN is null."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for br, bc, data in zip(batch["br"], batch["bc"], batch["data"], strict=True):
                r, c, h, w = spans(meta, br, bc, side)
                planes = np.frombuffer(data).reshape(len(columns), -1)
                yield pd.DataFrame({"row": np.repeat(np.arange(r, r + h), w), "col": np.tile(np.arange(c, c + w), h), **dict(zip(columns, planes, strict=True))})

    out = blocks.select("br", "bc", "data").mapInPandas(rows, "row long, col long, " + ", ".join(f"`{c}` double" for c in columns))
    return out.select("row", "col", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def filtered(blocks: DataFrame, meta: RasterMeta, reach: int, f: Callable[[np.ndarray, int, int], np.ndarray], planes: int = 1, side: int = SIDE) -> DataFrame:
    """Blocks of f(window, row, col): the window has ``reach`` more cells on all sides, NaN outside the grid.

    Each block sends every neighbour the part that lies in its margin.
    """
    if reach > side:
        raise ValueError(f"a margin of {reach} cells is more than a block of {side}")
    down, wide = across(meta, side)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for br, bc, data in zip(batch["br"], batch["bc"], batch["data"], strict=True):
                r, c, h, w = spans(meta, br, bc, side)
                block = np.frombuffer(data).reshape(planes, h, w)
                for tr in range(max(0, br - 1), min(down, br + 2)):
                    for tc in range(max(0, bc - 1), min(wide, bc + 2)):
                        r2, c2, h2, w2 = spans(meta, tr, tc, side)
                        r0, r1, c0, c1 = max(r, r2 - reach), min(r + h, r2 + h2 + reach), max(c, c2 - reach), min(c + w, c2 + w2 + reach)
                        if r0 < r1 and c0 < c1:
                            out.append((tr, tc, r0, c0, r1 - r0, c1 - c0, block[:, r0 - r : r1 - r, c0 - c : c1 - c].tobytes()))
            yield pd.DataFrame(out, columns=["br", "bc", "r", "c", "h", "w", "data"])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(rows["br"].iloc[0]), int(rows["bc"].iloc[0])
        r, c, h, w = spans(meta, br, bc, side)
        window = np.full((planes, h + 2 * reach, w + 2 * reach), np.nan)
        for x in rows.itertuples():
            a, b = x.r - r + reach, x.c - c + reach
            window[:, a : a + x.h, b : b + x.w] = np.frombuffer(x.data).reshape(planes, x.h, x.w)
        return pd.DataFrame({"br": [br], "bc": [bc], "data": [np.ascontiguousarray(f(window, r, c), float).tobytes()]})

    sent = blocks.mapInPandas(send, "br long, bc long, r long, c long, h long, w long, data binary")
    return sent.groupBy("br", "bc").applyInPandas(work, BLOCKS)


def running(a: np.ndarray, size: int, f: np.ufunc, axis: int) -> np.ndarray:
    """f (fmin, fmax) over each ``size`` neighbours along an axis, in about log2(size) steps."""
    n = a.shape[axis]
    cut = lambda x, lo, hi: x[(slice(None),) * axis + (slice(lo, hi),)]
    out, have = a, 1
    while have < size:
        step = min(have, size - have)
        m = out.shape[axis]
        out = f(cut(out, 0, m - step), cut(out, step, m))
        have += step
    assert out.shape[axis] == n - size + 1
    return out


def mirrored(window: np.ndarray, meta: RasterMeta, row: int, col: int, reach: int) -> np.ndarray:
    """A window whose cells outside the grid repeat those inside, the edge being the mirror."""
    out = window
    for axis, first, n in ((-2, row, meta.ny), (-1, col, meta.nx)):
        size = window.shape[axis]
        at = np.arange(first - reach, first - reach + size) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at) - (first - reach)
        # beyond the window's own far margin (past the grid's far edge) nothing is asked for
        out = np.take(out, np.clip(at, 0, size - 1), axis=axis)
    return out


# --- nearest cells ----------------------------------------------------------------------------


def _envelope(col: np.ndarray, row: np.ndarray, here: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows side by side: which candidates are nearest somewhere in columns [low, high), and from which column on.

    Candidate k of line i is the cell (row[i, k], col[i, k]), row < 0 for none, by growing column; ``here`` are the lines' own rows.
    Nearest is by (distance, row, column), so that of two candidates the right one is nearer from one column on. Returns the kept
    candidates (line, place) as a mask, and their first columns.
    """
    lines, count = col.shape
    stack = np.zeros((lines, count), np.int64)  # candidates kept so far
    start = np.zeros((lines, count), np.int64)
    depth = np.zeros(lines, np.int64)
    g = (here[:, None] - row) ** 2
    for k in range(count):
        todo = np.flatnonzero(row[:, k] >= 0)
        while len(todo):
            empty = todo[depth[todo] == 0]
            stack[empty, 0], start[empty, 0] = k, low
            depth[empty] = 1
            todo = todo[np.isin(todo, empty, invert=True)] if len(empty) else todo
            if not len(todo):
                break
            top = stack[todo, depth[todo] - 1]
            c1, c2 = col[todo, top], col[todo, k]
            num, den = g[todo, k] + c2 * c2 - g[todo, top] - c1 * c1, 2 * (c2 - c1)
            at = -(-num // den)  # the first column where it is as near or nearer
            tie = (at * den == num) & (row[todo, top] <= row[todo, k])
            at = np.maximum(at + tie, low)
            pop = at <= start[todo, depth[todo] - 1]
            keep = todo[~pop & (at < high)]
            stack[keep, depth[keep]], start[keep, depth[keep]] = k, at[~pop & (at < high)]
            depth[keep] += 1
            todo = todo[pop]
            depth[todo] -= 1
    mask = np.zeros((lines, count), bool)
    first = np.full((lines, count), _FAR, np.int64)
    live = np.arange(count) < depth[:, None]
    line = np.repeat(np.arange(lines), depth)
    mask[line, stack[live]] = True
    first[line, stack[live]] = start[live]
    return mask, first


def _vertical(data: np.ndarray, r: int, above: np.ndarray, below: np.ndarray, above_v: np.ndarray, below_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, values) of the nearest valid cell in each cell's own column; row -1 if it has none. Ties: the upper one."""
    planes, h, w = data.shape
    valid = ~np.isnan(data[0])
    mine = np.where(valid, np.arange(h)[:, None], -1)
    up = np.maximum.accumulate(mine, axis=0)
    down = np.minimum.accumulate(np.where(valid, np.arange(h)[:, None], h)[::-1], axis=0)[::-1]
    cols = np.broadcast_to(np.arange(w), (h, w))
    up_row, down_row = np.where(up >= 0, up + r, above), np.where(down < h, down + r, below)
    line = np.arange(r, r + h)[:, None]
    to_up, to_down = np.where(up_row >= 0, line - up_row, _FAR), np.where(down_row >= 0, down_row - line, _FAR)
    use_up = to_up <= to_down
    row = np.where(use_up, up_row, down_row)
    values = np.empty_like(data)
    for k in range(planes):
        values[k] = np.where(use_up, np.where(up >= 0, data[k][np.maximum(up, 0), cols], above_v[k]), np.where(down < h, data[k][np.minimum(down, h - 1), cols], below_v[k]))
    return row, values


def nearest(blocks: DataFrame, meta: RasterMeta, planes: int = 1, side: int = SIDE) -> DataFrame:
    """Blocks whose empty cells have the values of the nearest valid cell; ties by row, then column.

    First along the columns: a block needs, for each of its columns, the nearest valid cell above and below
    it, which come from the first and last ones of the blocks in its strip. Then along the rows: the nearest cells of a row's columns are
    candidates, of which the lower envelope keeps those that are nearest somewhere; a block sends those that are so beyond its
    sides, and gets those of its strip that are so within. (A block without any candidate is empty.)
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for br, bc, data in zip(batch["br"], batch["bc"], batch["data"], strict=True):
                r, _, h, w = spans(meta, br, bc, side)
                block = np.frombuffer(data).reshape(planes, h, w)
                valid = ~np.isnan(block[0])
                some, cols = valid.any(axis=0), np.arange(w)
                first, last = valid.argmax(axis=0), h - 1 - valid[::-1].argmax(axis=0)
                rows = np.stack([np.where(some, first + r, -1), np.where(some, last + r, -1)]).astype(np.int64)
                values = np.stack([block[:, first, cols], block[:, last, cols]])
                out.append((br, bc, rows.tobytes(), values.tobytes()))
            yield pd.DataFrame(out, columns=["br", "bc", "rows", "data"])

    def strip_columns(rows: pd.DataFrame) -> pd.DataFrame:
        """For every block of a strip, the last valid cells above it and the first ones below."""
        rows = rows.sort_values("br")
        bc = int(rows["bc"].iloc[0])
        w = spans(meta, 0, bc, side)[3]
        found = [np.frombuffer(x, np.int64).reshape(2, w) for x in rows["rows"]]
        values = [np.frombuffer(x).reshape(2, planes, w) for x in rows["data"]]
        n = len(found)
        at, held = np.full((n, 2, w), -1, np.int64), np.full((n, 2, planes, w), np.nan)
        for order, side_, end in ((range(n), 0, 1), (range(n - 1, -1, -1), 1, 0)):
            row, value = np.full(w, -1, np.int64), np.full((planes, w), np.nan)
            for k in order:
                at[k, side_], held[k, side_] = row, value
                have = found[k][end] >= 0
                row, value = np.where(have, found[k][end], row), np.where(have, values[k][end], value)
        return pd.DataFrame({"br": rows["br"].to_numpy(), "bc": bc, "rows": [x.tobytes() for x in at], "data": [x.tobytes() for x in held]})

    def columns(block: np.ndarray, r: int, rows: bytes, held: bytes) -> tuple[np.ndarray, np.ndarray]:
        w = block.shape[2]
        at, values = np.frombuffer(rows, np.int64).reshape(2, w), np.frombuffer(held).reshape(2, planes, w)
        return _vertical(block, r, at[0], at[1], values[0], values[1])

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates of a block that are nearest to cells left or right of it."""
        for batch in batches:
            for br, bc, data, rows, held in zip(batch["br"], batch["bc"], batch["data"], batch["rows"], batch["held"], strict=True):
                r, c, h, w = spans(meta, br, bc, side)
                row, values = columns(np.frombuffer(data).reshape(planes, h, w), r, rows, held)
                col, here = np.broadcast_to(np.arange(c, c + w), (h, w)), np.arange(r, r + h)
                keep = np.zeros((h, w), bool)
                for low, high in ((0, c), (c + w, meta.nx)):
                    if low < high:
                        keep |= _envelope(col, row, here, low, high)[0]
                line, place = np.nonzero(keep)
                packed = np.column_stack([line, col[line, place], row[line, place]]).astype(np.int64)
                yield pd.DataFrame({"br": [br], "bc": [bc], "found": [packed.tobytes()], "values": [values[:, line, place].T.tobytes()]})

    def strip_rows(rows: pd.DataFrame) -> pd.DataFrame:
        """For every block of a strip, the candidates of other blocks that are nearest to cells of it."""
        br = int(rows["br"].iloc[0])
        r, _, h, _ = spans(meta, br, 0, side)
        found = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows["found"]]
        packed, values = np.concatenate(found), np.concatenate([np.frombuffer(x).reshape(-1, planes) for x in rows["values"]])
        source = np.repeat(rows["bc"].to_numpy(), [len(x) for x in found])
        order = np.lexsort((packed[:, 1], packed[:, 0]))
        packed, values, source = packed[order], values[order], source[order]
        place = np.arange(len(packed)) - np.searchsorted(packed[:, 0], packed[:, 0])
        count = int(place.max(initial=-1)) + 1
        col, row = np.zeros((h, count), np.int64), np.full((h, count), -1, np.int64)
        col[packed[:, 0], place], row[packed[:, 0], place] = packed[:, 1], packed[:, 2]
        mask, first = _envelope(col, row, np.arange(r, r + h), 0, meta.nx)
        last = np.full((h, count + 1), meta.nx, np.int64)  # up to where the next one begins
        for k in range(count - 1, -1, -1):
            last[:, k] = np.where(mask[:, k], first[:, k], last[:, k + 1])
        begin, end = first[packed[:, 0], place], last[packed[:, 0], place + 1]
        kept = mask[packed[:, 0], place]
        out = []
        for bc in range(across(meta, side)[1]):
            c, w = spans(meta, 0, bc, side)[1::2]
            some = kept & (begin < c + w) & (end > c) & (source != bc)
            out.append((br, bc, packed[some].tobytes(), values[some].tobytes()))
        return pd.DataFrame(out, columns=["br", "bc", "found", "values"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for br, bc, data, rows, held, found, more in zip(*[batch[c] for c in ("br", "bc", "data", "rows", "held", "found", "values")], strict=True):
                r, c, h, w = spans(meta, br, bc, side)
                block = np.frombuffer(data).reshape(planes, h, w)
                if not np.isnan(block[0]).any():
                    yield pd.DataFrame({"br": [br], "bc": [bc], "data": [data]})
                    continue
                row, values = columns(block, r, rows, held)
                packed, extra = np.frombuffer(found, np.int64).reshape(-1, 3), np.frombuffer(more).reshape(-1, planes)
                line, place = np.nonzero(row >= 0)
                every = np.concatenate([np.column_stack([line, place + c, row[line, place]]), packed])
                value = np.concatenate([values[:, line, place].T, extra])
                order = np.lexsort((every[:, 1], every[:, 0]))
                every, value = every[order], value[order]
                at = np.arange(len(every)) - np.searchsorted(every[:, 0], every[:, 0])
                count = int(at.max(initial=-1)) + 1
                cols, rows_ = np.zeros((h, count), np.int64), np.full((h, count), -1, np.int64)
                cols[every[:, 0], at], rows_[every[:, 0], at] = every[:, 1], every[:, 2]
                mask, first = _envelope(cols, rows_, np.arange(r, r + h), c, c + w)
                kept = mask[every[:, 0], at]
                key = every[kept, 0] * w + first[every[kept, 0], at[kept]] - c  # cells from here on take this candidate
                cell = np.searchsorted(key, np.arange(h * w), side="right") - 1
                out = block.reshape(planes, -1).copy()
                hole = np.isnan(out[0])
                out[:, hole] = value[kept].T[:, cell[hole]]
                yield pd.DataFrame({"br": [br], "bc": [bc], "data": [out.tobytes()]})

    key = ["br", "bc"]
    edges = blocks.mapInPandas(ends, "br long, bc long, rows binary, data binary").groupBy("bc").applyInPandas(strip_columns, "br long, bc long, rows binary, data binary")
    full = blocks.join(edges.withColumnRenamed("data", "held"), key)
    asked = full.mapInPandas(sides, "br long, bc long, found binary, values binary").groupBy("br").applyInPandas(strip_rows, "br long, bc long, found binary, values binary")
    return full.join(asked, key).mapInPandas(fill, BLOCKS)
