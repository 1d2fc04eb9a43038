"""Terrain products: volumes against a base, contour lines, heightfield meshes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyraster.operators import blocks, grid, morph
from skyraster.plans.tables import cut, drop
from skyraster.schema import RasterMeta

BASES = ("lowest", "mean", "fit", "custom")
INDEX_EVERY = 5
MAX_LEVELS = 2000


# --- polygons ---------------------------------------------------------------------------------


def polygon_table(spark: SparkSession, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    if len(polygon) < 3:
        raise ValueError("a polygon needs three vertices or more")
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(polygon)], "i int, x double, y double")


def edges(polygon: DataFrame) -> DataFrame:
    """i, x, y, x2, y2: each vertex with the next, the last with the first."""
    w = Window.orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return polygon.select("i", "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xy"])


def polygon_area(polygon: DataFrame) -> DataFrame:
    return edges(polygon).agg((0.5 * F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")))).alias("area_m2"))


def in_polygon(polygon: Sequence[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule, as one expression over the (literal) edges: no join, and it can be pushed down."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 == y2:
            continue
        across = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        crossings = crossings + F.when(across & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def boundary_samples(polygon: Sequence[tuple[float, float]], spacing: float) -> list[tuple[float, float]]:
    """Points along the closed ring: each edge's start, then steps of about ``spacing``."""
    out = []
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        n = max(int(math.hypot(x2 - x1, y2 - y1) / max(spacing, 1e-6)), 1)
        out += [(x1 + k / n * (x2 - x1), y1 + k / n * (y2 - y1)) for k in range(n)]
    return out


# --- volumes ----------------------------------------------------------------------------------


def measure_volume(dsm: DataFrame, meta: RasterMeta, polygon: Sequence[tuple[float, float]], base: str = "lowest", custom_z: float = 0.0) -> DataFrame:
    """One row: cut, fill and net volume of the surface inside a polygon, against a base.

    The base comes from the cells under the boundary (lowest, mean, or a fitted plane) or is given.
    The window of rows and columns is a plain filter, which prunes a stored raster.
    """
    spark = dsm.sparkSession
    polygon_rows = polygon_table(spark, polygon)
    if base not in BASES:
        raise ValueError(f"base must be one of {BASES}")
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    r0, r1 = max(math.floor((meta.maxy - max(ys)) / meta.cell) - 2, 0), min(math.ceil((meta.maxy - min(ys)) / meta.cell) + 2, meta.ny)
    c0, c1 = max(math.floor((min(xs) - meta.minx) / meta.cell) - 2, 0), min(math.ceil((max(xs) - meta.minx) / meta.cell) + 2, meta.nx)
    if r0 >= r1 or c0 >= c1:
        raise ValueError("the polygon lies outside the surface")
    x, y = meta.minx + (F.col("col") + 0.5) * meta.cell, meta.maxy - (F.col("row") + 0.5) * meta.cell
    window = dsm.where(f"row >= {r0} and row < {r1} and col >= {c0} and col < {c1} and value is not null").select("row", "col", "value", x.alias("x"), y.alias("y"))
    inside = window.where(in_polygon(polygon, F.col("x"), F.col("y")))
    warnings = []
    if base == "custom":
        plane = (0.0, 0.0, float(custom_z), 0.0, 0.0)
    else:
        rim = boundary_samples(polygon, meta.cell)
        at = [(min(max(math.floor((meta.maxy - py) / meta.cell), r0), r1 - 1), min(max(math.floor((px - meta.minx) / meta.cell), c0), c1 - 1)) for px, py in rim]
        under = spark.createDataFrame(at, "row long, col long").join(window, ["row", "col"])
        s = under.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                      F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "value").alias("xz"), F.covar_pop("y", "value").alias("yz")).first()
        if s.n < 3:
            raise ValueError("the polygon's boundary has no valid elevations")
        if s.n < 0.5 * len(rim):
            warnings.append("over half of the boundary has no data; the base may be unreliable")
        if base == "fit":
            det = s.xx * s.yy - s.xy * s.xy
            flat = det <= 1e-12
            plane = (0.0 if flat else (s.xz * s.yy - s.yz * s.xy) / det, 0.0 if flat else (s.yz * s.xx - s.xz * s.xy) / det, s["mean"], s.mx, s.my)
        else:
            plane = (0.0, 0.0, s.low if base == "lowest" else s["mean"], 0.0, 0.0)
    a, b, c, mx, my = plane
    level = a * (F.col("x") - mx) + b * (F.col("y") - my) + c
    d = F.col("value") - F.col("base")
    area = meta.cell * meta.cell
    sums = inside.withColumn("base", level).agg(
        F.count(F.lit(1)).alias("n_cells"), (F.sum(F.greatest(d, F.lit(0.0))) * area).alias("cut_m3"), (F.sum(F.greatest(-d, F.lit(0.0))) * area).alias("fill_m3"),
        F.min("base").alias("base_z_min"), F.max("base").alias("base_z_max"))
    none = F.raise_error(F.lit("no valid surface cells inside the polygon")).cast("long")
    sums = sums.withColumn("n_cells", F.when(F.col("n_cells") > 0, F.col("n_cells")).otherwise(none))
    out = sums.crossJoin(F.broadcast(polygon_area(polygon_rows)))  # both are one row
    measured = F.col("n_cells") * area
    out = out.withColumn("measured_m2", measured).withColumn("coverage", F.least(measured / F.greatest("area_m2", F.lit(1e-9)), F.lit(1.0)))
    out = out.withColumn("net_m3", F.col("cut_m3") - F.col("fill_m3")).withColumn("base_mode", F.lit(base)).withColumn("cell_m", F.lit(meta.cell))
    low = F.when(F.col("coverage") < 0.95, F.array(F.format_string("only %.0f%% of the polygon has data; volumes fall short", F.col("coverage") * 100))).otherwise(F.expr("cast(array() as array<string>)"))
    known = F.array(*map(F.lit, warnings)) if warnings else F.expr("cast(array() as array<string>)")
    return out.withColumn("warnings", F.concat(known, low))


def volume_summary() -> Column:
    """A volume row in words."""
    z = F.when(F.col("base_z_min") == F.col("base_z_max"), F.format_string("%.2f m", "base_z_min")).otherwise(F.format_string("%.2f–%.2f m", "base_z_min", "base_z_max"))
    return F.concat(
        F.format_string("Cut %,.1f m³ · Fill %,.1f m³ · Net %+,.1f m³  (area %,.1f m², %.0f%% measured, base [%s] ", "cut_m3", "fill_m3", "net_m3", "area_m2", F.col("coverage") * 100, "base_mode"),
        z, F.format_string(", cell %.2f m)", "cell_m"))


# --- contours ---------------------------------------------------------------------------------


def contour_levels(dem: DataFrame, interval: float) -> DataFrame:
    """k (level = k * interval): multiples from the lowest value up to, not including, the highest."""
    if interval <= 0:
        raise ValueError("the contour interval must be positive")
    lo, hi = dem.agg(F.min("value"), F.max("value")).first()
    if lo is None:
        return dem.sparkSession.createDataFrame([], "k long")
    first, last = math.ceil(lo / interval), math.ceil(hi / interval) - 1
    if last - first + 1 > MAX_LEVELS:
        raise ValueError(f"{last - first + 1} levels; choose a larger interval")
    return dem.sparkSession.range(first, max(last + 1, first)).select(F.col("id").alias("k"))


def contour_segments(dem: DataFrame, interval: float, corners: bool = True) -> DataFrame:
    """(k, row, col, r1, c1, r2, c2, a, b): marching squares over fractional grid positions.

    row, col: the quad; a, b: the grid edges that the segment runs between, named by the sum of their cells' rows and columns.

    A quad of four valid cells gives one segment a level, or two at a saddle (joined by its
    centre's mean); with ``corners`` a quad of three gives the part inside the triangle. Quads
    come from three self-joins on whole keys and levels from a range of each quad, so the work
    is that of the lines, not of cells times levels.
    """
    contour_levels(dem, interval)
    names = {"a": (0, 0), "b": (0, 1), "c": (1, 1), "d": (1, 0)}
    quads = dem.where("value is not null").select("row", "col")
    anchors = quads.unionByName(quads.withColumn("row", F.col("row") - 1)).unionByName(quads.withColumn("col", F.col("col") - 1)).unionByName(
        quads.withColumn("row", F.col("row") - 1).withColumn("col", F.col("col") - 1)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n >= 3" if corners else "n = 4")
    out = anchors
    for n, (dr, dc) in names.items():
        out = out.join(dem.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("value").alias(n)), ["row", "col"], "left")
    low, high = F.least(*names), F.greatest(*names)
    # A value equal to the level counts as above it, so each level k has low < k * interval <= high.
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)
    out = out.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("level", F.col("k") * interval)

    def crossing(p: str, q: str) -> Column:
        t = (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
        (r1, c1), (r2, c2) = names[p], names[q]
        edge = F.struct((2 * F.col("row") + r1 + r2).alias("r"), (2 * F.col("col") + c1 + c2).alias("c"))
        at = F.struct((F.col("row") + r1 + t * (r2 - r1)).alias("r"), (F.col("col") + c1 + t * (c2 - c1)).alias("c"), edge.alias("e"))
        return F.when((F.col(p) >= F.col("level")) != (F.col(q) >= F.col("level")), at)

    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    four = [crossing(p, q) for p, q in ring]
    # Three valid corners: the ring passes over the missing one by the diagonal between its neighbours.
    three = {"a": [("b", "c"), ("c", "d"), ("d", "b")], "b": [("a", "c"), ("c", "d"), ("d", "a")], "c": [("a", "b"), ("b", "d"), ("d", "a")], "d": [("a", "b"), ("b", "c"), ("c", "a")]}
    cuts = F.array(*four)
    for n, sides in three.items():
        cuts = F.when(F.col(n).isNull(), F.array(*[crossing(p, q) for p, q in sides])).otherwise(cuts)
    out = out.withColumn("cuts", F.filter(cuts, lambda x: x.isNotNull()))
    mean = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4
    turned = (F.col("a") >= F.col("level")) == (mean >= F.col("level"))
    pair = lambda i, j: F.struct(F.col("cuts")[i].alias("p"), F.col("cuts")[j].alias("q"))
    lines = F.when(F.size("cuts") == 2, F.array(pair(0, 1))).when(F.size("cuts") == 4, F.when(turned, F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(3, 0), pair(1, 2))))
    out = out.select("k", "row", "col", F.explode(lines).alias("s"))
    return out.select("k", "row", "col", F.col("s.p.r").alias("r1"), F.col("s.p.c").alias("c1"), F.col("s.q.r").alias("r2"), F.col("s.q.c").alias("c2"), F.col("s.p.e").alias("a"), F.col("s.q.e").alias("b"))


_CHAIN = "id string, k long, ar long, ac long, br long, bc long, segments long, coords array<struct<r:double,c:double>>"


def _chains(segments: DataFrame, side: int) -> DataFrame:
    """Segments of each block of quads joined end to end: (id, k, ends a and b, segments, coords from a to b)."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        k, i, j = (int(rows[c].iloc[0]) for c in ("k", "i", "j"))
        ends = [((a, b), (c, d)) for a, b, c, d in rows[["ar", "ac", "br", "bc"]].itertuples(index=False)]
        spots = [((a, b), (c, d)) for a, b, c, d in rows[["r1", "c1", "r2", "c2"]].itertuples(index=False)]
        at: dict[tuple[int, int], list[int]] = {}
        for n, pair in enumerate(ends):
            for p in pair:
                at.setdefault(p, []).append(n)
        used, out = [False] * len(ends), []
        for start in [p for p in sorted(at) if len(at[p]) == 1] + sorted(at):  # open lines begin at an end, the others anywhere
            p, coords, count = start, [], 0
            while (n := next((n for n in at[p] if not used[n]), None)) is not None:
                used[n] = True
                near, far = (0, 1) if ends[n][0] == p else (1, 0)
                coords += [spots[n][near]] * (not coords) + [spots[n][far]]
                p, count = ends[n][far], count + 1
            if count:
                out.append((f"{k}/{i}/{j}/{len(out)}", k, *start, *p, count, [{"r": r, "c": c} for r, c in coords]))
        return pd.DataFrame(out, columns=["id", "k", "ar", "ac", "br", "bc", "segments", "coords"])

    block = lambda c: F.floor(F.col(c) / side).cast("long")
    rows = segments.select("k", block("row").alias("i"), block("col").alias("j"), "r1", "c1", "r2", "c2", F.col("a.r").alias("ar"), F.col("a.c").alias("ac"), F.col("b.r").alias("br"), F.col("b.c").alias("bc"))
    return rows.groupBy("k", "i", "j").applyInPandas(join, _CHAIN)


def _ends() -> list[Column]:
    return [F.struct(F.col(f"{n}r").alias("r"), F.col(f"{n}c").alias("c")).alias(n) for n in "ab"]


def _linked(chains: DataFrame) -> DataFrame:
    """(id, pieces): which chains, and which of them backwards, make up each line; chains meet where their ends are equal.

    By contraction: in each round a hash deals heads and tails, each tail hangs itself on one neighbouring head, and lines
    shrink by a constant share of their pieces, however long they are. Ends meet two by two, since a grid edge has two sides.
    """
    state = chains.select("id", "k", *_ends(), F.array(F.struct("id", F.lit(False).alias("back"))).alias("pieces"))
    done = state.where("a = b").select("id", "pieces")
    state = state.where("a <> b")
    turned = lambda c: F.reverse(F.transform(c, lambda x: F.struct(x["id"].alias("id"), (~x["back"]).alias("back"))))
    for k in itertools.count():
        state = cut(state, f"contours-{k}")
        side = lambda c: state.select("k", F.col(c).alias("node"), "id", F.lit(c == "b").alias("last"))
        head = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0
        ends = side("a").unionByName(side("b")).withColumn("head", head)
        pairs = ends.groupBy("k", "node").agg(F.collect_list(F.struct("head", "id", "last")).alias("x")).where("size(x) = 2")  # a grid edge has two sides
        if pairs.isEmpty():
            break
        mixed = pairs.where("x[0].head <> x[1].head").select("node", F.sort_array("x").alias("x"))  # the tail comes first
        hung = mixed.groupBy(F.col("x")[0]["id"].alias("tail")).agg(F.min(F.struct("node", F.col("x")[0]["last"].alias("by"), F.col("x")[1]["id"].alias("to"), F.col("x")[1]["last"].alias("at"))).alias("h")).select("tail", "h.*")
        tail = state.select(F.col("id").alias("tail"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("pieces").alias("tp"))
        hung = hung.join(tail, "tail")
        # a tail after its head runs from the node, one before its head runs to it
        after = hung.where("at").select(F.col("to").alias("id"), F.when(F.col("by"), F.col("ta")).otherwise(F.col("tb")).alias("b2"), F.when(F.col("by"), turned("tp")).otherwise(F.col("tp")).alias("p2"))
        front = hung.where("not at").select(F.col("to").alias("id"), F.when(F.col("by"), F.col("ta")).otherwise(F.col("tb")).alias("a0"), F.when(F.col("by"), F.col("tp")).otherwise(turned("tp")).alias("p0"))
        none = F.expr("cast(array() as array<struct<id: string, back: boolean>>)")
        grown = state.join(hung.select(F.col("tail").alias("id")), "id", "left_anti").join(after, "id", "left").join(front, "id", "left")
        grown = grown.select("id", "k", F.coalesce("a0", "a").alias("a"), F.coalesce("b2", "b").alias("b"), F.concat(F.coalesce("p0", none), "pieces", F.coalesce("p2", none)).alias("pieces"))
        grown = cut(grown, f"contours-grown-{k}")
        done = done.unionByName(grown.where("a = b").select("id", "pieces"))
        drop(state)
        state = grown.where("a <> b")
    return done.unionByName(state.select("id", "pieces"))


def contours(dem: DataFrame, meta: RasterMeta, interval: float, sigma: float = 1.0, side: int = blocks.SIDE) -> DataFrame:
    """(level, is_index, line_id, closed, segments, coords): segments joined block by block, then blocks' chains by contraction."""
    if interval <= 0:
        raise ValueError("the contour interval must be positive")
    smooth = cut(morph.smooth_valid(dem, meta, sigma) if sigma > 0 else dem.where("value is not null"), "smooth")
    chains = cut(_chains(contour_segments(smooth, interval), side), "chains")
    lines = _linked(chains).select("id", F.posexplode("pieces").alias("pos", "piece")).select("id", "pos", F.col("piece.id").alias("piece"), "piece.back")
    each = chains.select(F.col("id").alias("piece"), "k", "segments", "coords", *_ends())
    rows = lines.join(each, "piece")
    coords = F.when(F.col("back"), F.reverse("coords")).otherwise(F.col("coords"))
    coords = F.when(F.col("pos") > 0, F.slice(coords, 2, F.size("coords"))).otherwise(coords)  # it begins where the one before ends
    begin, end = (F.when(F.col("back"), x).otherwise(y) for x, y in ((F.col("b"), F.col("a")), (F.col("a"), F.col("b"))))
    lines = rows.groupBy("id", "k").agg(F.sum("segments").alias("segments"), F.min_by(begin, "pos").alias("from"), F.max_by(end, "pos").alias("to"), F.sort_array(F.collect_list(F.struct("pos", coords.alias("c")))).alias("c"))
    flat = F.flatten(F.transform("c", lambda x: x["c"]))
    flat = F.filter(flat, lambda x, i: (i == 0) | (x != F.get(flat, i - 1)))  # a value on the level makes segments of no length
    at = F.transform(flat, lambda p: F.struct((meta.minx + (p["c"] + 0.5) * meta.cell).alias("x"), (meta.maxy - (p["r"] + 0.5) * meta.cell).alias("y")))
    closed = F.col("from") == F.col("to")
    out = lines.select((F.col("k") * interval).alias("level"), (F.col("k") % INDEX_EVERY == 0).alias("is_index"), F.col("id").alias("line_id"), closed.alias("closed"), "segments", at.alias("coords"))
    return out.where("size(coords) > 1")


# --- meshes -----------------------------------------------------------------------------------


def heightfield(points: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a regular mesh; rows count from the south, only whole quads have faces.

    Vertex numbers follow (row, col): counts of rows before, then a number within the row, so no
    task sees all vertices.
    """
    e = grid.extent(points).first()
    key = [F.floor((F.col("y") - e.miny) / cell).cast("long").alias("row"), F.floor((F.col("x") - e.minx) / cell).cast("long").alias("col")]
    cells = cut(points.groupBy(*key).agg(F.avg("z").alias("z"), *[F.avg(c).alias(c) for c in "rgb"]), "heightfield")
    rows = cells.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    before = rows.withColumn("before", F.sum("n").over(Window.orderBy("row")) - F.col("n")).select("row", "before")  # one row a grid row
    number = F.col("before") + F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    color = [F.least(F.greatest(F.floor(F.col(c)), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "rgb"]
    verts = cells.join(before, "row").select(
        "row", "col", number.cast("long").alias("vid"), (e.minx + (F.col("col") + 0.5) * cell).alias("x"), (e.miny + (F.col("row") + 0.5) * cell).alias("y"), "z", *color)
    verts = cut(verts, "vertices")
    out = verts.select("row", "col", F.col("vid").alias("a"))
    for name, (dr, dc) in {"b": (0, 1), "c": (1, 0), "d": (1, 1)}.items():
        out = out.join(verts.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("vid").alias(name)), ["row", "col"])
    two = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("c").alias("c")), F.struct(F.col("b").alias("a"), F.col("d").alias("b"), F.col("c").alias("c"))))
    return verts.drop("row", "col"), out.select(two.alias("f")).select("f.a", "f.b", "f.c")


def offset(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """A round offset that keeps shifted coordinates small."""
    return F.floor(x / 100) * 100.0, F.floor(y / 100) * 100.0, F.lit(0.0)


def sample_faces(verts: DataFrame, faces: DataFrame, most: int = 64, seed: int = 0) -> DataFrame:
    """Vertices, and about one random point a square metre of every face (at most ``most``)."""
    out = faces.withColumn("fid", F.xxhash64("a", "b", "c"))
    for n in "abc":
        out = out.join(verts.select(F.col("vid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), n)
    u = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    v = {c: F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"}
    cross = [u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]]
    area = 0.5 * F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    out = out.withColumn("n", F.least(F.ceil(area), F.lit(most)).cast("int")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    chance = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "fid", "i"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    out = out.withColumn("r1", F.sqrt(chance(1))).withColumn("r2", chance(2))
    a, b, c = 1 - F.col("r1"), F.col("r1") * (1 - F.col("r2")), F.col("r1") * F.col("r2")
    extra = out.select(*[(a * F.col(f"a{d}") + b * F.col(f"b{d}") + c * F.col(f"c{d}")).alias(d) for d in "xyz"])
    return verts.select("x", "y", "z").unionByName(extra)
