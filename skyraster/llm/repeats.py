"""Repeated passages, removed through suffix arrays.

A string of ``least`` bytes that starts in two places or more, anywhere in the table, repeats; each byte
that such a string covers goes. The table is dealt to shards by content, so that equal strings always meet:

1. Every string of ``least`` bytes has an anchor: among the ``anchor``-byte strings in it the one of least hash, of
   ties the first. Strings that follow one another share their anchor for a while; these, together, are a segment.
   Equal strings have equal anchors in the same place. Segments are rows (hash of the anchor, hashes of the segment's two
   ends, which are all of it), counted with partial sums.
2. Anchors that occur once are done. Segments that occur twice or more repeat as a whole. What is
   left are different segments with one anchor: of each, one text goes to the shard of its anchor.
3. A shard is a text of such segments, whose suffix array with common prefixes is made by external induced sorting
   (``induced``), on disk and of any size: a string of a segment that has ``least`` bytes in common with the suffix before or
   after it repeats, and no other does.
4. An anchor of more than ``hot`` bytes of different segments is split: its segments are cut into parts, strings with the anchor in
   nearly the same place, which meet by the bytes that all of them have in common; equal strings still meet. Parts are counted
   as segments are: equal ones repeat as a whole, and of different ones with common bytes one text each goes to a shard.

Exact copies and repeated segments are thus rows that are counted, never texts in a task, and texts that
share a passage meet in its anchors only.

Cases: null texts are empty; texts of fewer than ``least`` bytes stay; equal rows are copies like others; passages within one text, overlapping ones
included, repeat too; long texts are read in strips; doc_id may be null or repeated; empty tables give no rows; extra columns are ignored.
Segments are compared by 128 bits of hashes, strings in shards by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm import induced
from skyraster.llm.common import MANY, cut, ensure, release, remove, shared_dir, small_batches, spread_join

class Sizes(NamedTuple):
    """least: bytes of a string; anchor: bytes of an anchor; strip: bytes read at once; hot: bytes of different
    segments of one anchor beyond which it is split, and near: places of an anchor in a part; shard: bytes of a
    shard beyond which the next anchor begins a new one."""

    least: int = 400
    anchor: int = 128
    strip: int = 1 << 18
    hot: int = 250_000
    near: int = 8
    shard: int = 2_000_000


GAP = 0xF8  # no byte of UTF-8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEGMENT = "h long, g long, e long, start int, wide int, lead int, times int"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of neighbouring strings from those of both."""
    h = (a * _MIX[1]) ^ (b + (b >> np.uint64(29)))
    h *= _MIX[2]
    h ^= h >> np.uint64(31)
    return h


def _least_places(key: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(key)
    rows = np.concatenate([key, np.full(-n % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(text: np.ndarray, least: int, anchor: int, valid: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the segment, hash of its end, start, strings in it, anchor's place) of the segments of a text.

    ``valid``: the places where strings may start, if not all.
    """
    n = len(text)
    h = (text.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    size, at_anchor = 1, h
    while size < least:
        step = min(size, (anchor if size < anchor else least) - size)
        h = _mixed(h[: len(h) - step], h[step:])
        size += step
        if size == anchor:
            at_anchor = h
    bits = np.uint64(max(1, int(n).bit_length()))
    place = _least_places(at_anchor >> bits << bits | np.arange(len(at_anchor), dtype=np.uint64), least - anchor + 1)
    place = (place & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if valid is not None:
        place[~valid] = -1
    start = np.flatnonzero(np.diff(place, prepend=-2))
    wide = np.diff(np.append(start, len(place)))
    real = place[start] >= 0
    start, wide = start[real], wide[real]
    lead = place[start] - start
    end = h[start + wide - 1]
    whole = _mixed(_mixed(h[start], end), (wide.astype(np.uint64) << np.uint64(32)) + lead.astype(np.uint64))
    return at_anchor[place[start]], whole, end, start, wide, lead


def _all_segments(sizes: Sizes):
    """Segments of texts(node, text) of ``least`` bytes or more; equal neighbours are one row. Equal texts of a batch are counted, not read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = sizes.least - 1
        for batch in batches:
            copies: dict[bytes, list] = {}
            for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
                entry = copies.setdefault(node.as_py(), [text, 0])
                entry[1] += 1
            waiting: list[tuple[bytes, int, int, np.ndarray]] = []
            held = 0
            for node, (text, m) in copies.items():
                whole = np.frombuffer(text.as_buffer(), np.uint8)
                for lo in range(0, len(whole) - reach, sizes.strip):
                    waiting.append((node, m, lo, whole[lo : lo + sizes.strip + reach]))
                    held += len(waiting[-1][3])
                    if held >= sizes.strip:
                        yield _rows(waiting, sizes)
                        waiting, held = [], 0
            if waiting:
                yield _rows(waiting, sizes)
        release()

    return run


def _rows(strips: list[tuple[bytes, int, int, np.ndarray]], plan: Sizes) -> pa.RecordBatch:
    """Segments of strips, which are hashed side by side; none reaches over an edge between strips."""
    edge = np.concatenate([[0], np.cumsum([len(x[3]) for x in strips])])
    valid = np.ones(int(edge[-1]) - plan.least + 1, bool)
    for end in edge[1:-1].tolist():
        valid[end - plan.least + 1 : end] = False
    h, g, e, start, wide, lead = segments(np.concatenate([x[3] for x in strips]), plan.least, plan.anchor, valid)
    which = np.searchsorted(edge, start, side="right") - 1
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (which[1:] == which[:-1]) & (start[1:] == start[:-1] + wide[:-1])
    first = np.flatnonzero(~same)
    times = np.diff(np.append(first, len(h)))
    h, g, e, start, wide, lead, which = (x[first] for x in (h, g, e, start, wide, lead, which))
    offset = np.array([x[2] for x in strips]) - edge[:-1]
    nodes, m = pa.array([x[0] for x in strips], pa.binary()), np.array([x[1] for x in strips])
    as_long = [pa.array(x.view(np.int64)) for x in (h, g, e)]
    as_int = [pa.array(x.astype(np.int32)) for x in (start + offset[which], wide, lead, times, m[which])]
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(which)), *as_long, *as_int], names=["node", "h", "g", "e", "start", "wide", "lead", "times", "m"])


def _pieces(sizes: Sizes):
    """Bytes of the wanted segments, or parts, of (node, base, text, wanted), once for neighbouring equal texts; a text begins ``base`` bytes after its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[tuple] = []
            for k, this in enumerate(zip(batch.column("node").to_pylist(), batch.column("base").to_pylist(), strict=True)):
                if this == before:
                    continue
                before = node, base = this
                text = memoryview(batch.column("text")[k].as_buffer())
                for w in batch.column("wanted")[k].as_py():
                    at = w["start"] - base
                    out.append((w["h"], w["g"], w["e"], w["start"], w["wide"], w["lead"], w["copies"], node, bytes(text[at : at + w["wide"] + sizes.least - 1])))
            if out:
                yield _batch(out, _PIECE)
        release()

    return run


def _parts(sizes: Sizes):
    """Parts of pieces of hot anchors: hash of what their strings have in common, hash of the part, the piece's start, and the part's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, near = sizes.least, sizes.near
        for batch in batches:
            out: list[tuple] = []
            for base, wide, lead, copies, node, piece in zip(*[batch.column(x).to_pylist() for x in ("start", "wide", "lead", "copies", "node", "piece")], strict=True):
                for j in range((lead - wide + 1) // near, lead // near + 1):  # strings with the anchor near * j or more bytes ahead
                    lo, hi = max(0, lead - near * j - near + 1), min(wide - 1, lead - near * j)
                    core = hashlib.blake2b(piece[lead - near * j : lead - near * j - near + 1 + least], digest_size=8, salt=j.to_bytes(4, "little")).digest()
                    part = hashlib.blake2b(piece[lo : hi + least], digest_size=16).digest()
                    out.append((*[int.from_bytes(x, "little", signed=True) for x in (core, part[:8], part[8:])], base, base + lo, hi - lo + 1, copies, node))
            if out:
                yield _batch(out, _PART)
        release()

    return run


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


_PIECE = pa.schema({"h": pa.int64(), "g": pa.int64(), "e": pa.int64(), "start": pa.int32(), "wide": pa.int32(), "lead": pa.int32(), "copies": pa.int64(), "node": pa.binary(), "piece": pa.binary()})
_PIECES = "h long, g long, e long, start int, wide int, lead int, copies long, node binary, piece binary"
_PART = pa.schema({"h": pa.int64(), "g": pa.int64(), "e": pa.int64(), "base": pa.int32(), "start": pa.int32(), "wide": pa.int32(), "copies": pa.int64(), "node": pa.binary()})
_PARTS = "h long, g long, e long, base int, start int, wide int, copies long, node binary"


def repeated(texts: list[np.ndarray], wide: np.ndarray, least: int) -> np.ndarray:
    """For every string of a shard's pieces, piece after piece (the first ``wide`` of each), whether it starts elsewhere too."""
    sizes = np.array([len(x) for x in texts]) + 1
    edge = np.concatenate([[0], np.cumsum(sizes)])
    with induced.Scratch() as scratch:
        whole = scratch.array(int(edge[-1]), "u1")
        for lo, x in zip(edge[:-1].tolist(), texts, strict=True):
            whole[lo : lo + len(x)] = x
            whole[lo + len(x)] = GAP
        order, shared = induced.suffixes(whole, least, scratch)
        hit = scratch.array(len(whole), "u1")
        for lo, hi in induced.blocks(len(whole)):
            long = np.flatnonzero(shared[lo:hi] >= least) + lo
            hit[order[long]] = 1
            hit[order[long - 1]] = 1
        return hit[np.repeat(edge[:-1] - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))].astype(bool)


def _shards(sizes: Sizes):
    """(node, start, end) of repeated strings, from pieces in order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = sizes.least
        group: list[tuple] = []
        shard: list[tuple] = []
        key, before, held = None, None, 0

        def solve() -> pa.RecordBatch:
            wide = np.array([x[1] for x in shard])
            hit = repeated([np.frombuffer(x[3], np.uint8) for x in shard], wide, least)
            which, place = np.repeat(np.arange(len(shard)), wide), np.arange(len(hit)) - np.repeat(np.cumsum(wide) - wide, wide)
            hit &= np.array([x[4] == 1 for x in shard])[which]  # others repeat as a whole
            first = hit & ~(np.append(False, hit[:-1]) & (place > 0))
            final = hit & ~(np.append(hit[1:], False) & np.append(place[1:] > 0, False))
            a, b = np.flatnonzero(first), np.flatnonzero(final)
            start = np.array([x[0] for x in shard])[which[a]]
            return pa.RecordBatch.from_arrays([pa.array([x[2] for x in shard], pa.binary()).take(pa.array(which[a])), pa.array((start + place[a]).astype(np.int32)), pa.array((start + place[b] + least).astype(np.int32))], names=["node", "start", "end"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["h"] != key:
                    if len(group) > 1:  # a segment by itself has its strings once
                        shard += group
                        held += sum([len(x[3]) for x in group])
                    group, key, before = [], r["h"], None
                    if held >= sizes.shard:
                        yield solve()
                        shard, held = [], 0
                        release()
                this = (r["g"], r["e"])
                if this != before:
                    group.append((r["start"], r["wide"], r["node"], r["piece"], r["copies"]))
                    before = this
        if len(group) > 1:
            shard += group
        if shard:
            yield solve()
        release()

    return run


def _fewer_copies(texts: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """texts(node, text) with those of very many copies once; rows: the segments of all that have copies."""
    copies = rows.where("start = 0").groupBy("node").agg(F.sum("m").alias("n"))
    often = cut(copies.where(F.col("n") > 1000).select("node", "n"), f"{folder}/often")
    total = often.agg(F.sum("n")).first()[0]
    if total is None:
        return texts
    often = F.broadcast(often.where(F.col("n") > total // MANY).select("node"))  # at most MANY keys
    once = texts.join(often, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return texts.join(often, "node", "left_anti").unionByName(once)


def _split(pieces: DataFrame, folder: str, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """(node, start, wide, times) of the parts of pieces that repeat as a whole; pieces of the different parts that have bytes in common."""
    pieces = cut(pieces.dropDuplicates(["h", "g", "e"]), f"{folder}/split")
    parts = cut(pieces.mapInArrow(_parts(sizes), _PARTS), f"{folder}/parts")
    kinds = cut(parts.groupBy("h", "g", "e").agg(F.sum("copies").alias("copies"), F.min(F.struct("node", "base", "start", "wide")).alias("one")).select("h", "g", "e", "copies", "one.*"), f"{folder}/partkinds")
    count = parts.agg(F.sum("copies")).first()[0]
    again = spread_join(parts.where("copies = 1").drop("copies"), kinds.where("copies > 1").select("h", "g", "e", "copies"), ["h", "g", "e"], "copies", count, "inner")  # the others repeat with their segments
    several = kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    wanted = kinds.join(several, "h", "left_semi").groupBy("node", "base").agg(F.collect_list(F.struct("h", "g", "e", "start", "wide", F.lit(0).alias("lead"), "copies")).alias("wanted"))
    texts = pieces.select("node", F.col("start").alias("base"), F.col("piece").alias("text"))
    return again.select("node", "start", "wide", F.lit(1).alias("times")), texts.join(wanted, ["node", "base"]).select("node", "base", "text", "wanted").mapInArrow(_pieces(sizes), _PIECES)


def marks(texts: DataFrame, folder: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(node, runs) of texts(node, text): ranges of bytes, in no order and overlapping, that repeat."""
    long = texts.where(F.octet_length("text") >= sizes.least)
    rows = cut(long.mapInArrow(_all_segments(sizes), f"node binary, {_SEGMENT}, m int"), f"{folder}/segments")
    total = F.sum(F.col("m").cast("long") * F.col("times"))
    anchors = rows.groupBy("h").agg(total.alias("n"), F.min("g").alias("low"), F.max("g").alias("high"), F.min("e").alias("first"), F.max("e").alias("last"))
    anchors = cut(anchors.where("n > 1").select("h", "n", F.expr("low <> high or first <> last").alias("several")), f"{folder}/anchors")
    count = anchors.agg(F.sum("n")).first()[0] or 0
    rows = cut(spread_join(rows, anchors, "h", "n", count, "inner").drop("n"), f"{folder}/rows")
    remove(texts.sparkSession, f"{folder}/segments")
    whole = rows.where("not several").select("node", "start", "wide", "times")
    kinds = rows.where("several").groupBy("h", "g", "e").agg(total.alias("copies"), F.min(F.struct("node", "start", "wide", "lead")).alias("one"))
    kinds = cut(kinds.select("h", "g", "e", "copies", "one.*"), f"{folder}/kinds")
    again = spread_join(rows.where("several"), kinds.where("copies > 1").select("h", "g", "e", "copies"), ["h", "g", "e"], "copies", count, "inner").select("node", "start", "wide", "times")
    hot = cut(kinds.groupBy("h").agg(F.sum(F.col("wide") + sizes.least).alias("size")).where(F.col("size") > sizes.hot).select("h"), f"{folder}/hot")
    wanted = kinds.groupBy("node").agg(F.collect_list(F.struct("h", "g", "e", "start", "wide", "lead", "copies")).alias("wanted"))
    pieces = _fewer_copies(long, rows, folder).withColumn("base", F.lit(0)).join(wanted, "node").select("node", "base", "text", "wanted").mapInArrow(_pieces(sizes), _PIECES)
    runs = whole.union(again)
    if not hot.isEmpty():
        pieces = cut(pieces, f"{folder}/pieces")
        repeats, parts = _split(pieces.join(hot, "h", "left_semi"), folder, sizes)
        pieces, runs = pieces.join(hot, "h", "left_anti").unionByName(parts), runs.union(repeats)
    part = pieces.repartition("h").sortWithinPartitions("h", "g", "e").mapInArrow(_shards(sizes), "node binary, start int, end int")
    runs = runs.selectExpr("node", "start", f"start + wide * times + {sizes.least - 1} as end").union(part)
    return cut(runs.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("runs")), f"{folder}/marks")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the runs together, and what is left of the text."""
    for batch in batches:
        spans, kept = [], []
        for k, runs in enumerate(batch.column("runs")):
            text = batch.column("text")[k].as_buffer()
            if not runs.is_valid or not len(runs):
                spans.append([])
                kept.append(text.to_pybytes())
                continue
            found = runs.values.flatten()
            a, b = found[0].to_numpy(), found[1].to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            begin, end = a[new].tolist(), b[np.append(new[1:], True)].tolist()
            view = memoryview(text)
            spans.append([{"start": x, "end": y} for x, y in zip(begin, end, strict=True)])
            kept.append(b"".join([view[x:y] for x, y in zip([0, *end], [*begin, len(view)], strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])


def remove_repeats(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, spans (byte ranges that were removed), kept (the other bytes) of every row."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = ensure(docs, doc_id="long", text="string").withColumn("text", text).withColumn("node", F.unhex(F.md5("text")))
    with small_batches(spark, 2000):
        found = marks(rows.select("node", "text"), folder, sizes)
    for name in ("rows", "anchors", "kinds", "often", "hot", "pieces", "split", "parts", "partkinds"):
        remove(spark, f"{folder}/{name}")
    return rows.join(found, "node", "left").select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, spans array<struct<start: int, end: int>>, kept binary")


def report(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = remove_repeats(docs, sizes)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", (F.octet_length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
