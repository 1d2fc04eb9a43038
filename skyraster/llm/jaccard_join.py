"""Exact n-gram Jaccard links between documents, with Bayesian candidate pruning.

A text is the set of its runs of five words (words are split at white space; a text of fewer
words, but not none, is one run). Two documents are linked if the Jaccard similarity of their
sets is ``THRESHOLD`` or more. The result is one row a document: its class (the smallest doc_id
it is connected with) and its number of links (documents linked with it, copies included).

1. Equal texts are one node; what follows works on nodes, and copies count as weights.
2. ``HASHES`` MinHash values a node, in bands of ``ROWS``: nodes that share a band are compared
   value by value, ``STEP`` at a time. With a uniform prior the posterior that the similarity
   reaches the threshold after m matches of n is P(Binomial(n + 1, threshold) <= m); a pair goes
   as soon as this falls below ``TOLERANCE``. A bucket's surviving pairs matter only by their
   components: those are searched breadth first, each node against the nodes not reached yet, and
   leave as stars, so a bucket of m nodes yields at most m - 1 rows, and a tight one little work.
3. The stars' components hold every surviving pair, and all pairs inside each are verified on the
   full sets: counts of links, and again stars, whose components are the classes. For that a text is
   shipped once, to be compared with its component's reference text (the least node): what it
   has less or more than that, its difference, is all that goes on. With r shingles of the reference R
   missing, |A and B| = |R| - r(A) - r(B) + |difference of A and difference of B|.

Buckets of more than ``BUCKET`` nodes and components of more than ``BLOCK`` are cut into blocks, and what two blocks have
to do with each other is a task's work of bounded size; nothing is capped. A large bucket's nodes are first searched block by block,
with other blocks in each band; most are in one component then, and only nodes outside of it still meet the other blocks.
Keys that many rows share are looked up in a broadcast (``common.spread_join``): of those there can only be few. A component's differences go
to up to ``SPREAD`` blocks of pairs each, to more only if blocks would grow over ``MOST``. Pairs are
lost only as the method has it: a pair at exactly the threshold shares no band with probability 3e-6, and
is pruned with about TOLERANCE.

Cases: null, empty and wordless texts link to nothing and are their own class; equal rows are
copies of each other; an empty table gives no rows; a null doc_id is carried along, and is a
class's id only if the class has no other; extra columns are ignored by ``join``, kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, release, remove, shared_dir, small_batches, spread_join
from skyraster.llm.graph import components

NGRAM = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 24
HASHES = ROWS * BANDS
STEP = 16
TOLERANCE = 1e-8
BLOCK = 128
SPREAD = 32
MOST = 8192
BUCKET = 1024
PART_SHINGLES = 1 << 19
CELLS = 1 << 22
MAX_BROADCAST = 300_000
MEMO = 200_000

_RNG = np.random.default_rng(20_240_229)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(NGRAM)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
SPACE = bytes([9, 10, 11, 12, 13, 32])


class _Words(dict):
    """Word -> 64-bit hash, each word hashed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of NGRAM words."""
    words = text.split() if text else []  # bytes split at exactly the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - NGRAM + 1)
    h = np.full(n, min(len(w), NGRAM), np.uint64)
    for k in range(min(NGRAM, len(w))):
        h += w[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (uint32) of a non-empty set."""
    out = np.empty(HASHES, np.uint32)
    for k in range(HASHES):
        out[k] = (h * _MUL[k] + _ADD[k]).min() >> np.uint64(32)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> fewest matches among n values whose posterior of reaching the threshold is tolerable."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


def _alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` outlive the pruning against ``one``."""
    left = np.arange(len(many))
    m = np.zeros(len(many), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        m = m + (many[left, n - STEP : n] == one[n - STEP : n]).sum(1)
        keep = m >= _LEAST[n]
        left, m = left[keep], m[keep]
        if not len(left):
            break
    return left


def reached(sig: np.ndarray) -> list[list[int]]:
    """Components (of two or more) of the surviving pairs, breadth first."""
    out, left = [], np.arange(len(sig))
    while len(left) > 1:
        found, left, at = [int(left[0])], left[1:], 0
        while at < len(found) and len(left):
            hit = _alike(sig[found[at]], sig[left])
            at += 1
            if len(hit):
                found += left[hit].tolist()
                left = np.delete(left, hit)
        if len(found) > 1:
            out.append(found)
    return out


def _stars(groups: list[list[int]], node: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Edges from each group's smallest node to the others."""
    u, v = [], []
    for group in groups:
        names = sorted(node[k] for k in group)
        u += names[:1] * (len(names) - 1)
        v += names[1:]
    return u, v


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, whole, from batches in key order."""
    held: list[pa.Table] = []

    def key(t: pa.Table, k: int) -> tuple:
        return tuple(t.column(c)[k].as_py() for c in keys)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        columns = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), t.num_rows]
        if held and key(held[0], 0) != key(t, 0):
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == t.num_rows:
                held.append(t.slice(a, b - a))
            elif held:
                yield pa.concat_tables([*held, t.slice(a, b - a)])
                held = []
            else:
                yield t.slice(a, b - a)
    if held:
        yield pa.concat_tables(held)


def node_of(text: str) -> Column:
    """What stands for all rows with this text."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (text hash), sig (null for wordless texts), n (size of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sigs, sizes = [], []
            for k in range(batch.num_rows):
                h = shingles(texts[k].as_py())
                sigs.append(signature(h).tobytes() if len(h) else None)
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "node", "sig", "n"])
        release()

    rows = ensure(docs, doc_id="long", text="string").select("doc_id", "text", node_of("text").alias("node"))
    return rows.mapInArrow(run, "doc_id long, node binary, sig binary, n long")


def _block_pairs(rows: DataFrame, n_blocks: Column) -> DataFrame:
    """Rows with their block of n_blocks, once for each pair of blocks (bi <= bj) that holds it."""
    out = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return out.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("n_blocks", "other")


def _searched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v) stars over the components of surviving pairs in each group of (keys, node, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            found = reached(sig)
            if found:
                u, v = _stars(found, group.column("node").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
        release()

    return rows.select(*keys, "node", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u binary, v binary")


def candidates(nodes: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """(u, v) stars over the components of the pairs that share a band and outlive the pruning."""
    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substr(F.col("sig"), k * width + 1, F.lit(width)), k))
    rows = nodes.select("node", F.explode(keys).alias("band"))
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{folder}/sizes")
    shared = cut(spread_join(rows, sizes, "band", "size", BANDS * nodes.count(), "inner"), f"{folder}/bands")
    sigs = nodes.select("node", "sig")
    block = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / bucket)).cast("int")  # bands part the nodes in different ways
    first = _searched(shared.select("band", "node", block.alias("block")).join(sigs, "node"), ["band", "block"])
    large = shared.where(F.col("size") > bucket)
    if sizes.where(F.col("size") > bucket).isEmpty():
        return first
    first = cut(first, f"{folder}/first")
    label = components(first, folder, "first-labels")
    large = cut(large.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), f"{folder}/large")
    each = large.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("n")).where("all > n")
    if most.isEmpty():  # every large band is one component
        return first
    few = F.broadcast(most) if most.count() <= MAX_BROADCAST else most
    left = large.join(few, "band").withColumn("rest", F.col("label") != F.col("most"))
    # blocks of the greatest component's nodes, then blocks of all others; a pair of blocks of the former has nothing left to find
    inner, outer = F.ceil(F.col("n") / bucket).cast("int"), F.ceil((F.col("all") - F.col("n")) / bucket).cast("int")
    own = F.when(F.col("rest"), inner + F.pmod(F.xxhash64("node", "band"), outer)).otherwise(F.pmod(F.xxhash64("node", "band"), inner)).cast("int")
    other = F.when(F.col("rest"), F.sequence(F.lit(0), inner + outer - 1)).otherwise(F.sequence(inner, inner + outer - 1))
    pairs = left.select("band", "node", own.alias("own"), F.explode(other).alias("other"))
    pairs = pairs.select("band", "node", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    return first.unionByName(_searched(pairs.join(sigs, "node"), ["band", "bi", "bj"]))


def pairs_left(docs: DataFrame) -> DataFrame:
    """(step, pairs): pairs of different texts in a band of up to BUCKET texts, and how many of them outlive the pruning after so many values."""
    nodes = sign(docs).where("sig is not null").groupBy("node").agg(F.first("sig").alias("sig"))
    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substr(F.col("sig"), k * width + 1, F.lit(width)), k))
    rows = nodes.select("node", "sig", F.explode(keys).alias("band"))
    few = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(f"size between 2 and {BUCKET}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [0, *range(STEP, HASHES + 1, STEP)]
        left = dict.fromkeys(steps, 0)
        for group in _groups(batches, ["band"]):
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            for k in range(len(sig)):
                same = np.cumsum(sig[k + 1 :] == sig[k], axis=1)
                alive = np.ones(len(same), bool)
                for n in steps:
                    alive = alive & (same[:, n - 1] >= _LEAST[n]) if n else alive
                    left[n] += int(alive.sum())
        yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int32()), pa.array([left[n] for n in steps], pa.int64())], names=["step", "pairs"])

    found = rows.join(few, "band").select("band", "sig").repartition("band").sortWithinPartitions("band").mapInArrow(run, "step int, pairs long")
    return found.groupBy("step").agg(F.sum("pairs").alias("pairs"))


def _shared(d: list[np.ndarray], e: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) strip by strip: how many elements each set of d shares with each of e."""
    names, owner = np.concatenate(e) if e else np.zeros(0, np.uint64), np.repeat(np.arange(len(e)), [len(x) for x in e])
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    strip = max(1, CELLS // max(len(e), 1))
    for lo in range(0, len(d), strip):
        part = d[lo : lo + strip]
        counts = np.zeros(len(part) * len(e), np.int64)
        wanted, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        first, last = np.searchsorted(names, wanted), np.searchsorted(names, wanted, side="right")
        hits = last - first
        ends = np.cumsum(hits)
        at = 0
        while at < len(wanted):  # a bounded number of meetings at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            n = hits[at:to]
            stop = np.cumsum(n)
            place = np.repeat(first[at:to] - (stop - n), n) + np.arange(int(stop[-1]))
            counts += np.bincount(np.repeat(row[at:to], n) * len(e) + owner[place], minlength=len(counts))
            at = to
        yield lo, counts.reshape(len(part), len(e))


def _reaches(both: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return both >= threshold * (a + b - both) - 1e-9


def linked(ref: int, diffs: list[np.ndarray], less: np.ndarray, size: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each node, label of its component) from the pairs of left with right, or within left, that reach the threshold."""
    links, label = np.zeros(len(diffs), np.int64), np.arange(len(diffs))
    other = left if right is None else right
    for lo, counts in _shared([diffs[k] for k in left], [diffs[k] for k in other]):
        mine = left[lo : lo + len(counts)]
        both = counts + (ref - less[mine][:, None] - less[other][None, :])
        ok = _reaches(both, size[mine][:, None], size[other][None, :], threshold)
        if right is None:
            ok &= np.arange(len(other))[None, :] > np.arange(lo, lo + len(mine))[:, None]
        links[mine] += ok @ copies[other]
        links[other] += copies[mine] @ ok
        for k in np.flatnonzero(ok.any(1)):
            near = other[ok[k]]
            old = np.unique(np.append(label[near], label[mine[k]]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return links, label


def differences(rows: DataFrame) -> DataFrame:
    """label, size, ref (its number of shingles), node, copies, n, less and diff of each node of (label, part, size, node, copies, text).

    Each part of a label holds the reference's row too, which has node = label.
    """
    kind = "label binary, size long, ref long, node binary, copies long, n long, less long, diff binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["label", "part"]):
            label, texts = group.column("label")[0].as_py(), group.column("text").cast(pa.binary())
            node, home = group.column("node").to_pylist(), group.column("home").to_pylist()
            ref = shingles(texts[node.index(label)].as_py())
            out: dict[str, list] = {k: [] for k in ("node", "copies", "n", "less", "diff")}
            seen = set()
            for k in range(group.num_rows):
                if not home[k] or node[k] in seen:  # the reference is at home in one part; equal rows of the table are one node
                    continue
                seen.add(node[k])
                h = shingles(texts[k].as_py())
                both = np.intersect1d(ref, h, True)
                diff = np.setxor1d(ref, h, True)
                for c, v in (("node", node[k]), ("copies", group.column("copies")[k].as_py()), ("n", len(h)), ("less", len(ref) - len(both)), ("diff", diff.tobytes())):
                    out[c].append(v)
            m = len(out["node"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * m, pa.binary()), pa.array([group.column("size")[0].as_py()] * m, pa.int64()), pa.array([len(ref)] * m, pa.int64()), pa.array(out["node"], pa.binary()),
                 *[pa.array(out[c], pa.int64()) for c in ("copies", "n", "less")], pa.array(out["diff"], pa.binary())],
                names=["label", "size", "ref", "node", "copies", "n", "less", "diff"])
        release()

    keys = ["label", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, n): links of node u counted in documents (v null), and star edges (n null)."""
    members = groups.join(nodes.select("node", "rep", "copies", "n"), "node")
    members = cut(members, f"{folder}/members")
    sums = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    wanted = members.join(sums, "label").withColumn("parts", F.greatest(F.ceil(F.col("total") / PART_SHINGLES), F.ceil(F.col("size") / BLOCK)).cast("int"))
    wanted = cut(wanted.withColumnRenamed("node", "wanted").drop("n", "total"), f"{folder}/wanted")
    texts = ensure(docs, doc_id="long", text="string").withColumn("node", node_of("text"))
    small = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    rows = texts.join(small, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.when(F.col("node") == F.col("label"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.select("label", F.explode(every).alias("part"), "size", "node", "copies", "text", own.alias("own"))
    diffs = differences(rows.withColumn("home", F.col("part") == F.col("own")).drop("own"))
    n_blocks = F.greatest(F.ceil(F.col("size") / MOST), F.least(F.lit(SPREAD), F.ceil(F.col("size") / BLOCK)))
    keys = ["label", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            node, block = group.column("node").to_pylist(), group.column("block").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("diff").to_pylist()]
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            left, right = np.flatnonzero(block == bi), None if bi == bj else np.flatnonzero(block == bj)
            counts = [group.column(c).to_numpy() for c in ("less", "n", "copies")]
            links, label = linked(group.column("ref")[0].as_py(), sets, *counts, left, right, threshold)
            inside: dict[int, list[int]] = {}
            for k, x in enumerate(label.tolist()):
                inside.setdefault(x, []).append(k)
            u, v = _stars([x for x in inside.values() if len(x) > 1], node)
            some = np.flatnonzero(links).tolist()
            n = [None] * len(u) + links[some].tolist()
            u, v = u + [node[k] for k in some], v + [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], names=["u", "v", "n"])
        release()

    pairs = _block_pairs(diffs, n_blocks).select(*keys, "block", "ref", "node", "copies", "n", "less", "diff")
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return cut(pairs.mapInArrow(run, "u binary, v binary, n long"), f"{folder}/links")


def _join(docs: DataFrame, folder: str, threshold: float) -> DataFrame:
    """doc_id, node, worded, class_id, n_links of every row; and of each class the row that stands for it: chosen, chosen_node."""
    with small_batches(docs.sparkSession):
        signed = cut(sign(docs), f"{folder}/signed")
    work = f"{folder}/work"
    nodes = signed.where("sig is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = cut(nodes, f"{work}/nodes")
    groups = components(candidates(nodes, work), work, "candidates")
    links = verify(docs, nodes, groups, work, threshold)
    found = components(links.where("n is null"), work, "classes").join(nodes.select("node", "rep"), "node")
    least = F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("least")
    classes = found.join(found.groupBy("label").agg(least), "label").select("node", F.col("least.rep").alias("class_id"), F.col("least.node").alias("chosen_node"))
    counts = links.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    per_node = nodes.select("node", "rep", "copies").join(classes, "node", "left").join(counts, "node", "left").select(
        "node", F.when(F.col("chosen_node").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("chosen_node", "node").alias("chosen_node"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    per_node = cut(per_node, f"{folder}/per_node")
    remove(docs.sparkSession, work)
    rows = signed.select("doc_id", "node", F.col("sig").isNotNull().alias("worded"))
    out = spread_join(rows, per_node, "node", "copies", rows.count())
    return out.select("doc_id", "node", "worded", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(F.col("worded"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "chosen_node")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id, n_links."""
    return _join(docs, shared_dir(docs.sparkSession), threshold).select("doc_id", "class_id", "n_links")


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class (of its smallest doc_id, nulls last, then text hash), columns unchanged."""
    folder = shared_dir(docs.sparkSession)
    work = f"{folder}/join"
    found = cut(_join(docs.select("doc_id", "text"), work, threshold), f"{work}/found")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("chosen_node"))
    gone = found.where(F.col("worded") & ~stays).select(F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node")).distinct()
    gone = cut(gone, f"{folder}/gone")
    again = found.where(F.col("worded") & stays).groupBy("doc_id", "node").count().where("count > 1")
    again = cut(again.select(F.col("doc_id").alias("_again"), F.col("node").alias("_again_node")), f"{folder}/again")
    remove(docs.sparkSession, work)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), node_of("text").alias("_node"))
    rows = rows.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, F.col("_doc").eqNullSafe(F.col("_gone")) & (F.col("_node") == F.col("_gone_node")), "left_anti")
    if not again.isEmpty():
        same = F.col("_doc").eqNullSafe(F.col("_again")) & (F.col("_node") == F.col("_again_node"))
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["_doc", "_node"]))
    return rows.select("_row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.8::double * (p.n + q.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM link WHERE link.x = d.doc_id)::bigint AS n_links
FROM d
"""
