"""Ranked lexical search of all documents for a set of items, by a threshold-seeded join.

Items come in blocks of bounded size; a block's terms are numbered and broadcast. One scan counts, for
every document, all its terms and how often it holds the block's, and writes that as a table of
postings by document. From the table follow the statistics, then for every term its ``k`` highest
impacts (w times the saturated frequency) of all documents. An item's score is a sum of its terms' impacts, so

* the kth impact of any one term, times how often the item has it, bounds the item's kth score from below;
* an item's terms in falling order of their highest impact have suffixes whose highest impacts do not add up to the
  bound: a document with none but those cannot be among the first k, so they find no candidates.

The join of postings and the terms that are left is made batch by batch of documents: pairs that a leading term brings
together are candidates; those whose leading impacts and the suffix bound stay below the
threshold are dropped, and all others are scored exactly, over all terms. A task keeps the k
best of each item and raises the item's threshold by them; the tasks' results are ranked at the end.

Cases: null and empty texts have no terms, do not count in N, and are never found; an item without terms, or with none
that a document holds, has no rows; rows of ``benchmark`` are items each, even if item_id is repeated or null; repeated documents
each count and rank; equal scores rank by doc_id, null last; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, release, remove, shared_dir

TOP = 20
BLOCK_TERMS = 400_000  # terms of the items that are broadcast at once, repeats included
CELLS = 4_000_000  # (document, term) places of impacts that are laid out side by side
SHARES = 64
K1, MASS = 12, 1_000_000_000
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_NONE = -(2**62)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and whatever is not ASCII; A-Z lower-cased."""
    return text.translate(_KEEP).split()


class Items:
    """A block of items as lists of numbered terms, with how often an item has each."""

    def __init__(self, block: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.terms, self.counts = [], []
        for words in block:
            ids, n = np.unique(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64), return_counts=True)
            self.terms.append(ids)
            self.counts.append(n.astype(np.int64))


def _postings(numbers):
    """A document's number of terms, and the block's terms that it holds with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            size, ids, tf = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text) if text else []
                found = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
                u, c = np.unique(found[found >= 0], return_counts=True)
                size.append(len(words))
                ids.append(u.astype("<u4").tobytes())
                tf.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n by document; document, term and frequency by posting) of a batch of postings."""
    n = batch.column("n").to_numpy()
    raw = batch.column("terms").to_pylist()
    doc = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    return n, doc, np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.frombuffer(b"".join(batch.column("tf").to_pylist()), "<u4").astype(np.int64)


class Scale:
    """Impacts of terms: whole numbers, from the number of documents, their terms, and the terms' documents."""

    def __init__(self, docs: int, words: int, df: np.ndarray):
        self.docs, self.words = docs, words
        with np.errstate(divide="ignore"):
            self.weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)

    def impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * self.docs // max(self.words, 1)
        return self.weight[term] * (MASS * tf // (1000 * tf + K1 * m[doc]))


def _best(term: np.ndarray, impact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest impacts of each term, by term."""
    order = np.lexsort((-impact, term))
    term, impact = term[order], impact[order]
    first = np.searchsorted(term, term)
    keep = np.arange(len(term)) - first < k
    return term[keep], impact[keep]


def _search(items: Items, scale: Scale, seeds: np.ndarray, highest: np.ndarray, k: int):
    """Candidates of a block of items and their exact scores, the k best of each task."""
    plans = []
    for ids, counts in zip(items.terms, items.counts, strict=True):
        top = highest[ids] * counts
        order = np.argsort(-top, kind="stable")
        rest = np.concatenate([np.cumsum(top[order][::-1])[::-1], [0]])  # what the terms from here on can add
        plans.append((ids, counts, order, rest, max([1, *(seeds[ids] * counts).tolist()])))
    rows, width = len(plans), len(items.number)
    step = max(1, min(512, CELLS // max(width, 1)))  # documents at a time

    def leading(r: int, least: int) -> int:
        return int(np.searchsorted(-plans[r][3], -least, side="right"))  # suffixes below ``least`` begin here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [p[4] for p in plans]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in plans]
        holds = np.zeros(width + 1, np.int64)

        def leads() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
            """term -> (item, count) of all leading terms, as ranges of two arrays."""
            cuts = [leading(r, least[r]) for r in range(rows)]
            ids = np.concatenate([plans[r][0][plans[r][2][: cuts[r]]] for r in range(rows)] or [np.zeros(0, np.int64)])
            counts = np.concatenate([plans[r][1][plans[r][2][: cuts[r]]] for r in range(rows)] or [np.zeros(0, np.int64)])
            item = np.repeat(np.arange(rows), cuts)
            order = np.argsort(ids, kind="stable")
            np.cumsum(np.bincount(ids, minlength=width), out=holds[1:])
            return item[order], counts[order], holds.copy(), cuts

        for batch in batches:
            n, doc, term, tf = _flat(batch)
            unnamed = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            impact = scale.impacts(n, doc, term, tf)
            ends = np.searchsorted(doc, np.arange(0, len(n) + step, step))
            for part, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                base = part * step
                item, counts, starts, cuts = leads()
                d, t, v = doc[lo:hi] - base, term[lo:hi], impact[lo:hi]
                # the join: postings of leading terms meet the items that they lead
                many = starts[t + 1] - starts[t]
                which = np.repeat(np.arange(len(t)), many)
                place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[t], many)
                pair, where = np.unique(item[place] * step + d[which], return_inverse=True)
                some = np.zeros(len(pair), np.int64)
                np.add.at(some, where, v[which] * counts[place])
                rest = np.array([plans[r][3][cuts[r]] for r in range(rows)], np.int64)
                pair = pair[some + rest[pair // step] >= np.array(least, np.int64)[pair // step]]
                side = np.zeros((min(step, len(n) - base), width), np.int64)
                side[d, t] = v
                bounds = np.searchsorted(pair, np.arange(rows + 1) * step)
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    found = pair[bounds[r] : bounds[r + 1]] % step
                    score = side[np.ix_(found, plans[r][0])] @ plans[r][1]
                    good = score >= least[r]
                    if not good.any():
                        continue
                    at = found[good] + base
                    s, i, z = (np.concatenate(x) for x in zip(best[r], (score[good], ids[at], unnamed[at]), strict=True))
                    order = np.lexsort((i, z, -s))[:k]
                    best[r] = (s[order], i[order], z[order])
                    if len(order) == k:
                        least[r] = max(least[r], int(s[order[-1]]))
        for r, (s, i, z) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), r), pa.int32()), pa.array(i, pa.int64(), mask=z), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])
        release()

    return run


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, ids: list, block: list[list[bytes]], k: int, folder: str) -> DataFrame:
    """item_id, rank, doc_id, score of a block of items."""
    spark, items = docs.sparkSession, Items(block)
    width = len(items.number)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_, words = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            n, _, term, _ = _flat(batch)
            df += np.bincount(term, minlength=width)
            docs_, words = docs_ + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, width), pa.int64()), pa.array([docs_, words, *df.tolist()], pa.int64())], names=["term", "n"])

    numbers = spark.sparkContext.broadcast(items.number)  # bounded by BLOCK_TERMS
    table = cut(docs.mapInArrow(_postings(numbers), "doc_id long, n long, terms binary, tf binary"), f"{folder}/postings")
    totals = np.zeros(width + 2, np.int64)
    for r in table.mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        totals[r.term + 2] = r.n
    scale = Scale(int(totals[0]), int(totals[1]), totals[2:])

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % SHARES
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            n, doc, t, tf = _flat(batch)
            term, impact = _best(np.concatenate([term, t]), np.concatenate([impact, scale.impacts(n, doc, t, tf)]), k)
        starts = np.searchsorted(term, np.unique(term)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)), pa.int32()), pa.array(impact, pa.int64()))
        u = np.unique(term)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(np.full(len(u), part), pa.int32()), lists], names=["term", "share", "top"])

    # k a task, then k a share of the tasks, then k
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top")
    tops = table.mapInArrow(impacts, "term long, share int, top array<long>").groupBy("term", "share").agg(merged).groupBy("term").agg(merged)
    seeds, highest = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for r in tops.select("term", F.element_at("top", 1).alias("first"), F.when(F.size("top") == k, F.element_at("top", k)).alias("last")).collect():
        highest[r.term], seeds[r.term] = r.first, r.last or 0
    found = table.mapInArrow(_search(items, scale, seeds, highest, k), "item int, doc_id long, score long").withColumn("share", F.spark_partition_id() % SHARES)
    found = _ranked(cut(_ranked(found, k, "item", "share").drop("rank"), f"{folder}/found"), k, "item")
    names = spark.createDataFrame([(r, x) for r, x in enumerate(ids)], "item int, item_id long")
    remove(spark, f"{folder}/postings")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = ensure(docs, doc_id="long", text="binary")
    out, ids, block, held = [], [], [], 0
    for r in ensure(items, item_id="long", text="binary").toLocalIterator():  # the items, block by block
        words = terms(bytes(r.text)) if r.text else []
        if block and held + len(words) > BLOCK_TERMS:
            out.append(_block(docs, ids, block, k, f"{folder}/{len(out)}"))
            ids, block, held = [], [], 0
        ids.append(r.item_id)
        block.append(words)
        held += len(words)
    if block:
        out.append(_block(docs, ids, block, k, f"{folder}/{len(out)}"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE = r"""
WITH dt AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (
  SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT cast(count(*) FILTER (WHERE len(w) > 0) AS bigint) AS n_docs, cast(sum(len(w)) AS bigint) AS n_words FROM dt),
q AS (SELECT r, item_id, t, count(*) AS c FROM (SELECT r, item_id, unnest(w) AS t FROM it) GROUP BY ALL),
tf AS (
  SELECT d, doc_id, cast(size AS bigint) AS size, t, count(*) AS f FROM (SELECT d, doc_id, len(w) AS size, unnest(w) AS t FROM dt)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS n FROM tf GROUP BY 1),
impact AS (
  SELECT d, doc_id, tf.t, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * n + 1)::double)) AS bigint) *
    ((1000000000 * f) // (1000 * f + 12 * (100 - 25 + ((25 * size * n_docs) // n_words)))) AS v
  FROM tf JOIN df ON df.t = tf.t CROSS JOIN total),
scores AS (SELECT r, item_id, d, doc_id, cast(sum(c * v) AS bigint) AS score FROM q JOIN impact ON impact.t = q.t GROUP BY ALL)
SELECT item_id, cast(rank AS int) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
