"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Words. Texts are split at white space; a piece gives its folded core, its trailing marks, and a
sign for capitals, each hashed to one of ``VOCAB`` words. Three words in a row that the text had
before give the word REPEAT.

Random indexing. Every word has a fixed sparse index vector of ``DIMS`` places (``ONES`` of them
+1 or -1). Its context vector is the sum, over all documents, of the index vectors of the words
within ``REACH`` places of it. Sums are whole numbers, so any order gives the same.

A document is the mean of its words' vectors (scaled context, and index) and the log of its
length. A two-layer network (tanh) is trained by Adam on about ``MAX_TRAIN`` labelled rows at most,
chosen by hash of doc_id, none of which is held out; a tenth of them only sets the
temperature by which the logits are divided.

Cases: null and empty texts are scored from the zero vector; with no labels, or only one value,
the score is that share (0.5 without any); repeated rows score alike; labels of unknown documents
and null labels are ignored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, release, shared_dir, small_batches

VOCAB = 8192
DIMS = 32
ONES = 2
REACH = 2
HIDDEN = 24
MAX_TRAIN = 20_000
EPOCHS = 40
DECAY = 1e-4
CUT = 0.3
PARTS = 64
SALTS = 64
ROWS = 4000
STRIP = 128
REPEAT, UPPER, DIGITS, OTHER = VOCAB - 1, VOCAB - 2, VOCAB - 3, VOCAB - 4
_HASHED = VOCAB - 4
_MARKS = string.punctuation + "…–—“”«»¡¿"

_RNG = np.random.default_rng(1_984)
INDEX_AT = _RNG.integers(0, DIMS, (VOCAB, ONES))
INDEX_SIGN = _RNG.choice([-1, 1], (VOCAB, ONES))
INDEX = np.zeros((VOCAB, DIMS), np.int64)
np.add.at(INDEX, (np.arange(VOCAB)[:, None], INDEX_AT), INDEX_SIGN)
_AT, _SIGN = INDEX_AT.T.astype(np.int32).copy(), INDEX_SIGN.T.astype(np.float64).copy()


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ids(piece: str) -> list[int]:
    core = piece.rstrip(_MARKS)
    marks = piece[len(core) :]
    out = []
    if core:
        out.append(DIGITS if core.isdigit() else zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % _HASHED)
    if marks:
        out.append(zlib.crc32(b"\x00" + marks.encode("utf-8", "surrogatepass")) % _HASHED)
    if len(core) > 1 and core.isupper():
        out.append(UPPER)
    return out or [OTHER]


def word_ids(texts: pa.Array, repeats: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word ids, row of each, number of REPEAT words of each row) for runs of rows."""
    for start in range(0, len(texts), ROWS):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(start, ROWS), ""))
        coded = lists.flatten().dictionary_encode()
        ids = [_ids(x) if x else [] for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = np.cumsum(size) - size
        flat = np.array([k for x in ids for k in x], np.int32)
        index = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        n = size[index]
        stop = np.cumsum(n)
        words = flat[np.repeat(first[index] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        at = np.repeat(row, n)
        again = np.zeros(len(lists), np.int64)
        if repeats:
            real = n > 0
            index, row = index[real].astype(np.uint64), row[real]
            if len(index) > 2:
                whole = row[2:] == row[:-2]
                gram = (index[:-2] * np.uint64(0x9E3779B97F4A7C15) + index[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + index[2:]
                gram = ((gram ^ gram >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + row[2:].astype(np.uint64))[whole]
                grams = np.bincount(row[2:][whole], minlength=len(lists))
                order = np.argsort(gram)
                new = np.ones(len(gram), bool)
                new[1:] = gram[order][1:] != gram[order][:-1]
                again = grams - np.bincount(row[2:][whole][order[new]], minlength=len(lists))
        yield words, at, again


def context_sums(texts: pa.Array) -> np.ndarray:
    """VOCAB x DIMS sums of neighbours' index vectors."""
    total = np.zeros(VOCAB * DIMS)
    for words, row, _ in word_ids(texts, repeats=False):
        for k in range(1, REACH + 1):
            near = np.flatnonzero(row[k:] == row[:-k])
            a, b = words[near], words[near + k]
            for x, y in ((a, b), (b, a)):
                for one in range(ONES):
                    total += np.bincount(x * DIMS + _AT[one][y], _SIGN[one][y], VOCAB * DIMS)
    return np.rint(total).astype(np.int64).reshape(VOCAB, DIMS)


def contexts(docs: DataFrame) -> np.ndarray:
    """Context vectors of all words from all documents; VOCAB x DIMS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOCAB, DIMS), np.int64)
        for batch in batches:
            total += context_sums(batch.column(0))
        release()
        for k, part in enumerate(np.split(total, PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(VOCAB // PARTS * DIMS, np.int64)
        for raw in rows["sums"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [total.tobytes()]})

    kind = "part int, sums binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = parts.groupBy("part", "salt").applyInPandas(add, kind)
    out = np.zeros((PARTS, VOCAB // PARTS * DIMS), np.int64)
    for r in some.groupBy("part").applyInPandas(add, kind).collect():
        out[r.part] = np.frombuffer(r.sums, np.int64)
    return out.reshape(VOCAB, DIMS)


def vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors: context of length one, in steps of 2^-24, and index."""
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.hstack([np.rint(sums / np.maximum(length, 1) * 2**24) / 2**24, INDEX]).astype(np.float32)


def pool(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """One row for each text: mean word vector, log of the number of words.

    Sums are double, of steps of 2^-24: exact below 2^29 words, so that a row does not depend on the rows beside it.
    """
    table, out = table.astype(np.float64), []
    for words, row, again in word_ids(texts):
        n = (np.bincount(row, minlength=len(again)) + again).astype(np.float64)
        total = again[:, None] * table[REPEAT]
        cuts = np.searchsorted(row, np.arange(0, len(again) + STRIP, STRIP))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):  # counts of words times vectors
            some = total[k * STRIP : (k + 1) * STRIP]
            bag = np.bincount((row[lo:hi] - k * STRIP) * VOCAB + words[lo:hi], minlength=len(some) * VOCAB)
            some += bag.reshape(len(some), VOCAB).astype(np.float64) @ table
        out.append(np.hstack([total / np.maximum(n, 1)[:, None], np.log1p(n)[:, None]]).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, table.shape[1] + 1), np.float32)


def loss(w: list[np.ndarray], z: np.ndarray, t: np.ndarray) -> float:
    """Mean cross-entropy, and DECAY for the squares of the weights."""
    logit = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
    return float(np.mean(np.logaddexp(0, logit) - t * logit) + DECAY / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum()))


def gradients(w: list[np.ndarray], z: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    h = np.tanh(z @ w[0] + w[1])
    d = (_sigmoid(h @ w[2] + w[3]) - t) / len(z)
    back = d[:, None] * w[2] * (1 - h * h)
    return [z.T @ back + DECAY * w[0], back.sum(0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]


class Network:
    """tanh layer, logit, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.temperature = 1.0
        z, t = (x[fit] - self.mean) / self.scale, y[fit]
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [0 * p for p in self.w], [0 * p for p in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 256):
                b = order[a : a + 256]
                step += 1
                for k, g in enumerate(gradients(self.w, z[b], t[b])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        rest = ~fit if (~fit).any() else fit
        logit, t = self.logits(x[rest]), y[rest]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        self.temperature = float(min(grid, key=lambda g: np.mean(np.logaddexp(0, logit / g) - t * logit / g)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Constant:
    """What there is to say without two kinds of labels."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(pooled: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Network | Constant:
    """A model from labelled rows that are not held out: all of them, or about max_rows by hash."""
    known = ensure(labels, doc_id="long", quality="int").where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = pooled.where(~held_out()).join(known, "doc_id").withColumn("h", F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)))
    share = max_rows / max(rows.count(), 1)
    # A cut on the hash, not a sort with a limit, for which every task would send its own max_rows.
    rows = rows.where(F.col("h") < share * (1 << 30)).select("doc_id", "quality", "vector", "h").collect()
    rows.sort(key=lambda r: (r.h, r.doc_id, r.vector))
    if len({r.quality for r in rows}) < 2:
        return Constant(float(rows[0].quality) if rows else 0.5)
    x = np.stack([np.frombuffer(r.vector, np.float32) for r in rows]).astype(np.float64)
    return Network(x, np.array([r.quality for r in rows], np.float64), np.array([r.h % 10 != 0 for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    docs = ensure(docs, doc_id="long", text="string")
    with small_batches(spark):
        table = spark.sparkContext.broadcast(vectors(contexts(docs)))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column("text"), table.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "vector"])
        release()

    with small_batches(spark):
        pooled = cut(docs.mapInArrow(vector, "doc_id long, vector binary"), f"{shared_dir(spark)}/pooled")
    model = spark.sparkContext.broadcast(train(pooled, labels, max_rows))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(batch.num_rows, 2 * DIMS + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.score(x.astype(np.float64)), pa.float64())], names=["doc_id", "held_out", "score"])

    scored = pooled.select("doc_id", held_out().alias("held_out"), "vector").mapInArrow(rate, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
