"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

Layout of a file set under one folder (each part a Parquet table, so that Spark's committer
makes the write safe against lost executors and any store that Spark reads will do):

* ``ranks``: rank -> id, rank 0 the most frequent id, ties by id.
* ``blocks``: rows (shard, start, n, doc_ids, sizes, control, data). A block holds whole
  documents in ascending (doc_id, ids) order, nulls first, about ``BLOCK_IDS`` ids of them.
  ``doc_ids`` and ``sizes`` are int64 arrays (a null doc_id is listed in ``nulls``), ``start``
  counts the ids before the block within its shard. Each id is stored as its rank in one to
  four bytes, low byte first (``data``); two bits of ``control`` give that length less one,
  four ids to a control byte, lowest bits first. Decoding looks lengths up in a 256 x 4 table.

Shards are ranges of doc_id, in order. Offsets come from a sum over shards (one number each).

Cases: null and empty texts hold the end id alone; a very long text is one document of one
block; repeated rows are all written, next to each other; an empty table gives empty files
and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, release, remove, shared_dir, small_batches
from skyraster.llm.tokens import encoder

END_ID = 2
BLOCK_IDS = 262_144
SHARD_IDS = 32_000_000

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
BLOCKS = "shard int, start long, n long, doc_ids binary, nulls array<long>, sizes binary, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative ranks below 2**32."""
    ranks = np.asarray(ranks, np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    widest = int(size.max(initial=1))
    used = np.arange(widest, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :widest][used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a packed block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _width(kind: str) -> np.dtype:
    return np.dtype("<u2" if kind == "H" else "<u4")


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (little-endian bytes, end id last) of every document.

    After each batch comes a row with ids null and the batch's own counts: pairs of int64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        end = np.array([end_id], _width(tool.kind)).tobytes()
        for batch in batches:
            ids = [x + end for x in tool.encode_column(batch.column("text"))]
            total = np.zeros(0, np.int64)
            for a in range(0, len(ids), 500):
                n = np.bincount(np.frombuffer(b"".join(ids[a : a + 500]), _width(tool.kind)), minlength=len(total))
                n[: len(total)] += total
                total = n
            seen = np.flatnonzero(total)
            docs = pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array([*ids, None], pa.binary()), pa.array([*[None] * len(ids), np.stack([seen, total[seen]]).tobytes()], pa.binary())],
                names=["doc_id", "ids", "counts"])
        tool.rest()

    return ensure(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

    return tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> int:
    """Tokenize docs and write the file set under ``folder``; returns the number of ids."""
    spark = docs.sparkSession
    kind = encoder(path).kind
    with small_batches(spark):
        tokens = cut(tokenize(docs, path, end_id), f"{folder}/tokens")
    counted = frequencies(tokens).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    ids = np.array([r.id for r in counted], np.int64)
    total = int(sum(r.n for r in counted))
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, width = shared.value, _width(kind)
        shard, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            control, data = pack(table[np.frombuffer(b"".join([x[1] for x in held]), width)])
            row = {
                "shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()), "n": pa.array([size], pa.int64()),
                "doc_ids": pa.array([np.array([x[0] or 0 for x in held], "<i8").tobytes()], pa.binary()),
                "nulls": pa.array([[k for k, x in enumerate(held) if x[0] is None]], pa.list_(pa.int64())),
                "sizes": pa.array([np.array([len(x[1]) // width.itemsize for x in held], "<i8").tobytes()], pa.binary()),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            docs, ids = batch.column("doc_id"), batch.column("ids")
            for k in range(batch.num_rows):
                held.append((docs[k].as_py(), ids[k].as_py()))
                size += len(held[-1][1]) // width.itemsize
                if size >= BLOCK_IDS:
                    yield block()
                    start, held, size = start + size, [], 0
        if held:
            yield block()
        release()

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_IDS))
    keyed = tokens.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids").drop("tie")
    with small_batches(spark):
        ranged.mapInArrow(packed, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    remove(spark, f"{folder}/tokens")
    return total


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) decoded from a file set."""
    ranks = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sums = dict(blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row a shard
    base, at = {}, 0
    for shard in sorted(sums):
        base[shard], at = at, at + sums[shard]
    shared = spark.sparkContext.broadcast((ranks, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, base = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ranks[unpack(row["control"], row["data"], row["n"])]
                sizes = np.frombuffer(row["sizes"], "<i8")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                missing = np.zeros(len(sizes), bool)
                missing[row["nulls"]] = True
                out = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=missing),
                    pa.array(base[row["shard"]] + row["start"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4") for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write the documents' ids, then read the files back."""
    folder = folder or shared_dir(docs.sparkSession)
    write(docs, path, folder)
    return read(docs.sparkSession, folder)
