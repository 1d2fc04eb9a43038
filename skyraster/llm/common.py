"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
MANY = 100_000  # keys of more than 1 / MANY of the rows: fewer than MANY, so they can be sent to every task


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Where that setting is missing, a local master gets a temporary folder; any other master
    is an error, because its executors would not share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skyraster-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/skyraster-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table at ``path`` in the shared folder and read it back."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that nothing reads any more: operators keep only what their results need."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(table: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        remove(table.sparkSession, path)


def release() -> None:
    """Give freed memory back to the system: a Python worker may idle beside other work."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 4000) -> Iterator[None]:
    """Arrow batches of whole texts that stay small on both sides, for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; anything else the table holds cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, per_key: DataFrame, keys: str | list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows with what ``per_key`` has of their keys; ``size`` is its column of how many rows (or more) have the key, ``total`` the sum of all sizes, or more.

    Frequent keys are few by their definition and are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    keys = [keys] if isinstance(keys, str) else keys
    frequent = F.col(size) > max(1000, total // MANY)
    often = per_key.where(frequent)
    if often.isEmpty():
        return rows.join(per_key, keys, how)
    often = F.broadcast(often)  # at most MANY keys
    rest = rows.join(F.broadcast(per_key.where(frequent).select(*keys)), keys, "left_anti").join(per_key.where(~frequent), keys, how)
    return rows.join(often, keys).unionByName(rest)
