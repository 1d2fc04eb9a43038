"""Product files on any Hadoop file system: written aside, and put in place by one rename.

What a product consists of is made on executors and committed as a table by Spark, so that attempts that were killed leave
nothing; here its pieces pass by one at a time, in order. Until the rename the target is what it was before.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 4_000_000


def local(path: str) -> str | None:
    """The path on a mounted file system that all tasks reach, or None for a store of another scheme."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


class Store:
    """Hadoop's file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.conf)
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def write(self, path: str, pieces: Iterable[bytes]) -> None:
        """A whole file at ``path``, or none."""
        aside = self.path(f"{path}.part-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        try:
            held = bytearray()
            for piece in pieces:
                held += piece
                if len(held) >= BUFFER:
                    stream.write(held)
                    held = bytearray()
            stream.write(held)
            stream.close()
            overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            how = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
            how[0] = overwrite
            self.context.rename(aside, self.path(path), how)
        except BaseException:
            with contextlib.suppress(Exception):
                stream.close()
            self.fs.delete(aside, False)
            raise

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _local_write(path: str, pieces: Iterable[bytes]) -> str:
    """Beside the target, then renamed; if the target is locked, a numbered name is taken."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    aside = f"{path}.part-{uuid.uuid4().hex}"
    try:
        with open(aside, "wb") as f:
            f.writelines(pieces)
        base, end = os.path.splitext(path)
        for k in range(100):
            target = path if k == 0 else f"{base}_{k}{end}"
            with contextlib.suppress(PermissionError):
                os.replace(aside, target)
                return target
        raise PermissionError(path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(aside)


def write(spark: SparkSession, path: str, data: bytes | Iterable[bytes]) -> str:
    """Write a file as a whole; returns its path."""
    pieces = [data] if isinstance(data, bytes) else data
    if (here := local(path)) is not None:
        return _local_write(here, pieces)
    Store(spark, path).write(path, pieces)
    return path


def write_each(rows: DataFrame, folder: str) -> int:
    """Many files from (path, data): on a mounted file system by the tasks that have them, in another store from here.

    Tasks write below a folder of this job and of their attempt; only files of tasks that succeeded are then renamed into place.
    """
    spark = rows.sparkSession
    here = local(folder)
    if here is None:
        store, n = Store(spark, folder), 0
        for r in rows.select("path", "data").toLocalIterator():
            store.write(f"{folder}/{r.path}", [bytes(r.data)])
            n += 1
        return n
    aside = f"{here}/.part-{uuid.uuid4().hex}"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = f"{aside}/{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            done = [f"{own}/{p}" for p in batch["path"]]
            for path, data in zip(done, batch["data"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
            yield pd.DataFrame({"path": batch["path"], "done": done})

    n = 0
    try:
        for r in rows.select("path", "data").mapInPandas(put, "path string, done string").collect():  # names only
            os.makedirs(os.path.dirname(f"{here}/{r.path}"), exist_ok=True)
            os.replace(r.done, f"{here}/{r.path}")
            n += 1
    finally:
        if os.path.isdir(aside):
            import shutil

            shutil.rmtree(aside)
    return n


def ordered(pieces: DataFrame, *by: str) -> Iterator[bytes]:
    """The pieces (data) of a table, one at a time."""
    for r in pieces.orderBy(*by).select("data").toLocalIterator():
        yield bytes(r.data)


def lines(rows: DataFrame, *by: str, each: int = 2000) -> Iterator[bytes]:
    """Lines (value) in order, as pieces of about ``each``: lines are put together where they lie."""
    held: list[str] = []
    for r in rows.orderBy(*by).select(F.concat("value", F.lit("\n")).alias("value")).toLocalIterator():
        held.append(r.value)
        if len(held) >= each:
            yield "".join(held).encode()
            held = []
    yield "".join(held).encode()
