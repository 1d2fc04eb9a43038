"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A batch is a table of signed rows (source, lang, tokenizer, n_docs, n_tokens): an insert adds a
document, a delete takes it back, a revised count takes the old count back and adds the new one.
``Rollup.commit`` sums a batch, adds the sums to the totals as they stand, and writes those as the
next version, so that a commit costs as much as its batch and the number of groups, and
``totals`` reads one small table. The commit point is one file, ``commits/<version>``, which
names the batch, a digest of its sums, and the version's table. It is put in place by a
rename that fails if the file is there: a writer that lost the race adds its sums to the newer totals and
tries again. (On a local file system, where a rename replaces, a lock in this process does the same.)
A commit counts once a state read after its put holds it: versions up to the newest snapshot are
that snapshot's alone, so a writer whose place was taken, compacted and cleared meanwhile
sees that its file is passed over, and tries again; so does one whose base table went away.

A batch that is committed again changes nothing if its sums are the same, and is refused if they
differ; one that broke off has left no commit and is done anew. ``compact`` puts the ids of
all batches so far into one file and deletes earlier versions.

Cases: null sources and languages are groups of their own; null and empty texts are documents
of no token; repeated rows count each time; an empty batch commits and adds nothing; groups whose
documents were all taken back stay out of the totals; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, remove, shared_dir, small_batches
from skyraster.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
_TYPES = {"source": "string", "lang": "string", "tokenizer": "string", "n_docs": "long", "n_tokens": "long"}
SCHEMA = ", ".join(f"{c} {t}" for c, t in _TYPES.items())


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, node (text hash), n_words, n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            n = pa.array(tool.count_column(batch.column("text")), pa.int64())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], names=[*keep, "n_tokens"])
        tool.rest()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ensure(docs, doc_id="long", source="string", lang="string", text="string").select(
        "doc_id", "source", "lang", "text", F.md5(text).alias("node"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, node string, n_words long, n_tokens long")


def inserts(counts: DataFrame, tokenizer: str, n: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col(n).cast("long").alias("n_tokens"))


def deletes(counts: DataFrame, tokenizer: str, n: str) -> DataFrame:
    return inserts(counts, tokenizer, n).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(counts: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """From one (tokenizer, count column) to another."""
    return deletes(counts, *old).unionByName(inserts(counts, *new))


class Rollup:
    """Totals below a folder that all executors share."""

    _renames = threading.Lock()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """Put a file in place as a whole; False if there is one of that name."""
        staged, final = self._path(f"{self.folder}/staged/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        with self._renames:
            done = not self._fs.exists(final) and self._fs.rename(staged, final)
        if not done:
            self._fs.delete(staged, False)
        return done

    def _state(self) -> tuple[int, str | None, dict[str, str]]:
        """(version, its table, digests by batch): the last snapshot, and the commits since.

        A new snapshot meanwhile may have cleared commits before they were listed: then it is all read again.
        """
        while True:
            last = self._names("snapshots")[-1:]
            version, table, batches = 0, None, {}
            try:
                for name in last:
                    found = self._read(f"snapshots/{name}")
                    version, table, batches = int(name), found["table"], found["batches"]
                for name in self._names("commits"):
                    if int(name) > version:
                        found = self._read(f"commits/{name}")
                        version, table = int(name), found["table"]
                        batches[found["batch"]] = found["digest"]
            except Exception:
                if self._names("snapshots")[-1:] == last:
                    raise
                continue
            if self._names("snapshots")[-1:] == last:
                return version, table, batches

    def _add(self, sums: DataFrame, table: str | None, after: str) -> None:
        """Write the totals of ``table`` and ``sums`` as ``after``."""
        both = sums if table is None else self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{table}").unionByName(sums)
        cut(_summed(both), f"{self.folder}/{after}")

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(self._state()[2])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was there. ValueError if it was, with other sums."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        work = f"{self.folder}/work/{uuid.uuid4().hex}"
        sums = cut(_summed(ensure(deltas, **_TYPES)), work)
        hashed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in _TYPES]).cast("decimal(38,0)")
        digest = ":".join(map(str, sums.agg(F.count(F.lit(1)), F.sum(hashed)).first()))
        try:
            while True:
                version, table, known = self._state()
                if batch in known:
                    if known[batch] != digest:
                        raise ValueError(f"batch {batch!r} was committed with other sums")
                    return False
                after, place = f"totals/{version + 1:012d}-{uuid.uuid4().hex}", f"commits/{version + 1:012d}"
                try:
                    self._add(sums, table, after)
                except Exception:
                    if self._state()[0] == version:
                        raise
                    continue  # the base table was compacted away
                if self._put(place, {"batch": batch, "digest": digest, "table": after}) and batch in self._state()[2]:
                    return True
                self._fs.delete(self._path(f"{self.folder}/{after}"), True)
        finally:
            self._fs.delete(self._path(work), True)

    def compact(self) -> None:
        """One file for all batches so far; earlier versions go. Readers of an earlier version must be done."""
        version, table, batches = self._state()
        if not version or not (self._put(f"snapshots/{version:012d}", {"table": table, "batches": batches})):
            return
        for kind in ("snapshots", "commits", "totals"):
            for name in self._names(kind):
                last = version if kind == "commits" else version - 1
                if int(name.split("-")[0]) <= last and f"{kind}/{name}" != table:
                    self._fs.delete(self._path(f"{self.folder}/{kind}/{name}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens as of the last commit."""
        while True:
            version, table, _ = self._state()
            try:
                return self.spark.createDataFrame([], SCHEMA) if table is None else self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{table}")
            except Exception:
                if self._state()[0] == version:
                    raise


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


def copies(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, one row a text): what they differ by are the exact copies, so no row meets another.

    A text's row is that of its least doc_id (null last), source and language.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", "n_words", "n_tokens")).alias("one")
    return counts, counts.groupBy("node").agg(least).select("one.*")


def maintain(docs: DataFrame, path: str, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Totals after four batches, each replayed once: word counts as first estimates; the
    tokenizer's counts in their place; the same documents under ``<tokenizer>-unique``, and there the
    deletion of exact copies. The result has all documents, and those without copies.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    with small_batches(spark):
        counts = cut(count(docs, path), f"{folder}/counts")
    every, ones = copies(counts)
    rollup, unique = Rollup(spark, f"{folder}/rollup"), f"{tokenizer}-unique"
    for _ in range(2):
        rollup.commit("1-insert", inserts(counts, "words", "n_words"))
        rollup.commit("2-revise", revisions(counts, ("words", "n_words"), (tokenizer, "n_tokens")))
        rollup.commit("3-insert-unique", inserts(counts, unique, "n_tokens"))
        rollup.commit("4-delete-copies", deletes(every, unique, "n_tokens").unionByName(inserts(ones, unique, "n_tokens")))
    rollup.compact()
    remove(spark, f"{folder}/counts")
    return rollup.totals()
