"""LAS files from point tables, and under a similarity from other LAS files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.operators.control import Similarity
from skyraster.plans.tables import cut, drop
from skyraster.sources import binary, files

_PIECES = "part int, pos int, data binary"


def write_las(points: DataFrame, path: str) -> str:
    """Points in order of pt_id as LAS 1.2, format 3. Records are packed on executors, range by range of ids."""
    spark = points.sparkSession
    names = ["x", "y", "z", "r", "g", "b", "cls"]
    types = dict(points.dtypes)
    points = points.select("pt_id", *[F.col(c).cast("double") if c in types else F.lit(1.0).alias(c) for c in names])
    box = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]).first()
    low, high = (np.array([box[f"{n}{c}"] or 0.0 for c in "xyz"]) for n in ("low", "high"))
    if (high - low).max(initial=0) / 0.001 >= 2**31:
        raise ValueError("the cloud is too wide for millimetre steps from one corner")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            cols = [batch.column(c).to_numpy() for c in names]
            data = binary.las_records(np.column_stack(cols[:3]), np.column_stack(cols[3:6]), cols[6].astype(np.uint8), low)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["part", "pos", "data"])

    pieces = cut(points.repartitionByRange("pt_id").sortWithinPartitions("pt_id").mapInArrow(pack, _PIECES), "las")

    def whole() -> Iterator[bytes]:
        yield binary.las_head(box.n, low, high)
        yield from files.ordered(pieces, "part", "pos")

    done = files.write(spark, path, whole())
    drop(pieces)
    return done


def transform_las(spark: SparkSession, source: str, target: str, sim: Similarity) -> str:
    """A LAS file moved by a similarity: read by ranges of records, with a header for the new extent."""
    binary.register(spark)
    return write_las(sim.apply(spark.read.format("las").load(source)), target)
