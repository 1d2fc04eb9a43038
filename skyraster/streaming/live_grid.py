"""Grids and class counts kept up to date over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyraster.operators import grid
from skyraster.schema import RasterMeta


def surface(points: DataFrame, meta: RasterMeta) -> DataFrame:
    """Highest, lowest and number of points a cell; runs on batches and, in update mode, on streams."""
    return grid.indexed(points, meta).groupBy("row", "col").agg(F.max("z").alias("top_z"), F.min("z").alias("low_z"), F.count(F.lit(1)).alias("n"))


def classes(points: DataFrame) -> DataFrame:
    return points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def stage_windows(log: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Seconds spent by stage and time window; late rows count until the watermark passes."""
    rows = log.withWatermark("ts", late).groupBy(F.window("ts", every), "stage")
    return rows.agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "stage", "seconds", "n")


def keep_surface(points: DataFrame, meta: RasterMeta, path: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch's cells to a folder of its own: a repeated batch replaces itself,
    and ``read_surface`` folds the folders, since max, min and count are associative."""

    def put(batch: DataFrame, number: int) -> None:
        surface(batch, meta).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def read_surface(parts: DataFrame) -> DataFrame:
    return parts.groupBy("row", "col").agg(F.max("top_z").alias("top_z"), F.min("low_z").alias("low_z"), F.sum("n").alias("n"))
