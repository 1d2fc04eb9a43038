from __future__ import annotations

from pyspark.sql import functions as F

from skyraster.operators import grid
from skyraster.plans.adapters import load
from skyraster.streaming import live_grid


def test_stream_equals_batch(spark, tmp_path):
    points = load(spark, "/root/testdata/sf0.001", "points")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    meta = grid.plan(points, 10.0)
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_grid.keep_surface(source, meta, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = live_grid.read_surface(spark.read.parquet(str(tmp_path / "out")))
    want = live_grid.surface(points, meta)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_late_rows_and_windows(spark, tmp_path):
    log = load(spark, "/root/testdata/sf0.001", "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), (F.col("value") * 10).alias("seconds"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live_grid.stage_windows(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stages").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stages").agg(F.sum("n")).first()[0] == log.count()
