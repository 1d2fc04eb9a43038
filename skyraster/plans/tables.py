"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for this session's intermediate tables, below ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; any other master must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skyraster-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/skyraster-tables"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: iterative operators keep short plans, and a lost executor
    costs no more than rereading. Files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """rows with a number from ``first`` on, in an order: ranges are sorted side by side, and a range begins where those before it end."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each range
    return parts.join(F.broadcast(sizes.withColumn("_before", before)), "_part").withColumn(name, (F.col("_at") - F.col("_from") + F.col("_before") + first).cast("long")).drop("_part", "_at", "_n", "_from", "_before")
