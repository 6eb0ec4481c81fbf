"""Steps of iterative jobs, written to the folder that all executors share, and row numbers over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: set[tuple[str, str]] = set()


def step_folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir (only where that is unset, the warehouse).

    It is deleted when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    app = spark.sparkContext.applicationId
    folder = f"{base.rstrip('/')}/steps-{app}"
    if (app, folder) not in _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add((app, folder))
    return folder


def write_again(df: DataFrame) -> DataFrame:
    """df by way of Parquet files in the shared folder: its lineage ends, and the files outlive every executor."""
    path = f"{step_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with `out`: the place of each row, from 1, in a global order.

    Rows are range-partitioned by the order and written once; each partition adds the number of rows of the
    partitions before it. What meets in one task is one row for each partition.
    """
    rows = write_again(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    sizes = rows.groupBy("part_").agg(F.count("*").alias("size_"))
    ahead = F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part_", F.coalesce(ahead, F.lit(0)).alias("ahead_"))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) + F.col("ahead_")
    # at most one row for each partition: small whatever the table's size
    return rows.join(F.broadcast(sizes), "part_").withColumn(out, place).drop("part_", "ahead_")
