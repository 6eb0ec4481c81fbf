"""Running totals over a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise


def running_totals(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over all rows up to and with this one, by `order`.

    Rows are range-partitioned by the order and written once; each partition adds the total of the
    partitions before it (one row for each partition is all that meets in one task).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("part").agg(F.sum(value).alias("part_sum"))
    before = F.sum("part_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("part_before"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # at most one row for each partition: small whatever the table's size
    return rows.join(F.broadcast(sums), "part").withColumn(out, F.sum(value).over(here) + F.col("part_before")).drop("part", "part_before")
