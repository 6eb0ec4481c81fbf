"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..helpers.tables import write_again

#: Writes a frame into the application's shared folder and reads it back; the files outlive every executor.
materialise = write_again


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows in this session, as whole texts are long rows.

    Frames are worked out after their function returns, so the setting stays; it only ever gets smaller.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def partitions_for(df: DataFrame, text_col: str, mb_each: int) -> int:
    """Partition count that gives each about mb_each MB of text, at least the session's own."""
    total = df.select(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (mb_each << 20)))


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which ends by returning freed memory to the system: worker processes wait for later stages and share their memory with them."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return wrapped
