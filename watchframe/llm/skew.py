"""Joins whose keys may be hot: one key can hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Hot keys hold more than one part in HOT_SHARE times the shuffle partitions of all rows.
HOT_SHARE = 4
#: No key of fewer rows is hot.
HOT_ROWS = 200


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"of_{k}"]) for k in keys))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"of_{k}" for k in keys})


def hot_keys(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The keys that hold so many rows that a task of their own would stand out.

    Counted by an aggregate with map-side combination, or taken from `counts` (the keys and `held`), where
    keys of one row may be missing. A hot key has more than n / (HOT_SHARE * partitions) of the n rows, so
    there are fewer than HOT_SHARE * partitions hot keys, however large the table is.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, rows.count() // (HOT_SHARE * parts))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("held")) if counts is None else counts
    return materialise(counts.where(F.col("held") > least).select(*keys))


def join_split(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with lookup by keys (null equals null); lookup has at most one row for each key.

    rows is read several times and should be materialised. Rows of hot keys stay where they are and meet
    a broadcast of these keys' lookup rows (fewer than HOT_SHARE * partitions); all others meet by
    shuffle. `how` is inner, left, left_semi or left_anti.
    """
    hot = _named(hot_keys(rows, keys) if hot is None else hot, keys)
    lookup = _named(lookup, keys)
    names = {k: f"of_{k}" for k in keys}
    warm = lookup.join(F.broadcast(hot.withColumnsRenamed({v: f"hot_{k}" for k, v in names.items()})), reduce(lambda x, y: x & y, (F.col(f"of_{k}").eqNullSafe(F.col(f"hot_{k}")) for k in keys)), "left_semi")
    of = list(names.values())
    cold_rows = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left_anti")
    hot_rows = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left_semi")
    cold = cold_rows.join(lookup, _same(cold_rows, lookup, keys), how).drop(*of)
    return cold.unionByName(hot_rows.join(F.broadcast(warm), _same(hot_rows, warm, keys), how).drop(*of))
