"""The most similar vectors of many at once, by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Most numbers of a part of the vectors that are searched (64 MB), and queries in a block.
PART_FLOATS = 8_000_000
BLOCK_ROWS = 20_000
#: Most numbers of one product.
PRODUCT = 4_000_000


def best_of(queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in known, cosine) of the k most similar ones of each query; of equal ones (to twelve digits) the first."""
    k = min(k, len(known))
    own = np.sqrt((queries * queries).sum(1))
    lengths = np.sqrt((known * known).sum(1))
    out, step = [], max(1, PRODUCT // max(1, len(known)))
    for i in range(0, len(queries), step):
        part = slice(i, i + step)
        sim = np.round((queries[part] @ known.T) / np.maximum(own[part, None] * lengths[None, :], 1e-12), 12)
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        for q, row in enumerate(sim):
            found = np.flatnonzero(row >= least[q])
            found = found[np.argsort(-row[found], kind="stable")[:k]]
            out.append((np.full(len(found), i + q), found, row[found]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "emb", by: str | None = None, order: str | None = None) -> DataFrame:
    """The k rows most similar to each query: query_id, row_id, sim (cosine), place (from 1).

    Both sides have `vector` and, if given, `by`, which must be equal; rows may have `order`, whose smallest goes
    first among equally similar ones (to twelve digits), then the smallest row_id. Rows and queries whose vector or
    `by` is null meet nothing; ids are not null. No row for each pair is ever made: rows are cut into parts of PART_FLOATS
    numbers and queries into blocks of BLOCK_ROWS, a task multiplies one block with one part and tells the k best of
    each query, and these lists are cut to k again before and after they are brought together. A single part goes
    to the queries, which then do not move.
    """
    kinds = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    group = (lambda df: F.col(by)) if by else (lambda df: F.lit(0))
    left = queries.select(F.col(query_id).alias("q"), group(queries).alias("by"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND by IS NOT NULL")
    right = rows.select(F.col(row_id).alias("r"), (F.col(order) if order else F.lit(0)).alias("o"), group(rows).alias("by"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND by IS NOT NULL")
    n, dims = right.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = f"{query_id} {kinds[0]}, {row_id} {kinds[1]}, sim double, o {dict(right.dtypes)['o']}"
    parts = max(1, -(-n * dims // PART_FLOATS))
    if parts == 1:
        found = _with_one_part(left, right, k, schema)
    else:
        blocks = max(1, -(-left.count() // BLOCK_ROWS))
        # either side is copied once for each block or part of the other
        a = left.withColumn("block", F.pmod(F.xxhash64("q", "v"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        b = right.withColumn("part", F.pmod(F.xxhash64("r", "v"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

        names = [query_id, row_id, "sim", "o"]

        def cell(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if mine.empty or known.empty:
                return pd.DataFrame({n: [] for n in names})
            known = known.sort_values(["o", "r"], kind="stable")
            q, at, sim = best_of(np.stack(mine.v.to_numpy()), np.stack(known.v.to_numpy()), k)
            return pd.DataFrame(dict(zip(names, (mine.q.to_numpy()[q], known.r.to_numpy()[at], sim, known.o.to_numpy()[at]), strict=True)))

        keys = ["by", "block", "part"]
        found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(cell, schema)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("sim"), "o", row_id))
    # Spark keeps the first k of each query on the side where they are made, too
    return found.withColumn("place", place).where(F.col("place") <= k).drop("o")


def _with_one_part(left: DataFrame, right: DataFrame, k: int, schema: str) -> DataFrame:
    known = right.orderBy("o", "r").collect()  # at most PART_FLOATS numbers
    tables = {}
    for kind in {r["by"] for r in known}:
        own = [r for r in known if r["by"] == kind]
        tables[kind] = np.array([r["v"] for r in own], float), [r["r"] for r in own], [r["o"] for r in own]
    shared = left.sparkSession.sparkContext.broadcast(tables)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = to_arrow_type(right.schema["r"].dataType), to_arrow_type(right.schema["o"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column(0), np.array(batch.column(1).to_pylist(), object)
            for kind, (vectors, r, o) in shared.value.items():
                own = np.flatnonzero(groups == kind)
                if len(own):
                    mine = np.array(batch.column(2).take(pa.array(own)).to_pylist(), float)
                    q, at, sim = best_of(mine, vectors, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[q])), pa.array([r[i] for i in at], kinds[0]), pa.array(sim), pa.array([o[i] for i in at], kinds[1])], names)

    return left.mapInArrow(run, schema)
