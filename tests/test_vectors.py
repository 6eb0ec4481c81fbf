import numpy as np
import pytest
from pyspark.sql import functions as F

from watchframe.operators import search, vectors


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    of = lambda n: [[float(x) for x in v] for v in np.round(rng.normal(size=(n, 5)), 1)]
    queries = [(i, "ab"[i % 2], v) for i, v in enumerate(of(60))] + [(90, "a", None), (91, None, [1.0] * 5), (92, "none", [1.0] * 5)]
    rows = [(i, "ab"[i % 3 % 2], v, float(-(i % 4))) for i, v in enumerate(of(150))]
    rows += [(200 + i, "a", rows[0][2], 0.0) for i in range(9)] + [(300, "b", None, 0.0), (301, "b", [0.0] * 5, 0.0)]
    return queries, rows


def brute(queries, rows, k, by):
    out = []
    for q, kind, v in queries:
        if v is None or (by and kind is None):
            continue
        found = []
        for r, other, w, order in rows:
            if w is not None and (not by or other == kind):
                a, b = np.array(v), np.array(w)
                found.append((-round(float(a @ b) / max(float(np.sqrt(a @ a) * np.sqrt(b @ b)), 1e-12), 9), order, r))
        out += [(q, r, p + 1) for p, (_, _, r) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("part_floats", [vectors.PART_FLOATS, 100])
def test_nearest_vectors_equal_all_pairs(spark, sides, monkeypatch, part_floats):
    """One part, and a grid of many parts and blocks; copies of one vector are ordered by `order`, then by id."""
    monkeypatch.setattr(vectors, "PART_FLOATS", part_floats)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vectors, "PRODUCT", 700)
    queries = spark.createDataFrame(sides[0], "query_id long, kind string, emb array<double>")
    rows = spark.createDataFrame(sides[1], "row_id long, kind string, emb array<double>, age double")
    for k, by in ((1, None), (3, "kind"), (500, "kind")):
        got = vectors.nearest_vectors(queries, rows, k, by=by, order="age").collect()
        assert sorted((r["query_id"], r["row_id"], r["place"]) for r in got) == brute(*sides, k, by)
    assert vectors.nearest_vectors(queries, rows.where("false"), 3).count() == 0
    assert vectors.nearest_vectors(queries.where("false"), rows, 3).count() == 0


def test_no_row_for_each_pair(spark, sides, monkeypatch):
    """What leaves a cell is k rows for each of its queries."""
    monkeypatch.setattr(vectors, "PART_FLOATS", 100)
    queries = spark.createDataFrame(sides[0], "query_id long, kind string, emb array<double>")
    rows = spark.createDataFrame(sides[1], "row_id long, kind string, emb array<double>, age double")
    plan = vectors.nearest_vectors(queries, rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Partial" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rank_many_equals_rank_by_vector(spark, sides):
    tracks = spark.createDataFrame([(r, v, 100.0 + r % 7) for r, _, v, _ in sides[1]] + [(400 + i, None, 50.0 + i) for i in range(5)], "track_id long, clip array<double>, start_ts double")
    queries = spark.createDataFrame([(q, v) for q, _, v in sides[0][:4]], "query_id long, clip array<double>")
    few = tracks.where("track_id IN (1, 2, 3) OR track_id >= 300")
    for rows, k in ((tracks, 7), (few, 8)):
        got = search.rank_many(rows, queries, k).orderBy("query_id", "place").collect()
        for q, _, v in sides[0][:4]:
            want = search.rank_by_vector(rows, v, k).select("track_id", F.round("score", 3)).collect()
            own = [r for r in got if r["query_id"] == q]
            assert [r["track_id"] for r in own] == [r["track_id"] for r in want]
            assert [r["place"] for r in own] == list(range(1, len(want) + 1))
