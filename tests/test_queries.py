"""Every registered camera query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from watchframe.plans.queries import ORACLE_SQL, QUERIES
from watchframe.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    value = lambda v: "null" if v is None or (isinstance(v, float) and v != v) or v is pd.NA else (f"{float(v) + 0.0:.6g}" if isinstance(v, float) else str(v))
    return sorted("|".join(value(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_global_ids_grow_with_the_table(spark):
    from watchframe.plans import queries
    from watchframe.plans.views import view

    for sf, n in ((SF, 500), ("/root/testdata/sf0.1", 2000)):
        samples = view(spark, sf, "v_samples")
        got = sorted(map(tuple, queries._w11(samples).select("site", "camera_id", "track_id", "gid").collect()))
        seen = {}
        for k in range(n):
            if k % 10:
                key = (f"s{k // 400}", f"cam_{k % 4}", k // 40)
                seen[key] = seen.get(key, 0) + 1
        assert [r[:3] for r in got] == sorted(k for k, v in seen.items() if v >= 3)
        one = queries._w11(samples.where("sample_id >= 400 and sample_id < 800")).select("site", "camera_id", "track_id", "gid")
        assert sorted(map(tuple, one.collect())) == [r for r in got if r[0] == "s1"]
