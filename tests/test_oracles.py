"""Every query with SQL agrees with DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from barquet import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == want


#: Queries without SQL, and the tests that recompute what they return.
ELSEWHERE = {"t13_rolling_pca": "test_answers.py::test_rolling_pca", "p3_cluster_weights": "test_answers.py::test_cluster_weights", "n10_chunks": "test_answers.py::test_chunks_of_pages", "n18_chunk_cap": "test_answers.py::test_chunks_of_pages", "io6_content_hash": "test_answers.py::test_content_hash"}


def test_every_query_is_checked():
    assert set(registry.QUERIES) - set(registry.SQL) == set(ELSEWHERE)
