"""Every corpus query is registered, and those with a DuckDB form agree with it."""

import math
from collections import Counter

import duckdb
import pytest

from strandloom.llm import registry


def plain(rows):
    def value(v):
        return "null" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    return Counter(tuple(map(value, r)) for r in rows)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = registry.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_odd_rows_in_both(spark, tmp_path, name):
    rows = [(1, "a b c cc by x", "s", 3), (2, None, None, 0), (3, "", "t", 0), (None, "All rights reserved " * 40, None, 1), (1, "a b c cc by x", "s", 3), (4, "licensed under the apache license version 2.0 " * 3, "é", 2), (5, "word " * 2000, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").selectExpr("*", "if(doc_id = 3, null, 'en') AS lang").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.9]), (10, [-1.0, 0.0]), (11, [-1.0, 0.45]), (12, [2.0]), (13, [-3.0]), (14, [0.0, 1.0, 0.0]), (15, [0.1, 1.0, 0.1])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall())
