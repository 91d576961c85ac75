"""The package's queries with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda df: sorted(tuple(v if isinstance(v, str) else f"{float(v):.9g}" for v in r) for r in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
