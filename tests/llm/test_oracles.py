"""Queries of the operators with SQL against DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pytest

from quarry.llm import queries

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(AT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, cursor = queries.QUERIES[name](spark, AT), con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
