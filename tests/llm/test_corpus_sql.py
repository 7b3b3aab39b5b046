"""Queries of the training-data operators that SQL can express, against their SQL on DuckDB."""

import math

import duckdb
import pytest

from pitchframe.llm import queries

TABLES = "documents embeddings benchmark labels".split()


def by_name(names, rows):
    place = [names.index(n) for n in sorted(names)]
    return sorted((tuple(row[i] for i in place) for row in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name, folder):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    got = by_name(df.columns, df.collect())
    result = database.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    want = by_name(names, result.fetchall())
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [type(v) for v in a] == [type(v) for v in b]
        assert all(x == y or math.isclose(x, y, abs_tol=2e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
