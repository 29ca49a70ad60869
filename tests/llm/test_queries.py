"""The subpackage's queries that SQL expresses, against DuckDB; and that all are registered."""

import re

import duckdb

from rowsentry.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.fetchall()), name
