"""Every named query with a SQL statement gives what DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def plain(value):
    return f"{type(value).__name__} {value!r}" if isinstance(value, (float, bool, int)) else f"- {value}"


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_statement_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(5).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["seq_id", "tokens"]
