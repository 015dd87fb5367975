"""Every query with SQL against DuckDB on the same files."""

import duckdb
import pytest

import __spark_entry__ as driver
from marlstone import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(names, values):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
