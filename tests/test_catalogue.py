"""Every query of the entry module, but the llm ones, against its SQL."""

import duckdb
import pytest

from recordmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


def plain(rows):
    value = lambda x: round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(repr([None if v is None else value(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, small, oracle, name):
    got = catalogue.QUERIES[name](spark, small)
    want = oracle.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([[r[i] for i in at] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
