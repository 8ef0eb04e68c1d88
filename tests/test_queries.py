"""Every registered query against its SQL oracle, on the smallest tables."""

import duckdb
import pytest

from lexiloom.plans.oracle import ORACLE
from lexiloom.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("-" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert normal(rows, df.columns) == normal(want.fetchall(), want.columns)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
