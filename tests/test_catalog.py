"""Queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from demandlens.plans import catalog
from demandlens.session import TABLES

DATA = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v if v is None else str(v)
    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    got = catalog.queries()[name](spark, DATA)
    want = database.execute(catalog.oracle_sql()[name])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), [c[0] for c in want.description])


def test_entry_runs_without_the_training_package(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
