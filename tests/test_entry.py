import duckdb
import pytest

import __spark_entry__ as entry
from keyspan.plans import catalogue, more  # noqa: F401 - more adds to the catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((repr(plain([r[names.index(c)] for c in columns])) for r in cursor.fetchall()))
    assert sorted(repr(plain([r[c] for c in columns])) for r in df.collect()) == want
