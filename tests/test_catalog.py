"""The catalogue's shape, and every query against its SQL on the smallest data."""

import sys
from pathlib import Path

import pytest

from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry_points  # noqa: E402

duckdb = pytest.importorskip("duckdb")
# The text queries have tests of their own.
NAMES = sorted(set(entry_points.queries()) - set(entry_points.TEXT_QUERIES))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) - set(entry_points.TEXT_SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    from check_queries import bag

    df = entry_points.queries()[name](spark, DATA)
    relation = db.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert bag(df.columns, df.collect()) == bag(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["month", "orders", "revenue"]
