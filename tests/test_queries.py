"""Every query of the library's own operators against its SQL, over the smallest tables."""

import datetime
import decimal

import pytest

from brookline import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


@pytest.fixture(scope="module")
def database():
    held = duckdb.connect()
    held.execute("SET timezone = 'UTC'")
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return held


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, database, name):
    frame = queries.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = database.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in frame.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["group_outer_columns", "join_as_column_flatten", "n_queens_6"])
def test_nothing_is_nested_that_is_not_kept(spark, name):
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
