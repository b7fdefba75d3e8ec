"""Embedded databases, which only the driver opens, where executors are processes of their own."""

import datetime
import decimal
import os
import subprocess
import sys

import pytest

from brookline.flow import Flow
from brookline.schema import FlowKey, FlowSchema
from brookline.sources import Database, append_db, jdbc, read_db, write_db
from conftest import ROOT

DATA = "/root/testdata/sf0.001"

RUN = """
import os, sys
from pyspark.sql import SparkSession
from brookline import queries
place = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,700]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{place}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in sys.argv[3:]:
    queries.queries()[name](spark, sys.argv[2]).write.parquet(f"{place}/{name}")
assert not [x for x in os.listdir(os.environ["TMPDIR"]) if x.startswith("brookline-")]
"""


def on_cluster(place, *names):
    """Writes the queries' results with two executors that share nothing but the checkpoint folder with the driver."""
    import pyspark

    home = place / "home"
    for d in (home / "work", place / "shared", place / "tmp"):
        d.mkdir(parents=True)
    installed = os.path.dirname(pyspark.__file__)
    for x in os.listdir(installed):  # executors' logs go to work in Spark's home
        if x != "work":
            (home / x).symlink_to(f"{installed}/{x}")
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "TMPDIR": str(place / "tmp"), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", RUN, str(place), DATA, *names], env=env, cwd=place, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


def same_as_sql(place, name):
    from brookline import queries

    duckdb = pytest.importorskip("duckdb")
    held = duckdb.connect()
    for t in ("customer", "orders"):
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = held.sql(queries.oracle_sql()[name]), held.sql(f"SELECT * FROM '{place}/{name}/*.parquet'")
    columns = ", ".join(sorted(want.columns))
    rows = lambda x: sorted(x.select(columns).fetchall())
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) != []


def test_nested_appends_on_a_cluster(tmp_path):
    on_cluster(tmp_path, "db_append_nested")
    same_as_sql(tmp_path, "db_append_nested")


def test_round_trip_on_a_cluster(tmp_path):
    on_cluster(tmp_path, "db_round_trip")
    same_as_sql(tmp_path, "db_round_trip")


def test_a_table_that_was_read_is_a_copy(spark):
    db = Database.create("derby", "memory:copies;create=true")
    schema = FlowSchema.make(("A", "int"), ("B", "string"), key=FlowKey.asc("A", unique=True))
    write_db(db, "copied")(Flow.rows(spark, [(1, "a"), (2, "")], schema))
    found = read_db(spark, db, "copied")
    write_db(db, "copied")(Flow.rows(spark, [(3, "c")], schema))
    assert [tuple(r) for r in found.collect()] == [(1, "a"), (2, "")]


def test_small_portions_and_slices_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jdbc, "PORTION_BYTES", 200)
    monkeypatch.setattr(jdbc, "SLICE_BYTES", 500)
    monkeypatch.setattr(jdbc, "BATCH_ROWS", 7)
    db = Database.create("derby", "memory:portions;create=true")
    frame = spark.range(100).selectExpr("id", "cast(id / 3 as decimal(20, 2)) AS d", "id % 2 = 0 AS even", "date'2020-02-29' AS day", "if(id = 5, null, concat('x', id)) AS text")
    flow = Flow.of(frame)
    write_db(db, "portions")(flow)
    append_db(db, "portions")(flow.with_df(frame.selectExpr("id + 100 AS id", "d", "even", "day", "text")))
    found = sorted(map(tuple, read_db(spark, db, "portions").frame().collect()))
    assert [r[0] for r in found] == list(range(200))
    assert found[105] == (105, decimal.Decimal("1.67"), False, datetime.date(2020, 2, 29), "") and found[6][4] == "x6"


def test_what_is_embedded():
    urls = {"jdbc:derby:memory:a": True, "jdbc:derby:/tmp/a": True, "jdbc:derby://host:1527/a": False, "jdbc:sqlite:/tmp/a": True, "jdbc:mysql://host/a": False}
    assert {u: Database(u).embedded for u in urls} == urls
