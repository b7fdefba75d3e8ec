"""Small fixtures with the results written out: one or more for each group of operators."""

from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from brookline import operators as O
from brookline.errors import FormatNotFound, PipelineError, SchemaError
from brookline.flow import Flow
from brookline.plans import multi_run, stage
from brookline.plans.graph import to_dot
from brookline.schema import FlowKey, FlowSchema
from brookline.sources import CollectorSink, Tap
from brookline.sources import formats, serde, taps
from brookline.streaming import stream

S = FlowSchema.make


def values(flow: Flow, *names: str) -> list[tuple]:
    return [tuple(r[n] for n in names) if names else tuple(r) for r in flow.frame().collect()]


@pytest.fixture
def left(spark):
    return Flow.rows(spark, [(1.0, 1, "a"), (2.0, 2, "b"), (3.0, 2, "c"), (4.0, 9, "d")], S(("field2", "float", -2.0), ("field3", "int", -2), ("bar", "string", "def3"), key=FlowKey.asc("field3")))


@pytest.fixture
def right(spark):
    return Flow.rows(spark, [(1, "x", "p"), (2, "y", "q"), (2, "z", "r"), (7, "w", "s")], S(("field1", "int", -1), ("foo", "string", "def1"), ("qux", "string", "def2"), key=FlowKey.asc("field1")))


@pytest.mark.parametrize(
    "size,direction,wanted",
    [
        (O.SMALL, O.INNER, [("a", "x"), ("b", "z"), ("c", "z")]),
        (O.SMALL, O.LEFT, [("a", "x"), ("b", "z"), ("c", "z"), ("d", "def1")]),
        (O.SMALL, O.FULL, [("a", "x"), ("b", "z"), ("c", "z"), ("d", "def1"), ("def3", "w")]),
        (O.LARGE, O.INNER, [("a", "x"), ("b", "y"), ("b", "z"), ("c", "y"), ("c", "z")]),
        (O.LARGE, O.LEFT, [("a", "x"), ("b", "y"), ("b", "z"), ("c", "y"), ("c", "z"), ("d", "def1")]),
        (O.ORDERED, O.INNER, [("a", "x"), ("b", "y"), ("c", "y")]),
        (O.ORDERED, O.LEFT, [("a", "x"), ("b", "y"), ("c", "y"), ("d", "def1")]),
        (O.ORDERED, O.FULL, [("a", "x"), ("b", "y"), ("c", "z"), ("d", "def1"), ("def3", "w")]),
    ],
)
def test_joins_by_policy(left, right, size, direction, wanted):
    joined = left.join_with(O.join(size, direction, ["field3"], ["field1"]), right)
    assert sorted(joined.frame().columns) == ["bar", "field2", "field3", "foo", "qux"]
    assert sorted(values(joined, "bar", "foo")) == sorted(wanted)


def test_right_only_rows_keep_their_key(left, right):
    joined = left.join_with(O.join(O.SMALL, O.FULL, ["field3"], ["field1"]), right)
    assert [r for r in values(joined, "field3", "field2", "qux") if r[2] == "s"] == [(7, -2.0, "s")]


def test_join_refuses_a_reused_name(left):
    with pytest.raises(SchemaError):
        left.join_with(O.join(O.SMALL, O.INNER, ["field3"], ["field3"]), left)


def test_join_with_empty_sides(spark, left, right):
    none = Flow.rows(spark, [], right.schema)
    assert sorted(values(left.join_with(O.join(O.ORDERED, O.LEFT, ["field3"], ["field1"]), none), "bar", "foo")) == [(x, "def1") for x in "abcd"]
    assert values(left.join_with(O.join(O.LARGE, O.INNER, ["field3"], ["field1"]), none)) == []


def test_collate(spark):
    schema = S(("k", "int"), ("n", "int"), key=FlowKey.asc("k", unique=True))
    new, old = Flow.rows(spark, [(1, 10), (3, 30)], schema), Flow.rows(spark, [(1, 1), (2, 2)], schema)
    assert sorted(values(new.join_with(O.join_collate_ordered(["k"]), old), "k", "n")) == [(1, 10), (2, 2), (3, 30)]
    assert sorted(values(new.join_with(O.join_collate_sum(O.SMALL, ["k"], "n"), old), "k", "n")) == [(1, 11), (2, 2), (3, 30)]


def test_group_flatten_and_outer_columns(spark):
    base = Flow.rows(spark, [(1.0, "b", 1), (2.0, "a", 2), (3.0, "b", 1), (4.0, "a", 1)], S(("field1", "float", -1.0), ("key", "string"), ("key2", "int")))
    grouped = base | O.group(["key", "key2"], "grouped")
    got = {(r["key"], r["key2"]): [x["field1"] for x in r["grouped"]] for r in grouped.frame().collect()}
    assert got == {("a", 1): [4.0], ("a", 2): [2.0], ("b", 1): [1.0, 3.0]}
    assert grouped.schema.key.names == ["key", "key2"] and grouped.schema.key.unique
    assert sorted(values(grouped | O.flatten("grouped"), "field1")) == [(1.0,), (2.0,), (3.0,), (4.0,)]
    sums = grouped | O.add_outer_column(("total", "float"), "grouped", lambda r: r.sum("field1"))
    assert sums.frame().columns[0] == "total" and sorted(values(sums, "total")) == [(2.0,), (4.0,), (4.0,)]
    assert len(values(base | O.group([], "all"))) == 1
    assert values(Flow.rows(spark, [], base.schema) | O.group([], "all")) == []


def test_columns(spark):
    base = Flow.rows(spark, [(1, " 'A' ", "2.5"), (2, '"b"', "n\\a")], S(("id", "int"), ("s", "string"), ("f", "string")))
    assert values(base | O.cleanup_input(), "s") == [("A",), ("b",)]
    assert values(base | O.add_column(("x", "int"), lambda t: t["id"] + 1))[0][0] == 2
    assert values(base | O.keep_columns("f", "id")) == [(1, "2.5"), (2, "n\\a")]
    with pytest.raises(SchemaError):
        base | O.drop_columns("absent")
    typed = values(base | O.partial_schema_apply(S(("f", "float"), ("absent", "int"))), "f")
    assert typed[0] == (2.5,) and typed[1][0] != typed[1][0]
    assert values(base | O.fill_columns(S(("extra", "int", 7), ("id", "string")))) == [(7, "1"), (7, "2")]
    assert values(base | O.to_lower("s") | O.rename_columns({"s": "t", "none": "x"}), "t") == [(" 'a' ",), ('"b"',)]


def test_line_splitter(spark):
    lines = Flow.rows(spark, [('a,"b,c",d',), ("x,'y",), ("1,2,3",)], S(("$0", "string")))
    assert values(lines | O.split_line_on_comma(3)) == [("a", '"b,c"', "d"), ("x", "'y", ""), ("1", "2", "3")]


def test_order_and_windows(spark):
    base = Flow.rows(spark, [(i,) for i in (5, 1, 4, 2, 3)], S(("val", "int", -1)))
    ordered = base | O.sort_by_key(FlowKey.asc("val", unique=True))
    assert values(ordered) == [(1,), (2,), (3,), (4,), (5,)]
    assert values(base | O.limit(1, 2)) == [(1,), (4,)]
    window = ordered | O.sliding_window(3, lambda s: S(("val", "int"), ("n", "int"), ("top", "int")), lambda w: {"val": w.row["val"], "n": w.count(), "top": w.max("val")})
    assert sorted(values(window)) == [(1, 3, 3), (2, 3, 4), (3, 3, 5), (4, 2, 5), (5, 1, 5)]
    with pytest.raises(Exception):
        (base | O.expect_ordering(FlowKey.asc("val"))).frame().collect()
    done = base | O.filter_rows(lambda t: F.when(t["val"] == 4, "done").otherwise("accept"))
    assert sorted(values(done)) == [(1,), (5,)]


def test_unique_ids(spark):
    base = Flow.rows(spark, [(x, i) for i, x in enumerate((1, 0, 3, 0, 0, 2))], S(("field1", "int"), ("at", "int")))
    assert sorted(values(base | O.assign_unique_ids("field1"), "at", "field1")) == [(0, 1), (1, 4), (2, 3), (3, 5), (4, 6), (5, 2)]


def test_pivot(spark):
    inner = [("l1", [(1.0, 1), (2.0, 2)]), ("l2", [(3.0, 2)]), ("l3", [])]
    schema = S(("id", "string"), ("values", (Flow.rows(spark, [(1.0, 1)], S(("value", "float", -1.0), ("k", "int"))) | O.group([], "v")).frame().schema["v"].dataType))
    base = Flow.rows(spark, inner, schema)
    names = Flow.rows(spark, [(1, "one"), (2, "two")], S(("kr", "int"), ("name", "string")))
    made = base.join_with(O.explode_inner(("values", ["k"], "value"), (["kr"], "name")), names)
    assert [r[0] for r in sorted(values(made, "id", "one", "two"))] == ["l1", "l2", "l3"]
    assert sorted(values(made, "id", "one", "two"))[0] == ("l1", 1.0, 2.0)


def test_key_algebra():
    key = FlowKey.asc("a", "b", unique=True)
    assert key.subset(["a"]).names == ["a"] and not key.subset(["a"]).unique
    assert key.drop(["b"]).names == ["a"] and not key.drop(["b"]).unique and key.rename({"a": "z"}).names == ["z", "b"]
    assert FlowKey((), True).singleton and key.satisfies(FlowKey.asc("a"))
    assert key.least_restrictive(FlowKey.asc("a")).names == ["a"]


def test_schema_algebra():
    schema = S(("a", "int", 5), ("b", "string"))
    assert schema.default_row() == {"a": 5, "b": ""}
    assert schema.drop(["a"]).names == ["b"] and schema.keep(["b", "a"]).names == ["a", "b"]
    for wrong in (lambda: S(("a", "int"), ("a", "int")), lambda: schema.drop(["x"]), lambda: schema.column("x")):
        with pytest.raises(SchemaError):
            wrong()


@pytest.mark.parametrize("name", ["t.csv", "t.tsv", "t.xml", "t.bin", "t.csv.gz"])
def test_files(spark, tmp_path, name):
    base = Flow.rows(spark, [(1, "a,b"), (2, "it's"), (3, "")], S(("id", "int"), ("s", "string")))
    path = f"file://{tmp_path}/{name}"
    taps.write_to_file_auto(path).run(base)
    read = taps.read_from_file_auto(spark, path).open() | O.cleanup_input() | O.partial_schema_apply(base.schema)
    assert sorted(values(read, "id", "s")) == [(1, "a,b"), (2, "it's"), (3, "")]


def test_unknown_format():
    with pytest.raises(FormatNotFound):
        formats.format_of("t.unknown")


@pytest.mark.parametrize("form", [serde.BINARY_FORM, serde.XML_FORM])
def test_serde(spark, form):
    flow = Flow.rows(spark, [(1, 2.5, "x"), (2, 0.0, "é<&")], S(("foo", "int"), ("f", "float"), ("s", "string")))
    rows, schema = serde.deserialize_rows(serde.serialize_rows(flow.frame().collect(), flow.schema, form), form)
    assert schema.names == ["foo", "f", "s"] and [tuple(r.values()) for r in rows] == [(1, 2.5, "x"), (2, 0.0, "é<&")]


def test_graph(spark):
    tap = Tap.from_rows(spark, [(1,), (2,), (3,)], S(("val", "int", -1)))
    a, b = CollectorSink("a"), CollectorSink("b")
    sinks = [(a, (stage("in") | O.simple_filter(lambda t: t["val"] > 1)) % "big"), (b, stage("big") | O.add_column(("twice", "int"), lambda t: t["val"] * 2))]
    multi_run(sinks, {"in": tap})
    assert sorted(values(a.flow)) == [(2,), (3,)] and sorted(values(b.flow)) == [(4, 2), (6, 3)]
    assert to_dot(sinks, {"in": tap}).startswith("digraph")
    with pytest.raises(PipelineError):
        multi_run([(CollectorSink("c"), stage("absent"))], {})


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, s string").write.parquet(f"{tmp_path}/in")
    flow = stream.read_stream(spark, f"{tmp_path}/in", S(("id", "int"), ("s", "string"))) | O.simple_filter(lambda t: t["id"] > 1)
    stream.write_stream(flow, "parquet", f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, "b")]


def test_stream_of_bytes(spark):
    flow = Flow.rows(spark, [(1, "a")], S(("id", "int"), ("s", "string")))
    out = io.BytesIO()
    taps.write_to_stream(formats.format_of("t.csv"), out).run(flow)
    assert out.getvalue().decode().splitlines() == ["id,s", "1,a"]


def test_order_after_a_sort(spark):
    base = Flow.rows(spark, [(x,) for x in (5, 1, 4, 2, 3)], S(("v", "int")))
    down = base | O.sort_by_key(FlowKey((("desc", "v"),), True))
    assert values(down | O.take_while(lambda t: t["v"] > 2), "v") == [(5,), (4,), (3,)]
    ids = down | O.add_column(("id", "int"), lambda t: F.lit(0).cast("bigint")) | O.assign_unique_ids("id")
    assert sorted(values(ids, "v", "id")) == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_a_folder_is_read_in_the_order_of_its_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n1\n2\n")
    (tmp_path / "b.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(3, 60)))
    (tmp_path / "c d.csv").write_text("v\n60\n")
    read = taps.read_from_file(spark, formats.CSV, f"file://{tmp_path}").open()
    assert [r["v"] for r in read.collect()] == [str(i) for i in range(1, 61)]
    assert [r["v"] for r in (read | O.limit(0, 4)).collect()] == ["1", "2", "3", "4"]


def test_decimals_are_unsigned_only_by_mark(spark):
    plain = Flow.of(spark.sql("SELECT 1 AS k, CAST(1.25 AS DECIMAL(12, 2)) AS x, CAST(-3 AS DECIMAL(20, 0)) AS y"), FlowKey.asc("k", unique=True))
    assert plain.schema.simple == [("k", "int"), ("x", "decimal"), ("y", "decimal")]
    other = Flow.of(spark.sql("SELECT 1 AS k, CAST(1.30 AS DECIMAL(12, 2)) AS x, CAST(1 AS DECIMAL(20, 0)) AS y"), FlowKey.asc("k", unique=True))
    [(total,)] = values(plain.join_with(O.join_collate_sum(O.SMALL, ["k"], "x"), other), "x")
    assert str(total) == "2.55"
    marked = plain | O.add_columns(S(("u", "unsigned")), lambda t: {"u": F.lit(7)})
    again = Flow.of(marked.frame())
    assert again.schema.simple[-1] == ("u", "unsigned") and again.schema.simple[2] == ("y", "decimal")
    wrapped = Flow.rows(spark, [(-1,), (2,)], S(("k", "int"))) | O.partial_schema_apply(S(("k", "unsigned")))
    assert [int(v) for (v,) in values(wrapped)] == [2**64 - 1, 2]


def test_nested_pipe_takes_any_operator(spark):
    base = Flow.rows(spark, [(k, i) for k, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], S(("k", "string"), ("v", "int"))) | O.group(["k"], "g")
    made = base | O.nested_pipe("g", "h", lambda f: f | O.simple_filter(lambda t: t["v"] > 0) | O.add_column(("twice", "int"), lambda t: t["v"] * 2))
    assert {r["k"]: [tuple(x) for x in r["h"]] for r in made.frame().collect()} == {"a": [(2, 1), (4, 2)], "b": [], "c": [(2, 1)]}
    plain = base | O.inner_pipe("g", "h", None, lambda rows: [{"n": len(rows)}], S(("n", "int")))
    assert {r["k"]: r["h"][0]["n"] for r in plain.frame().collect()} == {"a": 3, "b": 1, "c": 2}


def test_aggregates_of_a_group_that_is_dropped(spark):
    base = Flow.rows(spark, [("a", 1, 2.0), ("a", 3, 4.0), ("b", 5, 6.0)], S(("k", "string"), ("n", "int"), ("x", "float"))) | O.group(["k"], "g")
    made = base | O.add_outer_column(("n", "int"), "g", lambda r: r.sum("n")) | O.add_outer_column(("mean", "float"), "g", lambda r: r.avg("x")) | O.add_outer_column(("c", "int"), "g", lambda r: r.count() + 1)
    assert sorted(values(made | O.drop_columns("g"), "k", "n", "mean", "c")) == [("a", 4, 3.0, 3), ("b", 5, 6.0, 2)]
    assert sorted(values(made | O.keep_columns("k", "mean"))) == sorted((m, k) if made.schema.names.index("mean") < made.schema.names.index("k") else (k, m) for k, m in (("a", 3.0), ("b", 6.0)))
    sizes = made | O.add_outer_column(("size", "int"), "g", lambda r: F.size(r.array)) | O.drop_columns("g")
    assert sorted(values(sizes, "k", "size", "n")) == [("a", 2, 4), ("b", 1, 5)]


def test_database(spark):
    from brookline.sources import Database, append_db, infer_schema, read_db, write_db

    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    db = Database.create("derby", "memory:tests;create=true")
    schema = S(("A", "int"), ("B", "string"), ("C", "float"), key=FlowKey.asc("A", "B", unique=True))
    write_db(db, "made")(Flow.rows(spark, [(2, "b", 2.5), (1, "a", 0.5)], schema))
    assert infer_schema(spark, db, "made").key == schema.key
    append_db(db, "made")(Flow.rows(spark, [(3, "c", 1.5)], schema))
    assert [tuple(r) for r in read_db(spark, db, "made").collect()] == [(1, "a", 0.5), (2, "b", 2.5), (3, "c", 1.5)]
    with pytest.raises(Exception):
        append_db(db, "made")(Flow.rows(spark, [(3, "c", 1.5)], schema))
    write_db(db, "made")(Flow.rows(spark, [], schema.with_key(FlowKey.asc("B"))))
    assert values(read_db(spark, db, "made")) == [] and infer_schema(spark, db, "made").key == FlowKey()


def test_staged_folders_go(spark):
    from brookline import staging

    frame = staging.staged(spark.range(3), "test")
    other = staging.settled(lambda: staging.staged(spark.range(4), "inner").filter("id > 1"), "outer")
    assert frame.staged_at in staging._folders and not any("/inner-" in f for f in staging._folders)
    assert other.count() == 2
    staging.discard(frame)
    assert frame.staged_at not in staging._folders
