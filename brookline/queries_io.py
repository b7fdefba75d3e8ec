"""Queries of files, databases, serialization, sinks, probes, folds and graphs, and their SQL."""

from __future__ import annotations

import base64
import contextlib
import io
import os
import tempfile
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from . import operators as O
from . import types as types_
from .flow import Flow
from .functions import scalars
from .operators.nested import OUTER
from .plans import multi_run, stage
from .plans.graph import run, run_simple, stage_name, tap_name, to_dot
from .queries import S, flow, query
from .schema import ASC, DESC, FlowKey
from .sources import CollectorSink, Database, DbTable, NullSink, Sink, Tap, append_db, flow_sink, formats, infer_schema, jdbc, pipe_sink, read_db, serde, taps, write_db
from .sources.delimited import rejected_lines
from .staging import fresh_path
from .streaming import stream

CUSTOMER = S(("c_custkey", "int"), ("c_name", "string"), ("c_acctbal", "float"))


def _customer(spark, sf) -> Flow:
    return flow(spark, sf, "customer", CUSTOMER.names, FlowKey.asc("c_custkey", unique=True))


def _orders_by_customer(spark, sf) -> Flow:
    return flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True)) | O.group(["o_custkey"], "orders")


def _through_file(spark, made: Flow, name: str, single: bool = False) -> Flow:
    path = f"{fresh_path(spark, 'files')}/{name}"
    taps.write_to_file_auto(path, single).run(made)
    return taps.read_from_file_auto(spark, path).open()


_FIRST = "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 200 OFFSET 3"


@query(_FIRST)
def files_csv(spark, sf):
    """A folder of files with headers, read in the order in which it was written."""
    return (_through_file(spark, _customer(spark, sf), "t.csv") | O.cleanup_input() | O.partial_schema_apply(CUSTOMER) | O.limit(3, 200)).frame()


@query(_FIRST)
def files_csv_single(spark, sf):
    """One file, as the driver writes it."""
    return (_through_file(spark, _customer(spark, sf), "t.csv", single=True) | O.cleanup_input() | O.partial_schema_apply(CUSTOMER) | O.limit(3, 200)).frame()


@query("SELECT o_orderkey, o_orderstatus || chr(44) || '\"' AS mark FROM orders")
def files_tab_gz(spark, sf):
    made = flow(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]) | O.add_column(("mark", "string"), lambda t: F.concat(t["o_orderstatus"], F.lit(',"'))) | O.drop_columns("o_orderstatus")
    return (_through_file(spark, made, "t.tab.gz") | O.strip_quotes | O.partial_schema_apply(S(("o_orderkey", "int")))).frame()


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, '' AS empty, CAST(n_nationkey AS DOUBLE) / 3 AS third FROM nation")
def files_xml(spark, sf):
    made = flow(spark, sf, "nation", ["n_name", "n_regionkey", "n_nationkey"]) | O.add_columns(S(("empty", "string"), ("third", "float")), lambda t: {"empty": F.lit(""), "third": t["n_nationkey"] / F.lit(3.0)})
    return _through_file(spark, made | O.drop_columns("n_nationkey"), "t.xml").frame()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def files_binary(spark, sf):
    """A nested table through a file that keeps types, nesting, defaults and marks."""
    return (_through_file(spark, _orders_by_customer(spark, sf), "t.bin") | O.flatten("orders")).frame()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 10 = 0")
def files_multi(spark, sf):
    path = f"{fresh_path(spark, 'files')}/columns"
    taps.write_multi_file(path).run(_orders_by_customer(spark, sf) | O.simple_filter(lambda t: t["o_custkey"] % 10 == 0))
    return (taps.read_from_multi_file(spark, path).open() | O.flatten("orders")).frame()


@query("SELECT form, n_name, n_regionkey FROM (SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation) n, (VALUES ('csv'), ('tab'), ('xml'), ('bin'), ('csv.gz'), ('xml.gz'), ('single.xml'), ('single.bin'), ('stream'), ('web')) f(form)")
def strings_streams_and_web(spark, sf):
    """Rows as text or bytes that the driver holds, in every form, and back."""
    made = flow(spark, sf, "nation", ["n_name", "n_regionkey"], FlowKey.asc("n_name", unique=True))
    schema = S(("n_name", "string"), ("n_regionkey", "int"))
    found = []
    for name in ("csv", "tab", "xml", "bin", "csv.gz", "xml.gz"):
        form = formats.format_of(f"t.{name}")
        found.append((name, taps.read_from_string(spark, form, taps.write_to_string(form, made)).open()))
    for name in ("xml", "bin"):
        found.append((f"single.{name}", _through_file(spark, made, f"t.{name}", single=True)))
    held = io.BytesIO()
    taps.write_to_stream(formats.CSV, held).run(made)
    found.append(("stream", taps.read_from_stream(spark, formats.CSV, io.BytesIO(held.getvalue())).open()))
    found.append(("web", taps.read_from_web(spark, formats.CSV, "data:text/csv;base64," + base64.b64encode(held.getvalue()).decode()).open()))
    tagged = [(f | O.partial_schema_apply(schema) | O.keep_columns("n_name", "n_regionkey")).frame().withColumn("form", F.lit(n)) for n, f in found]
    return reduce(lambda a, b: a.unionByName(b), tagged)


@query("SELECT 0 AS written, 0 AS named, 2 AS columns")
def files_null(spark, sf):
    """The form that keeps nothing, by its suffix and by an empty name."""
    schema = S(("a", "int"), ("b", "string"))
    path = f"{fresh_path(spark, 'files')}/t.null"
    taps.write_to_file_auto(path).run(_customer(spark, sf))
    written = taps.read_from_file_auto(spark, path, schema).open()
    named = taps.read_from_file(spark, formats.CSV, "", schema).open()
    return spark.createDataFrame([(written.df.count(), named.df.count(), len(written.schema.columns))], "written bigint, named bigint, columns bigint").selectExpr("cast(written as int) written", "cast(named as int) named", "cast(columns as int) columns")


@query("SELECT value FROM (SELECT c_name || ',' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 50 = 0 THEN ',more' ELSE '' END AS value, c_custkey FROM customer) x WHERE c_custkey % 50 = 0")
def files_rejected(spark, sf):
    """Lines of another number of fields are left out, and can be asked for."""
    path = fresh_path(spark, "lines")
    lines = flow(spark, sf, "customer", ["c_custkey", "c_name"]).df.select(F.concat("c_name", F.lit(","), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 50 == 0, ",more").otherwise("")).alias("value"))
    lines.write.text(path)
    return rejected_lines(spark, path, ",", 2, header=False).select("value")


@contextlib.contextmanager
def _database(spark):
    """An empty database in a folder of the driver's own, which goes afterwards; tables that were read are copies."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    with tempfile.TemporaryDirectory(prefix="brookline-") as folder:
        path = f"{os.path.realpath(folder)}/db"
        yield Database.create("derby", f"{path};create=true")
        with contextlib.suppress(Py4JJavaError):  # Derby reports the end of a database as an error
            spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{path};shutdown=true")


@query("SELECT c_custkey, c_name, c_acctbal, 'c_custkey' AS key FROM customer")
def db_round_trip(spark, sf):
    """A table with a primary key, which is found again when it is read."""
    with _database(spark) as db:
        write_db(db, "customers")(_customer(spark, sf))
        found = read_db(spark, db, "customers", partition_on="c_custkey", bounds=(1, 1500), partitions=4)
        key = infer_schema(spark, db, "customers").key
        assert key.unique and found.schema.key == key
        return found.frame().withColumn("key", F.lit(",".join(key.names)))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 5 < 3")
def db_append_nested(spark, sf):
    """A nested column in a table that is created, then added to by a sink and by an open table."""
    made = _orders_by_customer(spark, sf)
    part = lambda k: made | O.simple_filter(lambda t: t["o_custkey"] % 5 == k)
    with _database(spark) as db:
        table = DbTable(spark, db, "grouped_orders", jdbc.CREATE, made.schema)
        table.write(part(0))
        append_db(db, "grouped_orders")(part(1))
        DbTable(spark, db, "grouped_orders", jdbc.APPEND, made.schema).write(part(2))
        return (table.read() | O.flatten("orders")).frame()


@query("SELECT form, o_custkey, o_orderkey, o_totalprice FROM orders, (VALUES ('xml'), ('binary'), ('packed')) f(form) WHERE o_custkey % 20 = 1")
def serialization(spark, sf):
    """Nested rows and their schema as bytes, plain and compressed."""
    made = _orders_by_customer(spark, sf) | O.simple_filter(lambda t: t["o_custkey"] % 20 == 1)
    rows, schema = made.collect(), made.schema
    for form in (serde.XML_FORM, serde.BINARY_FORM):
        assert serde.deserialize_schema(serde.serialize_schema(schema, form), form).simple == schema.simple
    found = {form: serde.deserialize_rows(serde.serialize_rows(rows, schema, form), form) for form in (serde.XML_FORM, serde.BINARY_FORM)}
    found["packed"] = serde.decompress_rows(serde.compress_rows(rows, schema))
    back = [(Flow.rows(spark, [tuple(r[n] for n in s.names) for r in held], s) | O.flatten("orders")).frame().withColumn("form", F.lit(form)) for form, (held, s) in found.items()]
    return reduce(lambda a, b: a.unionByName(b), back)


@query("SELECT kind, c_custkey, c_name, c_acctbal FROM customer, (VALUES ('kept'), ('spilled')) k(kind)")
def kept_and_spilled(spark, sf):
    """A flow kept as compressed columns, and one written to the shared folder."""
    kept, spilled = serde.compress_flow(_customer(spark, sf)), serde.spill_flow(_customer(spark, sf))
    return kept.frame().withColumn("kind", F.lit("kept")).unionByName(spilled.frame().withColumn("kind", F.lit("spilled")))


@query("SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS seen FROM customer WHERE c_acctbal > 5000")
def sinks_and_tees(spark, sf):
    """A flow handed to sinks of one's own on its way."""
    seen = []
    made = _customer(spark, sf) | O.simple_filter(lambda t: t["c_acctbal"] > 0) | pipe_sink(NullSink()) | pipe_sink(Sink("count", lambda f: seen.append(f.df.count())))
    last = CollectorSink("last")
    run_simple(Tap.from_flow(made), [O.simple_filter(lambda t: t["c_acctbal"] > 5000)], last)
    flow_sink("again", lambda f: seen.append(f.df.count())).run(made)
    assert seen[0] == seen[1]
    return last.flow.frame().withColumn("seen", F.lit(seen[0]).cast("bigint"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, lower(n_name) AS name, length(n_name) AS size, n_name || '!' AS loud FROM nation")
def maps_of_each_kind(spark, sf):
    made = flow(spark, sf, "nation", ["n_nationkey", "n_name"], FlowKey.asc("n_nationkey", unique=True)) | O.identity
    made = made | O.fast_map(lambda s: S(("k", "int"), ("name", "string"), key=FlowKey.asc("k", unique=True)), lambda s, t: {"k": t["n_nationkey"], "name": t["n_name"]})
    made = made | O.simple_map_add(("size", "int"), lambda t: F.length(t["name"])) | O.map_add(lambda s: s.column("name").__class__.make("loud", "string"), lambda t: F.concat(t["name"], F.lit("!")))
    made = made | O.simple_map(lambda s: s, lambda t: {n: F.lower(t[n]) if n == "name" else t[n] for n in t.schema.names}) | O.partial_schema_apply_if_exists(S(("k", "int"), ("absent", "float")))
    assert made.schema.key.unique
    return made.frame()


@query("""SELECT c_custkey, '"' || c_name || ', ' || c_mktsegment || '"' AS a, c_name AS b, '' AS c, c_name AS tab_a, c_mktsegment || ',x' AS tab_b FROM customer""")
def split_lines(spark, sf):
    """Separators inside quotes are text; missing fields are empty."""
    base = flow(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"]).df
    comma = F.concat(F.lit('"'), "c_name", F.lit(", "), "c_mktsegment", F.lit('",'), "c_name", F.lit(","), F.col("c_custkey").cast("string"))
    tab = F.concat("c_name", F.lit("\t"), "c_mktsegment", F.lit(",x\t"), F.col("c_custkey").cast("string"))
    line = S(("$0", "string"))
    a = Flow(base.select(comma.alias("$0")), line) | O.split_line_on_comma(4) | O.rename_columns({"$0": "a", "$1": "b", "$2": "k", "$3": "c"})
    b = Flow(base.select(tab.alias("$0")), line) | O.split_line_on_tab(3) | O.rename_columns({"$0": "tab_a", "$1": "tab_b", "$2": "k2"})
    both = a.join_with(O.join(O.LARGE, O.INNER, ["k"], ["k2"]), b)
    return (both | O.rename_columns({"k": "c_custkey"}) | O.partial_schema_apply(S(("c_custkey", "int")))).frame()


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS top, -9223372036854775808 AS none FROM orders WHERE o_orderstatus = 'F'")
def folds(spark, sf):
    """Results of folds over the rows that pass, known after the run."""
    count, n = O.fold(0, lambda t: F.count(F.lit(1)))
    add, total = O.fold(0.0, lambda t: F.sum(t["o_totalprice"]))
    (most, top), (least, none) = O.column_max("o_orderkey"), O.column_max("o_orderkey")
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"]) | O.filter_column("o_orderstatus", lambda x: x == "F")
    NullSink().run(base | count | add | most)
    NullSink().run(base | O.simple_filter(lambda t: F.lit(False)) | least)
    return spark.createDataFrame([(n.result, round(total.result, 2), top.result, none.result)], "n bigint, total double, top bigint, none bigint")


@query("SELECT count(*) FILTER (WHERE value > 50) AS probed, CAST(5 AS BIGINT) AS printed, count(*) AS passed, CAST(1 AS BIGINT) AS described, CAST(1 AS BIGINT) AS reported FROM events")
def probes(spark, sf):
    """Looks at passing rows: an action for each match, printed rows, the schema, and a report of the run."""
    hits, out, status = spark.sparkContext.accumulator(0), io.StringIO(), io.StringIO()
    report, passed = O.print_status("events", 60.0, status)
    made = flow(spark, sf, "events", ["event_id", "value"]) | O.probe(lambda t: t["value"] > 50, lambda row: hits.add(1)) | report
    NullSink().run(made)
    flow(spark, sf, "events", ["event_id", "value"]) | O.print_probe(lambda r: f"event {r['event_id']}", lambda t: t["value"] > 50, 5, out) | O.print_schema_probe("events", out)
    n = passed.result
    for _ in range(100):
        if "rows passed" in status.getvalue():
            break
        import time

        time.sleep(0.1)
    lines = out.getvalue().splitlines()
    row = (hits.value, sum(x.startswith("event ") for x in lines), n, sum(x.startswith("events: event_id int, value float") for x in lines), int(f"events: {n} rows passed" in status.getvalue()))
    return spark.createDataFrame([row], "probed bigint, printed bigint, passed bigint, described bigint, reported bigint")


@query("""SELECT o_orderkey, c_name, n_name, r_name, 'orders' AS tap, 'named' AS stage, CAST(1 AS BIGINT) AS drawn FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'""")
def graph_of_joins(spark, sf):
    """Stages with functions of stages, chains, joins with other stages, and published names."""
    names = {"customer": ["c_custkey", "c_name", "c_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "orders": "o_orderkey"}
    made_taps = {n: Tap(lambda n=n: flow(spark, sf, n, names[n], FlowKey.asc(keys[n], unique=True))) for n in names}
    join = lambda a, b: O.join(O.SMALL, O.INNER, [a], [b])
    pending = stage("orders").apply(lambda s: s | O.filter_column("o_orderstatus", lambda x: x == "P")) % "pending"
    named = stage("pending").join_with(join("o_custkey", "c_custkey"), stage("customer")).multi_join([(join("c_nationkey", "n_nationkey"), stage("nation")), (join("n_regionkey", "r_regionkey"), stage("region"))])
    named = named.chain([O.drop_columns("o_custkey", "o_orderstatus"), O.keep_columns("o_orderkey", "c_name", "n_name", "r_name")]) % "named"
    first, last = CollectorSink("pending"), CollectorSink("named")
    sinks = [(first, pending), (last, named)]
    multi_run(sinks, made_taps)
    drawn = to_dot(sinks, made_taps)
    told = (tap_name(pending), stage_name(named), int(drawn.startswith("digraph") and drawn.count("style=dashed") == 3))
    again = CollectorSink("again")
    run(again, stage("orders") | O.filter_column("o_orderstatus", lambda x: x == "P"), made_taps)
    assert again.flow.df.count() == first.flow.df.count()
    return last.flow.frame().withColumns({"tap": F.lit(told[0]), "stage": F.lit(told[1]), "drawn": F.lit(told[2]).cast("bigint")})


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_totalprice, b.o_totalprice) AS o_totalprice FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) a
FULL JOIN (SELECT o_orderkey, -o_totalprice AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey""")
def collate_ordered_rows(spark, sf):
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True))
    other = base | O.downsample("o_orderkey", 3) | O.map_rows(lambda s: s, lambda t: {"o_orderkey": t["o_orderkey"], "o_totalprice": -t["o_totalprice"]}, lambda k: k)
    return O.join_collate_ordered_rows(base | O.downsample("o_orderkey", 2), other, ["o_orderkey"]).frame()


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def multi_join(spark, sf):
    join = lambda a, b: O.join(O.SMALL, O.INNER, [a], [b])
    nation, region = flow(spark, sf, "nation", None, FlowKey.asc("n_nationkey", unique=True)), flow(spark, sf, "region", None, FlowKey.asc("r_regionkey", unique=True))
    made = flow(spark, sf, "customer", ["c_custkey", "c_nationkey"]) | O.multi_join([(join("c_nationkey", "n_nationkey"), nation), (join("n_regionkey", "r_regionkey"), region)])
    return (made | O.keep_columns("c_custkey", "n_name", "r_name")).frame()


@query("SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part WHERE p_size > 10), 9) AS share FROM part")
def sequential_merge(spark, sf):
    """A join of one's own: all of the right side is seen first."""
    parts = flow(spark, sf, "part", ["p_partkey", "p_retailprice", "p_size"])
    prepare = lambda right: right.df.agg(F.max("p_retailprice")).first()[0]
    merge = lambda top, left: left | O.add_column(("share", "float"), lambda t: F.round(t["p_retailprice"] / F.lit(top), 9)) | O.keep_columns("p_partkey", "share")
    return parts.join_with(O.sequential_merge(prepare, merge), parts | O.simple_filter(lambda t: t["p_size"] > 10)).frame()


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN try_cast(x AS BIGINT) IS NOT NULL AND x NOT LIKE '%.%' THEN 'int' WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind
FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.25' ELSE o_orderpriority END AS x FROM orders) y) z GROUP BY kind""")
def best_fit(spark, sf):
    """The narrowest type of each text, worked out by column and checked against the driver's own on a few."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".25"))).otherwise(F.col("o_orderpriority"))
    made = flow(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).df.select(text.alias("x"))
    assert [type(types_.best_fit(x)) for x in ("12", "1.5", "x1")] == [int, float, str]
    return made.select(types_.best_fit_type(F.col("x")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('l_orderkey', 'int', 1), ('l_quantity', 'float', 2), ('l_returnflag', 'string', 3), ('u', 'unsigned', 4), ('d', 'decimal', 5), ('g', 'nested', 6)) t(name, kind, place)")
def types_of_columns(spark, sf):
    """Logical types by column, and accessors that refuse another type."""
    made = flow(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"]) | O.add_columns(S(("u", "unsigned"), ("d", "decimal(12,2)")), lambda t: {"u": t.int("l_orderkey"), "d": t.float("l_quantity")})
    nested = (made | O.group(["l_orderkey"], "g")).schema
    refused = 0
    for kind in ("int", "string", "unsigned"):
        try:
            getattr(made.fields, kind)("l_quantity")
        except ValueError:
            refused += 1
    assert refused == 3 and made.fields.try_get("absent") is None
    rows = [(n, k, i) for i, (n, k) in enumerate([*made.schema.simple, nested.simple[-1]], 1)]
    return spark.createDataFrame(rows, "name string, kind string, place int")


@query("""SELECT o_orderkey, CAST(CAST(o_custkey AS DECIMAL(20, 0)) + 7 AS DECIMAL(20, 0)) AS plus, o_custkey - o_orderkey AS minus, round(o_totalprice * o_totalprice, 2) AS times,
o_totalprice < 1000 OR o_custkey = o_orderkey AS small FROM orders""")
def arithmetic(spark, sf):
    """Sums, differences and products by type, and comparison."""
    made = flow(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    unsigned, number, price = S(("x", "unsigned")).column("x"), made.schema.column("o_custkey"), made.schema.column("o_totalprice")
    kind = unsigned.type
    new = S(("plus", "unsigned"), ("minus", "int"), ("times", "float"), ("small", "boolean"))
    values = lambda t: {
        "plus": scalars.add(types_.coerce(t["o_custkey"], number.type, kind), F.lit(7).cast("decimal(20,0)"), unsigned, unsigned), "minus": scalars.subtract(t["o_custkey"], t["o_orderkey"], number, number),
        "times": F.round(scalars.multiply(t["o_totalprice"], t["o_totalprice"], price, price), 2), "small": scalars.less(t["o_totalprice"], F.lit(1000.0), price.type) | scalars.equal(t["o_custkey"], t["o_orderkey"]),
    }
    return (made | O.add_columns(new, values) | O.drop_columns("o_custkey", "o_totalprice")).frame()


_BY_PRICE = FlowKey(((DESC, "o_totalprice"), (ASC, "o_orderkey")), True)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders WHERE o_orderkey % 97 = 5) OR (o_totalprice = (SELECT max(o_totalprice) FROM orders WHERE o_orderkey % 97 = 5) AND o_orderkey % 97 <> 5)")
def take_while_after_sort(spark, sf):
    """The order of a sort decides where a flow ends."""
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice"]) | O.sort_by_key(_BY_PRICE)
    return (base | O.take_while(lambda t: t["o_orderkey"] % 97 != 5) | O.keep_columns("o_orderkey")).frame()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 9 + row_number() OVER (PARTITION BY o_orderkey % 4 = 0 ORDER BY o_totalprice DESC, o_orderkey) ELSE 1 + o_orderkey % 9 END AS id FROM orders")
def ids_after_sort(spark, sf):
    """New ids follow the order of a sort."""
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice"]) | O.add_column(("id", "int"), lambda t: F.when(t["o_orderkey"] % 4 == 0, 0).otherwise(1 + t["o_orderkey"] % 9))
    return (base | O.sort_by_key(_BY_PRICE) | O.assign_unique_ids("id") | O.drop_columns("o_totalprice")).frame()


@query("""SELECT coalesce(a.k, b.k) AS l_partkey, CAST(coalesce(a.q, 0) + coalesce(b.q, 0) AS DECIMAL(12, 2)) AS l_tax FROM
(SELECT l_partkey AS k, CAST(sum(CAST(l_tax AS DECIMAL(12, 2))) AS DECIMAL(12, 2)) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN
(SELECT l_partkey AS k, CAST(sum(CAST(l_tax AS DECIMAL(12, 2))) AS DECIMAL(12, 2)) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON a.k = b.k""")
def collate_sum_decimal(spark, sf):
    """Decimals with a fraction are added as such."""
    base = flow(spark, sf, "lineitem", ["l_partkey", "l_tax", "l_returnflag"]) | O.map_rows(lambda s: S(("l_partkey", "int"), ("l_tax", "decimal(12,2)"), ("l_returnflag", "string")), lambda t: {n: t[n] for n in t.schema.names})
    part = lambda r: base | O.filter_column("l_returnflag", lambda x: x == r) | O.aggregate(["l_partkey"], [(("l_tax", "decimal(12,2)"), lambda t: F.sum(t["l_tax"]))])
    return part("A").join_with(O.join_collate_sum(O.LARGE, ["l_partkey"], "l_tax"), part("N")).frame()


@query("SELECT o_custkey, o_orderkey, o_totalprice + lead(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pair FROM orders")
def nested_pipe(spark, sf):
    """Any operator over nested tables: here a sliding window within each."""
    window = O.sliding_window(2, lambda s: S((OUTER, "int"), ("o_orderkey", "int"), ("pair", "float")), lambda w: {OUTER: w.row[OUTER], "o_orderkey": w.row["o_orderkey"], "pair": w.sum("o_totalprice")}, by=[OUTER])
    return (_orders_by_customer(spark, sf) | O.nested_pipe("orders", "pairs", window) | O.keep_columns("o_custkey", "pairs") | O.flatten("pairs")).frame()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Event-time windows over files as a stream, taken in one go."""
    folder, out = fresh_path(spark, "stream"), fresh_path(spark, "windows")
    flow(spark, sf, "events", ["ts", "event_type"]).df.repartition(3).write.parquet(folder)
    made = stream.read_stream(spark, folder, S(("ts", "timestamp"), ("event_type", "string")))
    counted = stream.tumbling(made, "ts", "1 hour", "1 hour", ["event_type"], {"n": F.count("*")})
    stream.write_stream(counted, lambda df, batch: df.write.mode("overwrite").parquet(out), fresh_path(spark, "marks"), mode="complete").awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id, value, (SELECT count(*) FROM events WHERE value > 10) AS passed FROM events WHERE value > 10")
def stream_of_rows(spark, sf):
    """Operators without state on a stream, and a fold that is known batch by batch."""
    folder, out = fresh_path(spark, "stream"), fresh_path(spark, "rows")
    flow(spark, sf, "events", ["event_id", "value"]).df.repartition(3).write.parquet(folder)
    count, passed = O.fold(0, lambda t: F.count(F.lit(1)))
    made = stream.read_stream(spark, folder, S(("event_id", "int"), ("value", "float"))) | O.simple_filter(lambda t: t["value"] > 10) | count
    running = stream.write_stream(made, "parquet", fresh_path(spark, "marks"), out)
    running.awaitTermination()
    return spark.read.parquet(out).withColumn("passed", F.lit(sum(passed.batches(running))).cast("bigint"))
