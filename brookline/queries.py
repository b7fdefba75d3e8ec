"""Queries over the driver's tables, one or more for each group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from .flow import Flow
from .plans import multi_run, stage
from .schema import DESC, FlowKey, FlowSchema
from .sources import CollectorSink, Tap
from .sources.delimited import parse_lines, rendered

S = FlowSchema.make
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flow(spark: SparkSession, sf: str, name: str, columns: list[str] | None = None, key: FlowKey | None = None) -> Flow:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return Flow.of(df.select(*columns) if columns else df, key)


@query("""SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice * 1.1), 2) AS gross FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment""")
def flagship(spark, sf):
    """Filter, computed column, hash join, aggregate and sort in one plan."""
    customer = flow(spark, sf, "customer", ["c_custkey", "c_mktsegment"], FlowKey.asc("c_custkey", unique=True))
    made = flow(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"]) | O.filter_column("o_orderstatus", lambda x: x == "F") | O.add_column(("gross", "float"), lambda t: t["o_totalprice"] * 1.1)
    joined = made.join_with(O.join(O.SMALL, O.INNER, ["o_custkey"], ["c_custkey"]), customer)
    totals = joined | O.aggregate(["c_mktsegment"], [(("n_orders", "int"), lambda t: F.count("*")), (("gross", "float"), lambda t: F.round(F.sum(t["gross"]), 2))])
    return (totals | O.sort_by_key(FlowKey.asc("c_mktsegment"))).frame()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def simple_filter_keep(spark, sf):
    made = flow(spark, sf, "orders") | O.simple_filter(lambda t: (t.float("o_totalprice") > 200000) & (t.string("o_orderstatus") == "O"))
    return (made | O.keep_columns("o_orderkey", "o_totalprice")).frame()


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def drop_reorder_rename(spark, sf):
    made = flow(spark, sf, "customer") | O.drop_columns("c_name", "c_nationkey") | O.rename_columns([("c_custkey", "id"), ("c_acctbal", "balance"), ("nothing", "x")])
    return (made | O.rename_columns_by(lambda n: n.replace("c_mktsegment", "segment")) | O.reorder_columns_by(lambda s, n: -len(n))).frame()


@query("""SELECT page_id, coalesce(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS domain, coalesce(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS path,
coalesce(regexp_extract(url, '^https?', 0), '') AS scheme FROM pages""")
def add_columns_regex(spark, sf):
    made = flow(spark, sf, "pages", ["page_id", "url"]) | O.add_columns_regex("url", ["domain", "path"], r"^https?://(?<domain>[^/?#]+)(?<path>/[^?#]*)?")
    return (made | O.add_column_regex("url", "scheme", "^https?") | O.drop_columns("url")).frame()


@query("SELECT p_partkey, lower(p_name) AS p_name, trim('  ' || p_brand || ' ') AS padded, p_type AS quoted FROM part")
def clean_text(spark, sf):
    made = flow(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type"]) | O.to_lower("p_name")
    made = made | O.add_columns(S(("padded", "string"), ("quoted", "string")), lambda t: {"padded": F.concat(F.lit(" \t "), t["p_brand"], F.lit(" \n")), "quoted": F.concat(F.lit(' "'), t["p_type"], F.lit('"'))})
    return (made | O.cleanup_input() | O.drop_columns("p_brand", "p_type")).frame()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 3")
def downsample(spark, sf):
    return (flow(spark, sf, "orders", ["o_orderkey", "o_custkey"]) | O.downsample("o_orderkey", 7, 3)).frame()


@query("""SELECT CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS quarter, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
CAST(7 AS BIGINT) AS added FROM lineitem""")
def fill_and_coerce(spark, sf):
    made = flow(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]) | O.update_column("l_quantity", lambda t, x: x / 4) | O.rename_columns({"l_quantity": "quarter"})
    return (made | O.partial_schema_apply(S(("quarter", "int"), ("absent", "int"))) | O.fill_columns(S(("quarter", "int"), ("l_orderkey", "string"), ("l_linenumber", "float"), ("added", "int", 7)))).frame()


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS k, n_name || '!' AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def maps_and_updates(spark, sf):
    made = flow(spark, sf, "nation") | O.update_int_column("n_nationkey", lambda t, x: x + 1) | O.update_string_column("n_name", lambda t, x: F.concat(x, F.lit("!")))
    return (made | O.schema_apply(S(("k", "int"), ("name", "string"), ("region", "string")))).frame()


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, upper(r_name) AS name, length(r_name) AS n FROM region")
def python_maps(spark, sf):
    """The slow path: Python functions of rows, in Arrow batches."""
    made = flow(spark, sf, "region") | O.map_rows(lambda s: S(("k", "int"), ("name", "string")), lambda r: {"k": r["r_regionkey"], "name": r["r_name"].upper()}, udf=True)
    return (made | O.add_column(("n", "int"), lambda r: len(r["name"]), udf=True)).frame()


_LAST = "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
_FIRST = _LAST.replace("DESC", "ASC")


def _customer_orders(spark, sf):
    customer = flow(spark, sf, "customer", ["c_custkey", "c_name"])
    orders = flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True))
    return customer, orders


@query(f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN ({_LAST}) o ON c_custkey = o_custkey")
def join_small_inner(spark, sf):
    a, b = _customer_orders(spark, sf)
    return a.join_with(O.join(O.SMALL, O.INNER, ["c_custkey"], ["o_custkey"]), b).frame()


@query(f"SELECT c_custkey, c_name, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice FROM customer LEFT JOIN ({_LAST}) o ON c_custkey = o_custkey")
def join_small_left(spark, sf):
    a, b = _customer_orders(spark, sf)
    b = b.with_df(b.df, b.schema.with_defaults(o_orderkey=-1))
    return a.join_with(O.join(O.SMALL, O.LEFT, ["c_custkey"], ["o_custkey"]), b).frame()


@query(f"""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(c_name, 'none') AS c_name, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice
FROM (SELECT * FROM customer WHERE c_acctbal > 2000) c FULL JOIN ({_LAST}) o ON c_custkey = o_custkey""")
def join_small_full(spark, sf):
    a, b = _customer_orders(spark, sf)
    a = flow(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal"]) | O.simple_filter(lambda t: t["c_acctbal"] > 2000) | O.drop_columns("c_acctbal")
    a = a.with_df(a.df, a.schema.with_defaults(c_name="none"))
    return a.join_with(O.join(O.SMALL, O.FULL, ["c_custkey"], ["o_custkey"]), b).frame()


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def join_large_inner(spark, sf):
    lines = flow(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    orders = flow(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]) | O.filter_column("o_orderstatus", lambda x: x == "P") | O.drop_columns("o_orderstatus")
    return lines.join_with(O.join(O.LARGE, O.INNER, ["l_orderkey"], ["o_orderkey"]), orders).frame()


@query("""SELECT p_partkey, p_brand, coalesce(l_orderkey, -1) AS l_orderkey, coalesce(l_quantity, 0) AS l_quantity FROM part
LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45 AND l_linenumber = 1) l ON p_partkey = l_partkey""")
def join_large_left(spark, sf):
    lines = flow(spark, sf, "lineitem", ["l_partkey", "l_orderkey", "l_quantity", "l_linenumber"]) | O.simple_filter(lambda t: (t["l_quantity"] > 45) & (t["l_linenumber"] == 1)) | O.drop_columns("l_linenumber")
    lines = lines.with_df(lines.df, lines.schema.with_defaults(l_orderkey=-1))
    return flow(spark, sf, "part", ["p_partkey", "p_brand"]).join_with(O.join(O.LARGE, O.LEFT, ["p_partkey"], ["l_partkey"]), lines).frame()


@query("""SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, coalesce(s_name, '') AS s_name, coalesce(c_name, '') AS c_name FROM supplier FULL JOIN
(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON s_suppkey = c_custkey""")
def join_large_full(spark, sf):
    a = flow(spark, sf, "supplier", ["s_suppkey", "s_name"])
    b = flow(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"]) | O.filter_column("c_mktsegment", lambda x: x == "BUILDING") | O.drop_columns("c_mktsegment")
    return a.join_with(O.join(O.LARGE, O.FULL, ["s_suppkey"], ["c_custkey"]), b).frame()


@query(f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN ({_FIRST}) o ON c_custkey = o_custkey")
def join_ordered_inner(spark, sf):
    a, b = _customer_orders(spark, sf)
    return a.join_with(O.join(O.ORDERED, O.INNER, ["c_custkey"], ["o_custkey"]), b).frame()


@query(f"SELECT c_custkey, c_name, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice FROM customer LEFT JOIN ({_FIRST}) o ON c_custkey = o_custkey")
def join_ordered_left(spark, sf):
    a, b = _customer_orders(spark, sf)
    return a.join_with(O.join(O.ORDERED, O.LEFT, ["c_custkey"], ["o_custkey"]), b).frame()


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderkey, 0) AS o_orderkey, coalesce(b.o_orderkey, 0) AS other
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.k = b.k""")
def join_ordered_full(spark, sf):
    base = flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"], FlowKey.asc("o_orderkey", unique=True))
    part = lambda s: base | O.filter_column("o_orderstatus", lambda x: x == s) | O.drop_columns("o_orderstatus")
    return part("F").join_with(O.join(O.ORDERED, O.FULL, ["o_custkey"], ["o_custkey2"]), part("O") | O.rename_columns({"o_orderkey": "other", "o_custkey": "o_custkey2"})).frame()


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice
FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000) a FULL JOIN (SELECT o_orderkey, -o_totalprice AS o_totalprice FROM orders WHERE o_totalprice > 100000) b ON a.o_orderkey = b.o_orderkey""")
def collate_ordered(spark, sf):
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True))
    b = base | O.simple_filter(lambda t: t["o_totalprice"] > 100000) | O.update_column("o_totalprice", lambda t, x: -x)
    return (base | O.simple_filter(lambda t: t["o_totalprice"] < 300000)).join_with(O.join_collate_ordered(["o_orderkey"]), b).frame()


@query("""SELECT coalesce(a.k, b.k) AS l_partkey, round(coalesce(a.q, 0) + coalesce(b.q, 0), 2) AS l_quantity FROM
(SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN
(SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k""")
def collate_sum(spark, sf):
    base = flow(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_returnflag"])
    part = lambda r: base | O.filter_column("l_returnflag", lambda x: x == r) | O.aggregate(["l_partkey"], [(("l_quantity", "float"), lambda t: F.sum(t["l_quantity"]))])
    return (part("A").join_with(O.join_collate_sum(O.LARGE, ["l_partkey"], "l_quantity"), part("R")) | O.update_column("l_quantity", lambda t, x: F.round(x, 2))).frame()


@query("""WITH a AS (SELECT p_brand, p_size, p_partkey FROM part WHERE p_retailprice < 1000), b AS (SELECT p_brand, p_size, p_partkey FROM part WHERE p_retailprice >= 1000)
SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, p_partkey FROM a UNION ALL SELECT p_brand, CAST(p_size AS BIGINT), p_partkey FROM
(SELECT b.*, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k, (SELECT count(*) FROM a WHERE a.p_brand = b.p_brand AND a.p_size = b.p_size) AS n FROM b) x WHERE k > n""")
def sequence_field_merge(spark, sf):
    """Two nested columns for each brand, merged by part size."""
    base = flow(spark, sf, "part", ["p_brand", "p_size", "p_partkey", "p_retailprice"], FlowKey.asc("p_partkey", unique=True))
    part = lambda dear, n: base | O.simple_filter(lambda t: (t["p_retailprice"] >= 1000) == F.lit(dear)) | O.drop_columns("p_retailprice") | O.group(["p_brand"], n)
    both = part(False, "l").join_with(O.join(O.LARGE, O.FULL, ["p_brand"], ["brand"]), part(True, "r") | O.rename_columns({"p_brand": "brand"}))
    return (both | O.sequence_field_merge(O.ORDERED, ("l", "r", "merged"), ["p_size"]) | O.keep_columns("p_brand", "merged") | O.flatten("merged")).frame()


@query("SELECT r_name, n_name FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey")
def join_as_column_flatten(spark, sf):
    made = flow(spark, sf, "region").join_with(O.join_as_column("nations"), flow(spark, sf, "nation"))
    return (made | O.flatten("nations") | O.simple_filter(lambda t: t["n_regionkey"] == t["r_regionkey"]) | O.keep_columns("r_name", "n_name")).frame()


@query("""SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F' AND l_linenumber = last_f), -1) AS done, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O' AND l_linenumber = last_o), -1) AS open
FROM (SELECT *, max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS last_f, max(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS last_o
FROM (SELECT l_orderkey, l_linestatus, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) x) y GROUP BY l_orderkey""")
def explode_inner(spark, sf):
    """Pivot: the quantity of an order's last line of either status."""
    lines = flow(spark, sf, "lineitem", ["l_orderkey", "l_linestatus", "l_linenumber", "l_quantity"])
    lines = lines | O.aggregate(["l_orderkey", "l_linestatus", "l_linenumber"], [(("l_quantity", "float", -1.0), lambda t: F.max(t["l_quantity"]))]) | O.assume_ordering(FlowKey.asc("l_linenumber", "l_linestatus", "l_orderkey", unique=True))
    names = Flow.rows(spark, [("F", "done"), ("O", "open")], S(("status", "string"), ("name", "string")))
    grouped = lines | O.group(["l_orderkey"], "lines")
    return grouped.join_with(O.explode_inner(("lines", ["l_linestatus"], "l_quantity"), (["status"], "name")), names).frame()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def group_flatten(spark, sf):
    base = flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True))
    return (base | O.group(["o_custkey"], "orders") | O.flatten("orders")).frame()


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS top FROM orders GROUP BY o_custkey")
def group_outer_columns(spark, sf):
    base = flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True))
    made = base | O.group(["o_custkey"], "g") | O.add_outer_column(("n", "int"), "g", lambda r: r.count()) | O.add_outer_column(("total", "float"), "g", lambda r: F.round(r.sum("o_totalprice"), 2))
    return (made | O.add_outer_column(("top", "float"), "g", lambda r: F.round(r.max("o_totalprice"), 2)) | O.drop_columns("g")).frame()


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def aggregate_native(spark, sf):
    base = flow(spark, sf, "lineitem") | O.simple_filter(lambda t: t["l_shipdate"] <= F.lit("1998-09-02").cast("timestamp"))
    revenue = lambda t: F.round(F.sum(t["l_extendedprice"] * (1 - t["l_discount"])), 2)
    return (base | O.aggregate(["l_returnflag", "l_linestatus"], [(("sum_qty", "float"), lambda t: F.round(F.sum(t["l_quantity"]), 2)), (("revenue", "float"), revenue), (("n", "int"), lambda t: F.count("*"))])).frame()


@query("SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def collect_python(spark, sf):
    """A user-defined collector in pandas."""
    import pandas as pd

    finish = lambda key, rows: pd.DataFrame([{"k": key[0], "n": len(rows), "first": rows["n_name"].min()}])
    return (flow(spark, sf, "nation") | O.collect_by(["n_regionkey"], S(("k", "int"), ("n", "int"), ("first", "string")), finish)).frame()


@query("""SELECT o_custkey, o_orderkey AS k, o_totalprice / total AS share FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders) x WHERE o_totalprice > 100000""".replace("o_totalprice / total", "round(o_totalprice / total, 6)"))
def inner_columns_and_pipe(spark, sf):
    """Shares of a customer's total, worked out inside nested tables, then filtered there."""
    base = flow(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"], FlowKey.asc("o_orderkey", unique=True)) | O.group(["o_custkey"], "g")
    made = base | O.add_outer_column(("total", "float"), "g", lambda r: r.sum("o_totalprice")) | O.add_inner_columns("g", S(("share", "float")), lambda o, i: {"share": F.round(i["o_totalprice"] / o["total"], 6)})
    made = made | O.inner_pipe("g", "big", lambda r: r.filter(lambda x: x["o_totalprice"] > 100000)) | O.rename_inner_columns("big", {"o_orderkey": "k"}) | O.sort_nested_by("big", "share", "k")
    return (made | O.keep_columns("o_custkey", "big") | O.flatten("big") | O.drop_columns("o_totalprice")).frame()


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def sliding_window(spark, sf):
    base = flow(spark, sf, "events", ["event_id", "value"], FlowKey.asc("event_id", unique=True))
    return (base | O.sliding_window(5, lambda s: S(("event_id", "int"), ("mean", "float"), ("n", "int")), lambda w: {"event_id": w.row["event_id"], "mean": F.round(w.avg("value"), 6), "n": w.count()})).frame()


@query("""SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS top FROM events""")
def sliding_window_by_user(spark, sf):
    base = flow(spark, sf, "events", ["event_id", "user_id", "value"], FlowKey.asc("event_id", unique=True))
    made = lambda w: {"event_id": w.row["event_id"], "user_id": w.row["user_id"], "top": w.max("value")}
    return (base | O.sliding_window(3, lambda s: S(("event_id", "int"), ("user_id", "int"), ("top", "float")), made, by=["user_id"])).frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def sort_limit(spark, sf):
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return (base | O.sort_by_key(FlowKey(((DESC, "o_totalprice"), ("asc", "o_orderkey")), True)) | O.limit(10, 25)).frame()


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN (SELECT max(o_custkey) FROM orders WHERE o_custkey % 5 <> 0) + row_number() OVER (PARTITION BY o_custkey % 5 = 0 ORDER BY o_orderkey) ELSE o_custkey END AS id FROM orders""")
def assign_unique_ids(spark, sf):
    base = flow(spark, sf, "orders", ["o_orderkey", "o_custkey"]) | O.add_column(("id", "int"), lambda t: F.when(t["o_custkey"] % 5 == 0, 0).otherwise(t["o_custkey"])) | O.drop_columns("o_custkey")
    return (base | O.assign_unique_ids("id")).frame()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice < 20000) AND o_orderstatus <> 'P'")
def filter_until_done(spark, sf):
    base = flow(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"], FlowKey.asc("o_orderkey", unique=True))
    verdict = lambda t: F.when(t["o_totalprice"] < 20000, "done").when(t["o_orderstatus"] == "P", "drop").otherwise("accept")
    return (base | O.filter_rows(verdict) | O.keep_columns("o_orderkey")).frame()


@query("SELECT event_id, event_type FROM events WHERE value >= 0")
def ordering_and_assertions(spark, sf):
    base = flow(spark, sf, "events", ["event_id", "event_type", "value"]) | O.expect_ordering(FlowKey.asc("event_id", unique=True))
    return (base | O.filter_column("value", lambda x: x >= 0) | O.assert_probe(lambda t: t["value"] >= 0, "negative") | O.keep_columns("event_id", "event_type")).frame()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_round_trip(spark, sf):
    """Rows to delimited lines and back, by the splitter's rules."""
    base = flow(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal"])
    lines = rendered(base.keep_order(), ",").select("value", "__pos")
    return parse_lines(lines, ",", S(("c_custkey", "int"), ("c_name", "string"), ("c_acctbal", "float"))).frame()


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM customer WHERE c_acctbal > 0")
def publish_subscribe(spark, sf):
    """One published flow, two stages that read it, two sinks."""
    taps = {"customer": Tap(lambda: flow(spark, sf, "customer", ["c_mktsegment", "c_acctbal"]))}
    count = (("n", "int"), lambda t: F.count("*"))
    published = stage("customer") | O.simple_filter(lambda t: t["c_acctbal"] > 0)
    by = CollectorSink("by"), CollectorSink("all")
    everything = stage("positive") | O.aggregate([], [count]) | O.add_column(("c_mktsegment", "string"), lambda t: F.lit("all"))
    multi_run([(by[0], published % "positive" | O.aggregate(["c_mktsegment"], [count])), (by[1], everything)], taps)
    return by[0].flow.frame().unionByName(by[1].flow.frame())


@query("""WITH RECURSIVE q(board, n) AS (SELECT CAST('' AS VARCHAR), 0 UNION ALL SELECT board || CAST(i AS VARCHAR), n + 1 FROM q, (SELECT unnest(range(1, 7)) AS i) r
WHERE n < 6 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 7)) AS k) s WHERE k <= n AND (CAST(substr(board, k, 1) AS INTEGER) = i OR abs(CAST(substr(board, k, 1) AS INTEGER) - i) = n + 1 - k)))
SELECT board FROM q WHERE n = 6""")
def n_queens_6(spark, sf):
    """Search by nesting all rows beside each board, flattening and filtering."""
    n = 6
    rows = Flow.rows(spark, [(i,) for i in range(1, n + 1)], S(("row", "int")))
    made = Flow.rows(spark, [("",)], S(("board", "string")))
    for k in range(n):
        at = lambda t, j: F.substring(t["board"], j + 1, 1).cast("int")
        safe = lambda t, k=k: reduce(lambda a, b: a & b, [(at(t, j) != t["row"]) & (F.abs(at(t, j) - t["row"]) != k - j) for j in range(k)], F.lit(True))
        made = made.join_with(O.join_as_column("next"), rows) | O.flatten("next") | O.simple_filter(safe)
        made = made | O.update_column("board", lambda t, x: F.concat(x, t["row"].cast("string"))) | O.drop_columns("row")
    return made.frame()


def queries() -> dict[str, Query]:
    from . import queries_io  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
