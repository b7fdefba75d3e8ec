"""Filters, limits, folds and ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import types as types_
from ..errors import SchemaError
from ..flow import POS, Fields, Flow, name_col
from ..schema import DESC, GROUPED, FlowKey
from .ordering import numbered, parts

Op = Callable[[Flow], Flow]
ACCEPT, DROP, DONE = "accept", "drop", "done"


def simple_filter(f: Callable[[Fields], Column], udf: bool = False) -> Op:
    """Rows for which f holds. With udf, f is a Python function of a row's dictionary, in Arrow batches."""

    def run(flow: Flow) -> Flow:
        if udf:
            names, schema = flow.schema.names, flow.df.schema

            def kept(batches):
                for batch in batches:
                    yield batch[[bool(f(row)) for row in batch[names].to_dict("records")]]

            return flow.with_df(flow.df.mapInPandas(kept, schema))
        return flow.with_df(flow.df.filter(f(flow.fields)))

    return run


def filter_column(name: str, f: Callable[[Column], Column]) -> Op:
    return simple_filter(lambda t: f(t[name]))


def filter_rows(f: Callable[[Fields], Column]) -> Op:
    """f gives ACCEPT, DROP or DONE for a row: at the first DONE in arrival order the flow ends.

    The first DONE is found as one row, then all rows are compared to its place: nothing else is sorted.
    """

    def run(flow: Flow) -> Flow:
        flow = flow if flow.schema.key.unique or flow.has_pos else numbered(flow)
        flow, order = flow.in_order()
        terms = flow.order_terms()
        verdict = f(flow.fields)
        end = flow.df.filter(verdict == DONE).orderBy(*order).select(*[name_col(n) for _, n in terms]).head(1)
        kept = flow.df.filter(verdict == ACCEPT)
        if end:
            kept = kept.filter(precedes(flow.df, terms, end[0]))
        return flow.with_df(kept)

    return run


def precedes(df, terms: list[tuple[str, str]], row) -> Column:
    """Whether a row comes before the given one in the order of terms (direction, column); nulls as Spark sorts them."""
    found = F.lit(False)
    for (direction, name), value in reversed(list(zip(terms, row))):
        x, y = name_col(name), F.lit(value).cast(df.schema[name].dataType)
        if direction == DESC:
            before = x.isNotNull() if value is None else F.coalesce(x > y, F.lit(False))
        else:
            before = F.lit(False) if value is None else F.coalesce(x < y, F.lit(True))
        found = before | (x.eqNullSafe(y) & found)
    return found


def take_while(f: Callable[[Fields], Column]) -> Op:
    """Rows up to the first for which f does not hold."""
    return filter_rows(lambda t: F.when(f(t), ACCEPT).otherwise(DONE))


def downsample(name: str, rate: int, offset: int = 0) -> Op:
    """Rows whose integer column leaves the remainder offset."""

    def run(flow: Flow) -> Flow:
        if types_.logical(flow.schema.column(name).type) not in (types_.INT, types_.UNSIGNED):
            raise SchemaError(f"{name} is not an integer")
        return flow.with_df(flow.df.filter(name_col(name) % rate == offset))

    return run


def limit(skip: int, n: int) -> Op:
    """n rows in arrival order, after skip rows. Spark keeps skip + n rows a task."""

    def run(flow: Flow) -> Flow:
        flow, order = flow.in_order()
        ordered = flow.df.orderBy(*order)
        return flow.with_df((ordered.offset(skip) if skip else ordered).limit(n))

    return run


class Folded:
    """The result of a fold, known after an action on the flow; on a stream, one result for each batch."""

    def __init__(self, start):
        self._start, self._seen, self.name = start, Observation(), f"fold-{uuid.uuid4().hex}"

    @property
    def result(self):
        got = self._seen.get.get("result")
        return self._start if got is None else got

    def batches(self, query: StreamingQuery) -> list:
        """What the batches of a stream gave, as far as it still remembers them; batches without rows are left out."""
        seen = [p["observedMetrics"].get(self.name) if isinstance(p, dict) else p.observedMetrics.get(self.name) for p in query.recentProgress]
        return [r["result"] for r in seen if r is not None and r["result"] is not None]


def fold(start, f: Callable[[Fields], Column]) -> tuple[Op, Folded]:
    """A pass-through operator and the result of an aggregate over all rows that pass."""
    held = Folded(start)

    def run(flow: Flow) -> Flow:
        return flow.with_df(flow.df.observe(held.name if flow.df.isStreaming else held._seen, f(flow.fields).alias("result")))

    return run, held


def column_max(name: str) -> tuple[Op, Folded]:
    """Least int64 if there are no rows."""
    return fold(-(1 << 63), lambda t: F.max(t.int(name)))


def assign_unique_ids(name: str) -> Op:
    """Rows with 0 in the column get the numbers after its maximum, in arrival order.

    Those rows are counted by the partition that they come from, and numbered within it.
    """

    def run(flow: Flow) -> Flow:
        flow.fields.int(name)
        flow = numbered(flow)
        at_zero = name_col(name) == 0
        top = F.coalesce(F.greatest(F.max(name_col(name)), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
        key = FlowKey(((GROUPED, name),), True)
        counts = flow.df.groupBy(parts(flow.df).alias("__part")).agg(F.count(F.when(at_zero, 1)).alias("__n"), top.alias("__top")).collect()  # a row for each partition of the source
        last = max((r["__top"] for r in counts), default=0)
        before = []
        for r in sorted(counts):
            before.append((r["__part"], last))
            last += r["__n"]
        base = flow.df.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
        within = F.row_number().over(W.partitionBy("__part", "__zero").orderBy(POS))
        df = flow.df.withColumns({"__part": parts(flow.df), "__zero": at_zero}).join(F.broadcast(base), "__part", "left")
        made = F.when(name_col("__zero"), within + name_col("__before")).otherwise(name_col(name))
        out = Flow(df.withColumn("__id", made), flow.schema)
        return out.select([(name_col("__id") if c.name == name else name_col(c.name), c) for c in flow.schema.columns], key)

    return run
