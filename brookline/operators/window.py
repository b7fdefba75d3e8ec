"""Count-based sliding windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..flow import Fields, Flow, name_col
from ..schema import FlowSchema
from .ordering import indexed

#: Rows that one window task holds at least.
CHUNK = 100_000


class Windowed:
    """The rows of a window to a user function: the current row and those after it."""

    def __init__(self, schema: FlowSchema, over):
        self.row, self._over = Fields(schema), over

    def _agg(self, f, name: str) -> Column:
        return f(self.row[name]).over(self._over)

    def sum(self, name: str) -> Column:
        return self._agg(F.sum, name)

    def avg(self, name: str) -> Column:
        return self._agg(F.avg, name)

    def min(self, name: str) -> Column:
        return self._agg(F.min, name)

    def max(self, name: str) -> Column:
        return self._agg(F.max, name)

    def last(self, name: str) -> Column:
        return self._agg(F.last, name)

    def count(self) -> Column:
        return F.count(F.lit(1)).over(self._over)

    def rows(self) -> Column:
        """All rows of the window, an array of structs."""
        return F.collect_list(self.row.struct()).over(self._over)


def sliding_window(count: int, schema_of: Callable[[FlowSchema], FlowSchema], f: Callable[[Windowed], dict[str, Column]], by: Sequence[str] = (), chunk: int = CHUNK) -> Callable[[Flow], Flow]:
    """A row for each row, made from it and the count - 1 rows after it in arrival order; fewer at the end.

    by: columns whose groups have windows of their own. Without them rows are numbered, dealt out in chunks of
    consecutive numbers, and each chunk borrows the first count - 1 rows of the next, so no task gets all rows.
    """

    def run(flow: Flow) -> Flow:
        schema = schema_of(flow.schema)
        if by:
            held, order = flow.in_order()
            over = W.partitionBy(*map(name_col, by)).orderBy(*order).rowsBetween(0, count - 1)
            made = f(Windowed(flow.schema, over))
            return held.select([(made[c.name].cast(c.type), c) for c in schema.columns], schema.key)
        size = max(chunk, count)
        df = indexed(flow)
        at = F.floor(F.col("__idx") / size)
        borrowed = (F.col("__idx") % size < count - 1) & (at > 0)
        places = F.when(borrowed, F.array(at, at - 1)).otherwise(F.array(at))
        df = df.withColumn("__at", at).withColumn("__chunk", F.explode(places))
        over = W.partitionBy("__chunk").orderBy("__idx").rowsBetween(0, count - 1)
        made = f(Windowed(flow.schema, over))
        out = df.select(*[made[c.name].cast(c.type).alias(c.name) for c in schema.columns], F.col("__idx").alias("__pos"), (F.col("__at") == F.col("__chunk")).alias("__own"))
        return Flow(out.filter("__own").drop("__own"), schema)

    return run
