"""Operators on nested tables, as expressions over arrays of structs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import POS, Fields, Flow, LazyFlow, name_col
from ..schema import FlowColumn, FlowKey, FlowSchema
from .columns import as_column
from .grouping import GroupedFlow, array_of, ordered_rows
from .ordering import numbered

Op = Callable[[Flow], Flow]
#: The column by which nested_pipe tells an operator whose inner rows are whose.
OUTER = "outer_row"


class Rows:
    """A nested table to a user function: its array, and the usual aggregates of a field."""

    def __init__(self, array: Column, schema: FlowSchema):
        self.array, self.schema = array, schema

    def field(self, name: str) -> Column:
        """The field's values, an array."""
        self.schema.require([name])
        return F.transform(self.array, lambda x: x[name])

    def count(self) -> Column:
        return F.size(self.array)

    def sum(self, name: str) -> Column:
        zero = F.lit(0).cast(self.schema.column(name).type)
        return F.aggregate(self.field(name), zero, lambda a, x: (a + x).cast(self.schema.column(name).type))

    def avg(self, name: str) -> Column:
        return F.when(self.count() > 0, self.sum(name) / self.count())

    def max(self, name: str) -> Column:
        return F.array_max(self.field(name))

    def min(self, name: str) -> Column:
        return F.array_min(self.field(name))

    def filter(self, f: Callable[[Fields], Column]) -> Rows:
        return Rows(F.filter(self.array, lambda x: f(Fields(self.schema, lambda n: x[n]))), self.schema)

    def map(self, columns: Sequence[tuple[FlowColumn | tuple, Callable[[Fields], Column]]]) -> Rows:
        made = [(as_column(c), f) for c, f in columns]
        of = lambda x: Fields(self.schema, lambda n: x[n])
        return Rows(F.transform(self.array, lambda x: F.struct(*[f(of(x)).cast(c.type).alias(c.name) for c, f in made])), FlowSchema(tuple(c for c, _ in made)))

    def sort(self, *names: str) -> Rows:
        """Ascending and stable."""
        self.schema.require(names)
        keyed = F.transform(self.array, lambda x, i: F.struct(*[x[n].alias(f"k{j}") for j, n in enumerate(names)], i.alias("i"), x.alias("x")))
        return Rows(F.transform(F.array_sort(keyed), lambda y: y["x"]), self.schema)

    def limit(self, skip: int, n: int) -> Rows:
        return Rows(F.slice(self.array, skip + 1, n), self.schema)


class AttachedFlow(LazyFlow):
    """What join_as_column gives: where the column is flattened again, no table is ever nested."""

    def __init__(self, left: Flow, right: Flow, name: str, make: Callable[[AttachedFlow], DataFrame], schema: FlowSchema, most: int):
        super().__init__(lambda: make(self), schema)
        self.__dict__.update(left=left, right=right, name=name, most=most)

    def attached(self, df: DataFrame) -> DataFrame:
        """What stands for the right side, to be broadcast if that side's bytes are few."""
        names = self.right.schema.names
        size = F.sum(F.octet_length(F.to_json(F.struct(*map(name_col, names)))) + 16 * len(names))
        return F.broadcast(df) if (self.right.df.agg(size).first()[0] or 0) <= self.most else df


def rows_of(flow: Flow, name: str) -> Rows:
    return Rows(name_col(name), flow.schema.inner(name))


def flatten(name: str) -> Op:
    """The outer columns without name, then the inner ones, a row for each inner row; empty tables vanish."""

    def run(flow: Flow) -> Flow:
        inner = flow.schema.inner(name)
        outer = flow.schema.drop([name])
        schema = outer.concat(inner)
        if inner.key.singleton:
            key = outer.key
        elif outer.key.unique:
            key = FlowKey(outer.key.orderings + inner.key.orderings)
        else:
            key = outer.key.set_unique(False)
        if isinstance(flow, AttachedFlow) and flow.name == name:
            df = flow.left.df.select(*map(name_col, flow.left.schema.names)).crossJoin(flow.attached(flow.right.df.select(*map(name_col, inner.names))))  # a filter that follows makes it an equi-join
        else:
            df = flow.df.select(*[name_col(n) for n in outer.names], F.inline(name_col(name)))
        return Flow(df.toDF(*schema.names), replace(schema, key=key))

    return run


def add_outer_column(column: FlowColumn | tuple, nested: str, f: Callable[[Rows], Column]) -> Op:
    """One value of a nested table, as a column in front."""
    column = as_column(column)

    def run(flow: Flow) -> Flow:
        FlowSchema((column, *flow.schema.columns))
        if isinstance(flow, GroupedFlow) and flow.nested.name == nested and (fused := flow.with_aggregate(column, f)):
            return fused
        return flow.select([(f(rows_of(flow, nested)).cast(column.type), column), *flow.as_is()])

    return run


def update_nested(name: str, schema_of: Callable[[FlowSchema], FlowSchema], f: Callable[[Fields, Rows], Rows | Column]) -> Op:
    """A nested table by a function of the outer row and it."""

    def run(flow: Flow) -> Flow:
        inner = schema_of(flow.schema.inner(name))
        new = FlowColumn(name, array_of(inner), [])
        made = f(flow.fields, rows_of(flow, name))
        array = made.array if isinstance(made, Rows) else made
        return flow.select([(array.cast(new.type), new) if c.name == name else (name_col(c.name), c) for c in flow.schema.columns], flow.schema.key.drop([name]))

    return run


def add_inner_columns(name: str, schema: FlowSchema, f: Callable[[Fields, Fields], dict[str, Column]]) -> Op:
    """Columns in front of a nested table's, by f(outer row, inner row)."""

    def run(flow: Flow) -> Flow:
        inner = flow.schema.inner(name)
        wide = FlowSchema(schema.columns + inner.columns)

        def made(x):
            new = f(flow.fields, Fields(inner, lambda n: x[n]))
            return F.struct(*[new[c.name].cast(c.type).alias(c.name) for c in schema.columns], *[x[n].alias(n) for n in inner.names])

        return update_nested(name, lambda _: wide, lambda _, rows: F.transform(rows.array, made))(flow)

    return run


def rename_inner_columns(name: str, pairs: dict[str, str] | Sequence[tuple[str, str]]) -> Op:
    new = dict(pairs)

    def run(flow: Flow) -> Flow:
        inner = flow.schema.inner(name)
        renamed = inner.rename({o: n for o, n in new.items() if inner.contains(o)})
        return update_nested(name, lambda _: renamed, lambda _, rows: rows.array)(flow)

    return run


def inner_pipe(source: str, column: str, f: Callable[[Rows], Rows], udf: Callable[[list[dict]], list[dict]] | None = None, schema: FlowSchema | None = None) -> Op:
    """Runs f over each nested table and adds the result as a nested column in front.

    f composes filter, map, sort and limit of Rows. With udf and its schema, a Python function of a list of rows, in
    Arrow batches. nested_pipe runs any operator.
    """

    def run(flow: Flow) -> Flow:
        rows = rows_of(flow, source)
        if udf:
            kind = array_of(schema)
            plain = F.pandas_udf(lambda batch: batch.map(lambda x: json.dumps(udf(json.loads(x or "[]")))), "string")  # nested rows travel as text
            made = F.from_json(plain(F.to_json(rows.array, {"ignoreNullFields": "false"})), kind)
        else:
            done = f(rows)
            made, kind = done.array, array_of(done.schema)
        new = FlowColumn(column, kind, [])
        FlowSchema((new, *flow.schema.columns))
        return flow.select([(made.cast(kind), new), *flow.as_is()])

    return run


def nested_pipe(source: str, column: str, op: Callable[[Flow], Flow]) -> Op:
    """Runs any operator over all rows of a nested table at once and nests what it gives, as a nested column in front.

    Inner rows are laid out with the number of their outer row, so op must work row by row or by groups that it is told
    of: OUTER names the column to group, join or window by. Rows that op drops are gone; an outer row whose inner rows
    all go has an empty table.
    """

    def run(flow: Flow) -> Flow:
        inner = flow.schema.inner(source)
        held = numbered(flow)
        number = FlowColumn(OUTER, T.LongType(), 0)
        rows = held.df.select(name_col(POS).alias(OUTER), F.posexplode(name_col(source)).alias("__at", "__row")).select(OUTER, F.col("__at").cast("bigint").alias(POS), *[F.col("__row")[n].alias(n) for n in inner.names])
        done = op(Flow(rows, FlowSchema((number, *inner.columns), FlowKey())))
        kept = FlowSchema(tuple(c for c in done.schema.columns if c.name != OUTER))
        done.schema.require([OUTER])
        new = FlowColumn(column, array_of(kept), [])
        FlowSchema((new, *flow.schema.columns))
        again, array = ordered_rows(done, kept.names)
        made = again.df.groupBy(OUTER).agg(array.cast(new.type).alias("__made"))
        joined = held.df.join(made, name_col(POS) == made[OUTER], "left").drop(OUTER)
        out = Flow(joined, held.schema)
        return out.select([(F.coalesce(F.col("__made"), F.array().cast(new.type)), new), *out.as_is()])

    return run


def sort_nested_by(name: str, *inner: str) -> Op:
    """Sorts a nested table, ascending and stable."""
    return update_nested(name, lambda s: s, lambda _, rows: rows.sort(*inner))
