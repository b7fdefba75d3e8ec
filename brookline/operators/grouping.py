"""Groups as nested tables, native aggregates, and user-defined collectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..flow import POS, Fields, Flow, LazyFlow, name_col
from ..schema import DESC, FlowColumn, FlowKey, FlowSchema

Op = Callable[[Flow], Flow]


def array_of(schema: FlowSchema) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c.name, c.type, True, c.field.metadata) for c in schema.columns]), True)


def ordered_rows(flow: Flow, names: Sequence[str]) -> tuple[Flow, Column]:
    """An aggregate: the rows (these columns) of a group as an array in arrival order."""
    flow, _ = flow.in_order()
    key = flow.schema.key
    terms = list(key.orderings) if key.orderings and (key.unique or not flow.has_pos) else [*key.orderings, ("asc", POS)]
    terms = [(d, n) for d, n in terms if d in ("asc", DESC)]
    if not any(n == POS for _, n in terms) and not key.orderings:
        terms = [("asc", POS)]
    row = F.struct(*[name_col(n).alias(n) for n in names])
    held = F.struct(*[name_col(n).alias(f"o{i}") for i, (_, n) in enumerate(terms)], row.alias("row"))
    if all(d == "asc" for d, _ in terms):
        found = F.array_sort(F.collect_list(held))
    else:

        def compare(a, b):
            out = F.lit(0)
            for i, (d, _) in reversed(list(enumerate(terms))):
                x, y = (a[f"o{i}"], b[f"o{i}"]) if d == "asc" else (b[f"o{i}"], a[f"o{i}"])
                out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
            return out

        found = F.array_sort(F.collect_list(held), compare)
    return flow, F.transform(found, lambda x: x["row"])


class NotNativeError(Exception):
    """A function of a nested table asks for more than aggregates."""


class Aggregates:
    """A nested table to a user function as long as only aggregates are asked for, over the rows before they are nested."""

    def __init__(self, schema: FlowSchema):
        self.schema = schema

    def __getattr__(self, name: str):
        raise NotNativeError(name)

    def _of(self, name: str) -> Column:
        self.schema.require([name])
        return name_col(name)

    def count(self) -> Column:
        return F.count(F.lit(1))

    def sum(self, name: str) -> Column:
        return F.sum(self._of(name)).cast(self.schema.column(name).type)

    def avg(self, name: str) -> Column:
        return self.sum(name) / self.count()

    def max(self, name: str) -> Column:
        return F.max(self._of(name))

    def min(self, name: str) -> Column:
        return F.min(self._of(name))


class GroupedFlow(LazyFlow):
    """What group gives, and aggregates of the nested column that were added to it.

    Where the nested column is dropped again, the plan is one aggregate with partial sums, and no table is ever nested.
    """

    def __init__(self, source: Flow, keys: Sequence[str], nested: FlowColumn, make: Callable[[], DataFrame], schema: FlowSchema, added: tuple = ()):
        super().__init__(make, schema)
        self.__dict__.update(source=source, keys=list(keys), nested=nested, added=added)

    def with_aggregate(self, column: FlowColumn, f: Callable) -> GroupedFlow | None:
        """The flow with f's value in front; None if f needs the rows themselves."""
        try:
            value = f(Aggregates(self.schema.inner(self.nested.name)))
        except NotNativeError:
            return None
        if not isinstance(value, Column):
            return None
        schema = FlowSchema((column, *self.schema.columns), self.schema.key)

        def make() -> DataFrame:
            from .nested import rows_of

            whole = f(rows_of(self, self.nested.name)).cast(column.type).alias(column.name)
            return self.df.select(whole, *map(name_col, self.schema.names))

        return GroupedFlow(self.source, self.keys, self.nested, make, schema, (*self.added, (column, value)))

    def without(self, schema: FlowSchema) -> Flow:
        """The flow with this schema, which lacks the nested column."""
        by = [name_col(k) for k in self.keys] or [F.lit(0).alias("__one")]
        made = [value.cast(c.type).alias(c.name) for c, value in self.added if schema.contains(c.name)] or [F.count(F.lit(1)).alias("__count")]
        return Flow(self.source.df.groupBy(*by).agg(*made).select(*map(name_col, schema.names)), schema)


def group(keys: Sequence[str], name: str) -> Op:
    """keys and a nested column of the other columns, rows in arrival order; no keys: one group, none of no rows."""

    def run(flow: Flow) -> Flow:
        flow.schema.require(keys)
        others = [n for n in flow.schema.names if n not in keys]
        inner = flow.schema.pick(others)
        nested = FlowColumn(name, array_of(inner), [])
        schema = FlowSchema((*map(flow.schema.column, keys), nested), FlowKey.asc(*keys, unique=True))

        def make() -> DataFrame:
            held, rows = ordered_rows(flow, others)
            by = [name_col(k) for k in keys] or [F.lit(0).alias("__one")]
            return held.df.groupBy(*by).agg(rows.cast(nested.type).alias(name)).select(*[name_col(n) for n in schema.names])

        return GroupedFlow(flow, keys, nested, make, schema)

    return run


def aggregate(keys: Sequence[str], columns: Iterable[tuple[FlowColumn | tuple, Callable[[Fields], Column]]]) -> Op:
    """keys and native aggregates: what group, add_outer_column and drop_columns give, without nested tables."""

    def run(flow: Flow) -> Flow:
        made = [(c if isinstance(c, FlowColumn) else FlowColumn.make(*c), f) for c, f in columns]
        schema = FlowSchema((*map(flow.schema.column, keys), *[c for c, _ in made]), FlowKey.asc(*keys, unique=True))
        by = [name_col(k) for k in keys] or [F.lit(0).alias("__one")]
        df = flow.df.groupBy(*by).agg(*[f(flow.fields).cast(c.type).alias(c.name) for c, f in made])
        return Flow(df.select(*[name_col(n) for n in schema.names]), schema)

    return run


def collect_by(keys: Sequence[str], schema: FlowSchema, finish: Callable, prepare: Callable[[Flow], Flow] | None = None) -> Op:
    """A user-defined collector: finish(key, rows as a pandas frame in arrival order) gives a frame of the schema.

    Each group is one pandas frame in a worker, so a group must fit its memory; use aggregate where it may not.
    """

    def run(flow: Flow) -> Flow:
        held, _ = (prepare(flow) if prepare else flow).keep_order().in_order()
        names = held.schema.names
        by = [name_col(k) for k in keys] or [F.lit(0)]
        key = held.schema.key
        terms = [(n, d != DESC) for d, n in key.orderings if d in ("asc", DESC)] + [(POS, True)]

        def of_group(group_key, frame):
            frame = frame.sort_values([n for n, _ in terms], ascending=[a for _, a in terms], kind="stable")
            return finish(group_key, frame[names].reset_index(drop=True))

        struct = T.StructType([T.StructField(c.name, c.type) for c in schema.columns])
        return Flow(held.df.groupBy(*by).applyInPandas(of_group, struct), schema)

    return run
