"""Flow: a DataFrame with its schema of defaults, the order that it is known to have, and a way to keep arrival order.

Operators are functions Flow -> Flow, made by the functions of brookline.operators. User logic is given as functions
of a row accessor that return column expressions, and is worked out once, when the plan is made:

    flow.then(simple_filter(lambda t: t["total"] > 100)).then(add_column(("tax", FLOAT), lambda t: t["total"] * 0.2))

Arrival order exists only where a flow says so: by its key's ordering, or by a hidden column that keep_order() adds
right after a read. Operators that depend on arrival order use these, in this order of preference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as types_
from .errors import SchemaError
from .schema import ASC, DESC, GROUPED, UNORDERED, FlowColumn, FlowKey, FlowSchema

POS = "__pos"
#: An arrival number has the partition above this bit, as monotonically_increasing_id makes it.
PART_BITS = 33


def name_col(name: str) -> Column:
    return F.col(f"`{name}`")


class Fields:
    """A row to user functions: row["name"] is the column's expression, row.schema its schema."""

    def __init__(self, schema: FlowSchema, source: Callable[[str], Column] = name_col):
        self.schema, self._source = schema, source

    def __getitem__(self, name: str) -> Column:
        self.schema.require([name])
        return self._source(name)

    def _typed(self, name: str, kind: str) -> Column:
        have = types_.logical(self.schema.column(name).type)
        if have != kind:
            raise SchemaError(f"{name} is {have}, not {kind}")
        return self[name]

    def int(self, name: str) -> Column:
        return self._typed(name, types_.INT)

    def unsigned(self, name: str) -> Column:
        return self._typed(name, types_.UNSIGNED)

    def float(self, name: str) -> Column:
        return self._typed(name, types_.FLOAT)

    def string(self, name: str) -> Column:
        return self._typed(name, types_.STRING)

    def tuples(self, name: str) -> Column:
        return self._typed(name, "nested")

    def try_get(self, name: str) -> Column | None:
        return self._source(name) if self.schema.contains(name) else None

    def struct(self, names: Iterable[str] | None = None) -> Column:
        return F.struct(*[self[n].alias(n) for n in (names or self.schema.names)])


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    schema: FlowSchema
    published: str | None = None

    @classmethod
    def of(cls, df: DataFrame, key: FlowKey | None = None, defaults: dict[str, Any] | None = None, fill: bool = False) -> Flow:
        """A flow of a DataFrame; 32-bit numbers are widened, and fill puts defaults in place of nulls."""
        wide = {f.name: "bigint" for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))}
        wide |= {f.name: "double" for f in df.schema if isinstance(f.dataType, T.FloatType)}
        if wide:
            df = df.withColumns({n: name_col(n).cast(t) for n, t in wide.items()})
        schema = FlowSchema.of(df.schema, key)
        if defaults:
            schema = schema.with_defaults(**defaults)
        flow = cls(df, schema)
        return flow.fill_nulls() if fill else flow

    @classmethod
    def rows(cls, spark: SparkSession, rows: Sequence, schema: FlowSchema) -> Flow:
        """A flow of Python rows, in their order."""
        plain = T.StructType([T.StructField(c.name, c.type) for c in schema.columns])
        return cls(spark.createDataFrame([tuple(r) for r in rows], plain).withColumn(POS, F.monotonically_increasing_id()), schema)

    # order

    @property
    def has_pos(self) -> bool:
        return POS in self.df.columns

    def keep_order(self) -> Flow:
        """Adds the hidden column of arrival order; it means arrival only right after a read."""
        return self if self.has_pos else Flow(self.df.withColumn(POS, F.monotonically_increasing_id()), self.schema, self.published)

    def in_order(self) -> tuple[Flow, list[Column]]:
        """The flow and the columns that give its arrival order."""
        if self.schema.key.orderings and all(d not in (GROUPED, UNORDERED) for d, _ in self.schema.key.orderings):
            more = [name_col(POS)] if self.has_pos else []
            return self, self.schema.key.sort_columns() + ([] if self.schema.key.unique else more)
        flow = self.keep_order()
        return flow, [name_col(POS)]

    def order_terms(self) -> list[tuple[str, str]]:
        """(direction, column) of the order that in_order gives."""
        own = [(d, n) for d, n in self.schema.key.orderings]
        if not own or any(d in (GROUPED, UNORDERED) for d, _ in own):
            return [(ASC, POS)]
        return own + ([] if self.schema.key.unique or not self.has_pos else [(ASC, POS)])

    # building

    def select(self, columns: Iterable[tuple[Column, FlowColumn]], key: FlowKey | None = None) -> Flow:
        """These expressions as these columns; arrival order stays."""
        pairs = list(columns)
        schema = FlowSchema(tuple(c for _, c in pairs), key if key is not None else self.schema.key)
        return self.with_df(self.df.select(*[e.alias(c.name) for e, c in pairs], *([name_col(POS)] if self.has_pos else [])), schema)

    def with_df(self, df: DataFrame, schema: FlowSchema | None = None) -> Flow:
        return Flow(df, schema or self.schema)

    def as_is(self, names: Iterable[str] | None = None) -> list[tuple[Column, FlowColumn]]:
        return [(name_col(c.name), c) for c in map(self.schema.column, names if names is not None else self.schema.names)]

    def fill_nulls(self) -> Flow:
        """Defaults in place of nulls, for columns that have one."""
        new = {c.name: F.coalesce(name_col(c.name), c.literal) for c in self.schema.columns if c.default is not None}
        return self.with_df(self.df.withColumns(new)) if new else self

    @property
    def fields(self) -> Fields:
        return Fields(self.schema)

    def frame(self) -> DataFrame:
        """The visible columns, with defaults and marks in their metadata."""
        return self.df.select(*[name_col(c.name).alias(c.name, metadata=c.field.metadata) for c in self.schema.columns])

    def collect(self) -> list:
        """All rows, in order: for small results and tests."""
        if self.schema.key.orderings or self.has_pos:
            flow, order = self.in_order()
            return flow.df.orderBy(*order).select(*[name_col(n) for n in self.schema.names]).collect()
        return self.frame().collect()

    # composition

    def then(self, op: Callable[[Flow], Flow]) -> Flow:
        return op(self)

    def apply(self, f: Callable[[Flow], Flow]) -> Flow:
        return f(self)

    def chain(self, ops: Iterable[Callable[[Flow], Flow]]) -> Flow:
        return reduce(lambda flow, op: op(flow), ops, self)

    def join_with(self, op: Callable[[Flow, Flow], Flow], right: Flow) -> Flow:
        return op(self, right)

    def multi_join(self, joins: Iterable[tuple[Callable[[Flow, Flow], Flow], Flow]]) -> Flow:
        return reduce(lambda flow, j: j[0](flow, j[1]), joins, self)

    def __or__(self, op: Callable[[Flow], Flow]) -> Flow:
        return op(self)


class LazyFlow(Flow):
    """A flow whose frame is made where an operator asks for it; one that knows what made the flow may plan otherwise."""

    def __init__(self, make: Callable[[], DataFrame], schema: FlowSchema):
        self.__dict__.update(_make=make, schema=schema, published=None)

    @property
    def df(self) -> DataFrame:
        if "_df" not in self.__dict__:
            self.__dict__["_df"] = self._make()
        return self.__dict__["_df"]


__all__ = ["DESC", "PART_BITS", "POS", "Fields", "Flow", "LazyFlow", "name_col"]
