"""Projections and edits of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from enum import IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as types_
from ..errors import SchemaError
from ..flow import POS, Fields, Flow, name_col
from ..functions import scalars
from ..schema import FlowColumn, FlowKey, FlowSchema
from .grouping import GroupedFlow

Op = Callable[[Flow], Flow]


def as_column(column: FlowColumn | tuple) -> FlowColumn:
    return column if isinstance(column, FlowColumn) else FlowColumn.make(*column)


def python_rows(flow: Flow, f: Callable[[dict], dict], schema: FlowSchema) -> Flow:
    """The slow path: a Python function of a row's dictionary, in Arrow batches."""
    pos = [POS] if flow.has_pos else []
    names, struct = schema.names, T.StructType([T.StructField(c.name, c.type) for c in schema.columns] + ([T.StructField(POS, T.LongType())] if pos else []))

    def run(batches):
        import pandas as pd

        for batch in batches:
            made = [f(row) for row in batch.to_dict("records")]
            out = {n: [m[n] for m in made] for n in names}
            yield pd.DataFrame(out | ({POS: batch[POS].tolist()} if pos else {}))

    return flow.with_df(flow.df.mapInPandas(run, struct), schema)


def map_rows(schema_of: Callable[[FlowSchema], FlowSchema], f: Callable, key_of: Callable[[FlowKey], FlowKey] = lambda k: FlowKey(), udf: bool = False) -> Op:
    """f(row) gives the new row: name -> expression, or with udf a Python function of a row's dictionary.

    key_of says what is known of the result's order, from what was known.
    """

    def run(flow: Flow) -> Flow:
        schema = schema_of(flow.schema)
        key = key_of(flow.schema.key)
        if udf:
            return python_rows(flow, f, replace(schema, key=key))
        made = f(flow.fields)
        if set(made) != set(schema.names):
            raise SchemaError(f"the function made {sorted(made)}, not {sorted(schema.names)}")
        return flow.select([(made[c.name].cast(c.type), c) for c in schema.columns], key)

    return run


def fast_map(schema_of: Callable[[FlowSchema], FlowSchema], f: Callable[[FlowSchema, Fields], dict[str, Column]]) -> Op:
    """As map_rows, with the result's schema handed to f; the key is the one that schema_of gives."""

    def run(flow: Flow) -> Flow:
        schema = schema_of(flow.schema)
        made = f(schema, flow.fields)
        return flow.select([(made[c.name].cast(c.type), c) for c in schema.columns], schema.key)

    return run


def simple_map(schema_of: Callable[[FlowSchema], FlowSchema], f: Callable, udf: bool = False) -> Op:
    """A map after which the order is known as before."""
    return map_rows(schema_of, f, lambda k: k, udf)


def map_add(column_of: Callable[[FlowSchema], FlowColumn], f: Callable[[Fields], Column]) -> Op:
    """A computed column in front, its type a function of the schema."""

    def run(flow: Flow) -> Flow:
        column = column_of(flow.schema)
        FlowSchema((column, *flow.schema.columns))
        return flow.select([(f(flow.fields).cast(column.type), column), *flow.as_is()])

    return run


def add_column(column: FlowColumn | tuple, f: Callable[[Fields], Column], udf: bool = False) -> Op:
    """A computed column in front. With udf, f is a Python function of a row's dictionary."""
    column = as_column(column)
    if udf:
        return lambda flow: python_rows(flow, lambda row: {**row, column.name: f(row)}, flow.schema.add(column))
    return map_add(lambda _: column, f)


def simple_map_add(column: FlowColumn | tuple, f: Callable[[Fields], Column]) -> Op:
    return add_column(column, f)


def add_columns(schema: FlowSchema, f: Callable[[Fields], dict[str, Column]]) -> Op:
    """Computed columns at the end."""

    def run(flow: Flow) -> Flow:
        made = f(flow.fields)
        FlowSchema(flow.schema.columns + schema.columns)
        return flow.select([*flow.as_is(), *((made[c.name].cast(c.type), c) for c in schema.columns)])

    return run


def identity(flow: Flow) -> Flow:
    return flow


def add_columns_regex(source: str, names: Sequence[str], pattern: str) -> Op:
    """String columns in front, of the first match's named groups; empty where there's no match or group."""
    plain, groups = scalars.group_indexes(pattern)

    def run(flow: Flow) -> Flow:
        text = flow.fields.string(source)
        new = [(F.regexp_extract(text, plain, groups[n]) if n in groups else F.lit(""), FlowColumn.make(n, types_.STRING)) for n in names]
        FlowSchema((*[c for _, c in new], *flow.schema.columns))
        return flow.select([*new, *flow.as_is()])

    return run


def add_column_regex(source: str, name: str, pattern: str) -> Op:
    """A string column in front: the whole first match, or empty."""
    plain, _ = scalars.group_indexes(pattern)
    return add_column((name, types_.STRING), lambda t: F.regexp_extract(t.string(source), plain, 0))


def drop_columns(*names: str) -> Op:
    def run(flow: Flow) -> Flow:
        schema = flow.schema.drop(names)
        if isinstance(flow, GroupedFlow) and not schema.contains(flow.nested.name):
            return flow.without(schema)
        return flow.select(flow.as_is(schema.names), schema.key)

    return run


def keep_columns(*names: str) -> Op:
    """The flow's order of columns stays."""

    def run(flow: Flow) -> Flow:
        schema = flow.schema.keep(names)
        if isinstance(flow, GroupedFlow) and not schema.contains(flow.nested.name):
            return flow.without(schema)
        return flow.select(flow.as_is(schema.names), schema.key)

    return run


def reorder_columns_by(rank: Callable[[FlowSchema, str], int]) -> Op:
    """Columns sorted, stably, by rank(schema, name)."""
    return lambda flow: flow.select(flow.as_is(sorted(flow.schema.names, key=lambda n: rank(flow.schema, n))))


def rename_columns(pairs: Iterable[tuple[str, str]] | dict[str, str]) -> Op:
    """Unknown old names are ignored."""
    new = dict(pairs)

    def run(flow: Flow) -> Flow:
        schema = flow.schema.rename({o: n for o, n in new.items() if flow.schema.contains(o)})
        return flow.select([(name_col(o), c) for o, c in zip(flow.schema.names, schema.columns)], schema.key)

    return run


def rename_columns_by(f: Callable[[str], str]) -> Op:
    return lambda flow: rename_columns({n: f(n) for n in flow.schema.names})(flow)


def fill_columns(schema: FlowSchema) -> Op:
    """Exactly these columns: those of a known name are coerced, others get their default, and the rest goes."""

    def run(flow: Flow) -> Flow:
        def value(c: FlowColumn) -> Column:
            return types_.coerce(name_col(c.name), flow.schema.column(c.name).type, c.type) if flow.schema.contains(c.name) else c.literal

        return flow.select([(value(c), c) for c in schema.columns], schema.key)

    return run


def schema_apply(schema: FlowSchema) -> Op:
    """Renames and coerces by position; the number of columns must agree."""

    def run(flow: Flow) -> Flow:
        if len(schema.columns) != len(flow.schema.columns):
            raise SchemaError(f"{len(flow.schema.columns)} columns for {len(schema.columns)}")
        pairs = zip(flow.schema.columns, schema.columns)
        return flow.select([(types_.coerce(name_col(o.name), o.type, c.type), c) for o, c in pairs], schema.key)

    return run


def partial_schema_apply(schema: FlowSchema) -> Op:
    """Coerces the columns that schema names; names that the flow doesn't have are ignored."""
    new = {c.name: c for c in schema.columns}

    def run(flow: Flow) -> Flow:
        return flow.select([(types_.coerce(name_col(c.name), c.type, new[c.name].type), new[c.name]) if c.name in new else (name_col(c.name), c) for c in flow.schema.columns])

    return run


partial_schema_apply_if_exists = partial_schema_apply


def update_column(name: str, f: Callable[[Fields, Column], Column]) -> Op:
    """f(row, value) in place of a value; the column is no longer known to be in order."""

    def run(flow: Flow) -> Flow:
        column = flow.schema.column(name)
        return flow.select([(f(flow.fields, name_col(name)).cast(column.type), c) if c.name == name else (name_col(c.name), c) for c in flow.schema.columns], flow.schema.key.drop([name]))

    return run


def _typed_update(kind: str, name: str, f: Callable[[Fields, Column], Column]) -> Op:
    def run(flow: Flow) -> Flow:
        flow.fields._typed(name, kind)
        return update_column(name, f)(flow)

    return run


def update_int_column(name: str, f: Callable[[Fields, Column], Column]) -> Op:
    return _typed_update(types_.INT, name, f)


def update_string_column(name: str, f: Callable[[Fields, Column], Column]) -> Op:
    return _typed_update(types_.STRING, name, f)


def to_lower(*names: str) -> Op:
    return lambda flow: flow.chain(update_string_column(n, lambda _, x: F.lower(x)) for n in names)


def _on_strings(f: Callable[[Column], Column]) -> Op:
    def run(flow: Flow) -> Flow:
        return flow.select([(f(name_col(c.name)) if isinstance(c.type, T.StringType) else name_col(c.name), c) for c in flow.schema.columns])

    return run


trim_whitespace = _on_strings(scalars.trim_whitespace)
strip_quotes = _on_strings(scalars.strip_quotes)


class Cleanup(IntFlag):
    NONE = 0
    TRIM = 1
    STRIP_QUOTES = 2
    ALL = 0xFF


def cleanup_input(flags: Cleanup = Cleanup.ALL) -> Op:
    """Trims, then strips quotes, as the flags say."""
    ops = [op for flag, op in ((Cleanup.TRIM, trim_whitespace), (Cleanup.STRIP_QUOTES, strip_quotes)) if flags & flag]
    return lambda flow: flow.chain(ops)


def line_splitter(separator: str, n: int) -> Op:
    """The first column, a line, as columns $0, $1 ...; missing fields are empty, and more fields than n are an error."""

    def run(flow: Flow) -> Flow:
        first = flow.schema.names[0]
        names = [f"${i}" for i in range(n)]
        parts = scalars.split_delimited(flow.fields.string(first), separator)
        checked = F.when(F.size(parts) > n, F.raise_error(F.concat(F.lit(f"more than {n} fields: "), name_col(first)))).otherwise(parts)
        df = flow.df.withColumn("__parts", checked)
        at = Flow(df, flow.schema)
        return at.select([(F.coalesce(F.get("__parts", F.lit(i)), F.lit("")), FlowColumn.make(x, types_.STRING)) for i, x in enumerate(names)], FlowKey())

    return run


def split_line_on_comma(n: int) -> Op:
    return line_splitter(",", n)


def split_line_on_tab(n: int) -> Op:
    return line_splitter("\t", n)
