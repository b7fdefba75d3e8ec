"""Equi-joins with three policies for repeated keys, keyed merges, and joins that make or spread nested tables.

SMALL: of right rows with one key the last in arrival order counts.   LARGE: every pair.   ORDERED: inner and left
joins take the first right row of a key; a full join pairs the k-th left row of a key with its k-th right row.
Missing values are the columns' defaults, and right-only rows carry their key in the left key columns. Spark picks
the physical join by size: no side is broadcast on the word of the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..flow import POS, Fields, Flow, name_col
from ..functions import scalars
from ..schema import FlowColumn, FlowKey, FlowSchema
from .grouping import array_of, ordered_rows
from .nested import AttachedFlow, Rows, rows_of

SMALL, LARGE, ORDERED = "small", "large", "ordered"
INNER, LEFT, FULL = "inner", "left", "full"
Join = Callable[[Flow, Flow], Flow]
#: Columns that a pivot makes at most.
MOST_NAMES = 10_000
#: Bytes of the right side of join_as_column that are sent to every task; more are joined without broadcast.
MOST_ATTACHED = 8 << 20


def _unique_on(flow: Flow, fields: Sequence[str]) -> bool:
    return flow.schema.key.unique and set(flow.schema.key.names) <= set(fields)


def _ranked(flow: Flow, fields: Sequence[str], last: bool) -> DataFrame:
    """One row for each key: the last or first in arrival order."""
    if _unique_on(flow, fields):
        return flow.df.select(*map(name_col, flow.schema.names))
    flow, order = flow.in_order()
    rest = [n for n in flow.schema.names if n not in fields]
    if all(d == "asc" for d, _ in flow.schema.key.orderings) and rest:
        # partial aggregates leave one row for each key and task before the shuffle
        place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_plain_order(flow))])
        picked = (F.max_by if last else F.min_by)(F.struct(*[name_col(n).alias(n) for n in rest]), place)
        df = flow.df.groupBy(*map(name_col, fields)).agg(picked.alias("__row"))
        return df.select(*[name_col(n) if n in fields else F.col("__row")[n].alias(n) for n in flow.schema.names])
    if not rest:
        return flow.df.select(*map(name_col, fields)).distinct().select(*map(name_col, flow.schema.names))
    return _numbered(flow, fields, order, last).filter("__k = 1").select(*map(name_col, flow.schema.names))


def _plain_order(flow: Flow) -> list[Column]:
    key = flow.schema.key
    names = [n for _, n in key.orderings] + ([POS] if flow.has_pos and not key.unique else [])
    return [name_col(n) for n in names or [POS]]


def _numbered(flow: Flow, fields: Sequence[str], order: list[Column], last: bool = False) -> DataFrame:
    if last:
        flipped = [(name_col(n).asc() if d == "desc" else name_col(n).desc()) for d, n in flow.schema.key.orderings]
        order = flipped + ([name_col(POS).desc()] if flow.has_pos else [])
    return flow.df.withColumn("__k", F.row_number().over(W.partitionBy(*map(name_col, fields)).orderBy(*order)))


def _sides(size: str, direction: str, left: Flow, right: Flow, lf: Sequence[str], rf: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, ready to be matched, and extra columns to match on."""
    keep = [POS] if left.has_pos and direction != FULL else []
    own = lambda df, names: df.select(*map(name_col, names))
    if size == LARGE:
        return own(left.df, left.schema.names + keep), own(right.df, right.schema.names), []
    if size == ORDERED and direction == FULL:
        a, ao = left.in_order()
        b, bo = right.in_order()
        return own(_numbered(a, lf, ao), [*left.schema.names, "__k"]), own(_numbered(b, rf, bo), [*right.schema.names, "__k"]), ["__k"]
    return own(left.df, left.schema.names + keep), _ranked(right, rf, last=size == SMALL), []


def _result_key(size: str, direction: str, left: Flow, right: Flow, lf: Sequence[str], rf: Sequence[str]) -> FlowKey:
    key = left.schema.key
    if size == LARGE:
        return FlowKey()
    if direction == INNER:
        return key
    if direction == LEFT:
        return key if _unique_on(right, rf) else key.set_unique(False)
    both = _unique_on(left, lf) and _unique_on(right, rf)
    if size == ORDERED:
        return key.subset(lf).set_unique(both) if key.orderings else FlowKey((), False)
    return FlowKey()


def _check(size: str, direction: str, left: Flow, right: Flow, lf: Sequence[str], rf: Sequence[str]) -> None:
    if size not in (SMALL, LARGE, ORDERED) or direction not in (INNER, LEFT, FULL):
        raise SchemaError(f"no join {size}, {direction}")
    if len(lf) != len(rf) or not lf:
        raise SchemaError("as many left as right fields are needed, and at least one")
    for a, b in zip(lf, rf):
        if left.schema.column(a).type != right.schema.column(b).type:
            raise SchemaError(f"{a} and {b} differ in type")


def _matched(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], direction: str) -> tuple[DataFrame, Column, Column]:
    """Rows of structs __l and __r, and whether either is there."""
    l_ = left.select(F.struct(*map(name_col, left.columns)).alias("__l"), *[name_col(a).alias(f"__lk{i}") for i, (a, _) in enumerate(pairs)], F.lit(True).alias("__inl"))
    r_ = right.select(F.struct(*map(name_col, right.columns)).alias("__r"), *[name_col(b).alias(f"__rk{i}") for i, (_, b) in enumerate(pairs)], F.lit(True).alias("__inr"))
    on = reduce(lambda a, b: a & b, [F.col(f"__lk{i}") == F.col(f"__rk{i}") for i in range(len(pairs))])
    return l_.join(r_, on, direction), F.col("__inl").isNotNull(), F.col("__inr").isNotNull()


def join(size: str, direction: str, left_fields: Sequence[str], right_fields: Sequence[str]) -> Join:
    """The left columns, then the right ones without its key columns."""
    lf, rf = list(left_fields), list(right_fields)

    def run(left: Flow, right: Flow) -> Flow:
        _check(size, direction, left, right, lf, rf)
        rest = right.schema.drop(rf)
        schema = FlowSchema(left.schema.columns + rest.columns)
        a, b, extra = _sides(size, direction, left, right, lf, rf)
        df, in_left, in_right = _matched(a, b, [*zip(lf, rf), *((x, x) for x in extra)], direction)
        of_right = dict(zip(lf, rf))

        def left_value(c: FlowColumn) -> Column:
            value = F.col("__l")[c.name]
            if direction != FULL:
                return value
            return F.when(in_left, value).otherwise(F.col("__r")[of_right[c.name]] if c.name in of_right else c.literal)

        right_value = lambda c: F.col("__r")[c.name] if direction == INNER else F.when(in_right, F.col("__r")[c.name]).otherwise(c.literal)
        columns = [left_value(c).alias(c.name) for c in left.schema.columns] + [right_value(c).alias(c.name) for c in rest.columns]
        pos = [F.col("__l")[POS].alias(POS)] if POS in a.columns else []
        return Flow(df.select(*columns, *pos), schema.with_key(_result_key(size, direction, left, right, lf, rf)))

    return run


def multi_join(joins: Sequence[tuple[Join, Flow]]) -> Callable[[Flow], Flow]:
    return lambda left: left.multi_join(joins)


def join_collate(size: str, fields: Sequence[str], merge: Callable[[FlowSchema, Fields, Fields], dict[str, Column]]) -> Join:
    """Two flows of one schema: rows without a match pass, matches become merge(schema, left row, right row)."""
    fields = list(fields)

    def run(left: Flow, right: Flow) -> Flow:
        if left.schema.simple != right.schema.simple:
            raise SchemaError("the two sides differ in schema")
        _check(size, FULL, left, right, fields, fields)
        a, b, extra = _sides(size, FULL, left, right, fields, fields)
        df, in_left, in_right = _matched(a, b, [(x, x) for x in [*fields, *extra]], FULL)
        made = merge(left.schema, Fields(left.schema, lambda n: F.col("__l")[n]), Fields(right.schema, lambda n: F.col("__r")[n]))
        value = lambda c: F.when(in_left & in_right, made[c.name].cast(c.type)).when(in_left, F.col("__l")[c.name]).otherwise(F.col("__r")[c.name])
        key = left.schema.key.least_restrictive(right.schema.key)
        if not (_unique_on(left, fields) and _unique_on(right, fields)):
            key = key.set_unique(False)
        return Flow(df.select(*[value(c).alias(c.name) for c in left.schema.columns]), left.schema.with_key(key))

    return run


def join_collate_ordered(fields: Sequence[str], size: str = ORDERED) -> Join:
    """A keyed union in which the left row wins."""
    return join_collate(size, fields, lambda schema, a, b: {n: a[n] for n in schema.names})


def join_collate_sum(size: str, fields: Sequence[str], added: str) -> Join:
    """A keyed union; of a match the left row stays, with the sum of both sides' added column."""

    def merge(schema: FlowSchema, a: Fields, b: Fields) -> dict[str, Column]:
        c = schema.column(added)
        return {n: scalars.add(a[n], b[n], c, c) if n == added else a[n] for n in schema.names}

    return join_collate(size, fields, merge)


def join_collate_ordered_rows(left: Flow, right: Flow, fields: Sequence[str]) -> Flow:
    return join_collate_ordered(fields)(left, right)


def sequence_field_merge(size: str, columns: tuple[str, str, str], fields: Sequence[str]) -> Callable[[Flow], Flow]:
    """(left, right, out): two nested columns merged by key into a third in front, sorted by key; the left row wins.

    ORDERED pairs repeated keys in order; SMALL lets the last right row of a key stand for all.
    """
    left_name, right_name, out_name = columns
    if size not in (SMALL, ORDERED):
        raise SchemaError("nested columns are merged by SMALL or ORDERED")

    def run(flow: Flow) -> Flow:
        a, b = rows_of(flow, left_name), rows_of(flow, right_name)
        if a.schema.simple != b.schema.simple:
            raise SchemaError("the two nested columns differ in schema")
        kind = array_of(a.schema)
        same = lambda x, y: reduce(lambda p, q: p & q, [x[n].eqNullSafe(y[n]) for n in fields])
        count = lambda array, y: F.size(F.filter(array, lambda x: same(x, y)))
        right = b.array.cast(kind)
        if size == ORDERED:
            rest = F.filter(right, lambda y, i: count(a.array, y) < count(F.slice(right, 1, i + 1), y))
        else:
            later = lambda y, i: count(F.slice(right, i + 2, F.size(right)), y) > 0
            rest = F.filter(right, lambda y, i: (count(a.array, y) == 0) & ~later(y, i))
        merged = Rows(F.concat(a.array.cast(kind), rest), a.schema).sort(*fields).array
        new = FlowColumn(out_name, kind, [])
        FlowSchema((new, *flow.schema.columns))
        return flow.select([(merged.cast(kind), new), *flow.as_is()])

    return run


def join_as_column(name: str, most_attached: int = MOST_ATTACHED) -> Join:
    """The whole right flow as a nested column in front of each left row, rows in arrival order.

    The right side becomes one row, whose bytes are checked: up to most_attached it is broadcast. Where flatten
    follows, nothing is nested, and a filter after it makes the two an equi-join.
    """

    def run(left: Flow, right: Flow) -> Flow:
        nested = FlowColumn(name, array_of(right.schema), [])
        schema = FlowSchema((nested, *left.schema.columns), left.schema.key)

        def make(flow: AttachedFlow) -> DataFrame:
            held, rows = ordered_rows(right, right.schema.names)
            df = left.df.crossJoin(flow.attached(held.df.agg(rows.cast(nested.type).alias(name))))
            return df.select(*map(name_col, schema.names), *([POS] if left.has_pos else []))

        return AttachedFlow(left, right, name, make, schema, most_attached)

    return run


def explode_inner(inner: tuple[str, Sequence[str], str], right: tuple[Sequence[str], str], most_names: int = MOST_NAMES) -> Join:
    """(nested column, its key fields, its value field) and (key fields, name field) of the right flow.

    The nested column gives way to one column for each right row, in right order: the value of the inner row of its
    key, the last if several, or the value column's default. An inner key that the right side lacks fails the job;
    a repeated right key, or over most_names names, is refused.
    """
    (nested, inner_fields, value), (right_fields, name_field) = inner, right

    def run(left: Flow, names_flow: Flow) -> Flow:
        column = left.schema.inner(nested).column(value)
        if names_flow.df.limit(most_names + 1).count() > most_names:
            raise SchemaError(f"over {most_names} columns")
        found = names_flow.collect()
        keys = [tuple(r[f] for f in right_fields) for r in found]
        if len(set(keys)) != len(keys):
            raise SchemaError("the right side repeats a key")
        rows = rows_of(left, nested)
        kinds = [names_flow.schema.column(f).type for f in right_fields]
        lit = lambda k: [F.lit(v).cast(t) for v, t in zip(k, kinds)]
        match = lambda x, k: reduce(lambda p, q: p & q, [x[f] == v for f, v in zip(inner_fields, lit(k))])
        hit = lambda k: lambda x: match(x, k)
        known = lambda x: reduce(lambda p, q: p | q, [match(x, k) for k in keys], F.lit(False))
        checked = F.when(F.forall(rows.array, known), rows.array).otherwise(F.raise_error(F.lit(f"{nested} has a key that no name is known for")))
        held = left.with_df(left.df.withColumn("__rows", checked))
        outer = left.schema.drop([nested])
        made = []
        for r, k in zip(found, keys):
            hits = F.filter(F.col("__rows"), hit(k))
            got = F.element_at(hits, -1)[value]
            made.append((F.when(F.size(hits) > 0, got).otherwise(column.literal), FlowColumn(str(r[name_field]), column.type, column.default)))
        FlowSchema((*outer.columns, *[c for _, c in made]))
        return held.select([*held.as_is(outer.names), *made], outer.key)

    return run


def sequential_merge(prepare: Callable[[Flow], object], merge: Callable[[object, Flow], Flow]) -> Join:
    """A user-defined join: prepare sees the whole right flow first, merge then gets its result and the left flow."""
    return lambda left, right: merge(prepare(right), left)
