"""Orders that are made, assumed or checked, and dense row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import OrderingError
from ..flow import PART_BITS, POS, Flow, name_col
from ..functions import scalars
from ..schema import ASC, DESC, FlowKey
from ..staging import staged

Op = Callable[[Flow], Flow]


def sort_by_key(key: FlowKey) -> Op:
    """Sorts as the key says, both directions honoured; nothing is done where the order is known already."""

    def run(flow: Flow) -> Flow:
        flow.schema.require(key.names)
        if flow.schema.key.satisfies(key):
            return flow
        return flow.with_df(flow.df.orderBy(*key.sort_columns()), flow.schema.with_key(key))

    return run


def assume_ordering(key: FlowKey) -> Op:
    """The key is taken as given."""
    return lambda flow: flow.with_df(flow.df, flow.schema.with_key(key))


def parts(df: DataFrame) -> Column:
    return F.shiftright(name_col(POS), PART_BITS)


def numbered(flow: Flow) -> Flow:
    """The flow with arrival numbers that say its order and stay the same over several jobs.

    Rows of a scan keep the numbers that they got when read. Where a key gives the order, or rows without numbers come
    out of a shuffle, the rows are sorted and staged.
    """
    if any(d in (ASC, DESC) for d, _ in flow.schema.key.orderings) and all(d in (ASC, DESC) for d, _ in flow.schema.key.orderings):
        flow, order = flow.in_order()
        df = flow.df.orderBy(*order)
    elif flow.has_pos:
        return flow
    else:
        df = flow.df
        if "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
            return flow.keep_order()
    return flow.with_df(staged(df.drop(POS).withColumn(POS, F.monotonically_increasing_id()), "ordered"))


def indexed(flow: Flow) -> DataFrame:
    """The flow's rows with __idx, their place in arrival order from 0: rows are numbered within the partition that they come from, after those before it."""
    df = numbered(flow).df
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in df.groupBy(parts(df).alias("p")).count().collect()):  # a row for each partition
        before.append((part, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(before, "__part bigint, __before bigint"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(POS))
    placed = df.withColumn("__part", parts(df)).join(base, "__part").withColumn("__idx", within - 1 + name_col("__before"))
    return placed.drop("__part", "__before")


def _violates(key: FlowKey, flow: Flow, before: Callable[[str], Column], now: Callable[[str], Column]) -> Column:
    bad = F.lit(key.unique and bool(key.orderings))
    for k, (direction, name) in reversed(list(enumerate(key.orderings))):
        kind = flow.schema.column(name).type
        a, b = before(name), now(name)
        if direction == DESC:
            a, b = b, a
        if direction in (ASC, DESC):
            bad = F.when(scalars.less(b, a, kind), True).when(scalars.equal(a, b), bad).otherwise(False)
    return bad


def expect_ordering(key: FlowKey) -> Op:
    """Checks neighbours in arrival order and fails with OrderingError; a unique key must also be strict.

    Each source partition is checked by itself, then its last row against the next one's first on the driver, which
    gets two rows of key columns for each partition.
    """

    def run(flow: Flow) -> Flow:
        flow.schema.require(key.names)
        held = flow.keep_order()
        names = key.names
        row = F.struct(*[name_col(n).alias(n) for n in names])
        df = held.df.select(row.alias("now"), name_col(POS), parts(held.df).alias("part"))
        df = df.withColumn("before", F.lag("now").over(W.partitionBy("part").orderBy(POS)))
        bad = F.col("before").isNotNull() & _violates(key, flow, lambda n: F.col("before")[n], lambda n: F.col("now")[n])
        ends = df.groupBy("part").agg(F.max(bad).alias("bad"), F.min_by("now", POS).alias("first"), F.max_by("now", POS).alias("last"))
        rows = ends.orderBy("part").collect() if names else []
        for r in rows:
            if r["bad"]:
                raise OrderingError(f"rows are not in the order {key.orderings}{' without repeats' if key.unique else ''}")
        for a, b in zip(rows, rows[1:]):
            if _breaks(key, a["last"], b["first"]):
                raise OrderingError(f"rows are not in the order {key.orderings}: {a['last']} before {b['first']}")
        return flow.with_df(held.df, flow.schema.with_key(key))

    return run


def _breaks(key: FlowKey, a, b) -> bool:
    for direction, name in key.orderings:
        if direction not in (ASC, DESC) or a[name] == b[name]:
            continue
        return (a[name] > b[name]) == (direction == ASC)
    return key.unique and bool(key.orderings) and all(a[n] == b[n] for n in key.names)

