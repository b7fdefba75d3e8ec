"""Looks at passing rows: counts, prints and assertions."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..flow import Fields, Flow
from .filters import Folded, fold

Op = Callable[[Flow], Flow]


def probe(test: Callable[[Fields], Column], action: Callable[[dict], None]) -> Op:
    """Calls a Python action for each matching row, in the workers, as rows pass."""

    def run(flow: Flow) -> Flow:
        names = flow.schema.names

        def look(batches):
            for batch in batches:
                for row in batch[batch["__hit"]][names].to_dict("records"):
                    action(row)
                yield batch.drop(columns="__hit")

        return flow.with_df(flow.df.withColumn("__hit", F.coalesce(test(flow.fields), F.lit(False))).mapInPandas(look, flow.df.schema))

    return run


def print_probe(render: Callable[[dict], str], test: Callable[[Fields], Column], most: int = 20, out=None) -> Op:
    """Prints matching rows, at most so many, by an action of its own: for debugging."""

    def run(flow: Flow) -> Flow:
        for row in flow.df.filter(test(flow.fields)).select(*flow.schema.names).take(most):
            print(render(row.asDict(recursive=True)), file=out or sys.stdout)
        return flow

    return run


def print_schema_probe(name: str, out=None) -> Op:
    def run(flow: Flow) -> Flow:
        print(f"{name}: {', '.join(f'{n} {k}' for n, k in flow.schema.simple)}; key {flow.schema.key}", file=out or sys.stdout)
        return flow

    return run


def assert_probe(test: Callable[[Fields], Column], message: Callable[[Fields], Column] | str = "assertion failed") -> Op:
    """Fails the job at the first row for which test does not hold."""

    def run(flow: Flow) -> Flow:
        said = F.lit(message) if isinstance(message, str) else message(flow.fields)
        return flow.with_df(flow.df.filter(F.when(test(flow.fields), True).otherwise(F.raise_error(said).cast("boolean"))))

    return run


def print_status(name: str = "flow", every: float = 5.0, out=None) -> tuple[Op, Folded]:
    """A pass-through that reports, and the number of rows that passed.

    While an action runs, a line every so many seconds says how many tasks of Spark's running stages are done; when it
    has ended, a last line says how many rows passed and the rows a second.
    """
    count, counted = fold(0, lambda t: F.count(F.lit(1)))
    say = lambda text: print(f"{name}: {text}", file=out or sys.stdout, flush=True)

    def run(flow: Flow) -> Flow:
        passed = count(flow)
        if not flow.df.isStreaming:
            threading.Thread(target=_report, args=(flow.df.sparkSession.sparkContext, counted, say, every), daemon=True).start()
        return passed

    return run, counted


def _report(context, counted: Folded, say: Callable[[str], None], every: float) -> None:
    done, began = threading.Event(), None

    def wait() -> None:
        counted.result  # until an action on the flow has ended
        done.set()

    threading.Thread(target=wait, daemon=True).start()
    while not done.wait(0.2 if began is None else every):
        running = [s for i in context.statusTracker().getActiveStageIds() if (s := context.statusTracker().getStageInfo(i))]
        if running:
            began = began or time.monotonic()
            say(f"{sum(s.numCompletedTasks for s in running)} of {sum(s.numTasks for s in running)} tasks done")
    took = time.monotonic() - began if began else 0.0
    say(f"{counted.result} rows passed" + (f", {counted.result / took:.0f} a second" if took else ""))
