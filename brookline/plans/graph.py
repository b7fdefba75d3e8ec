"""Publish and subscribe: stages that begin at a named tap or published flow, and runs with several sinks.

    totals = stage("orders") | simple_filter(...) % "big"       # publishes under a name
    run([(sink, stage("big") | group(...)), (other, totals)], {"orders": tap})

A run resolves the names in order of need, builds one DataFrame for each sink, keeps published flows that several
stages read (in the executors while the sinks run; in the shared folder where a collector reads them later), and runs
the sinks' actions side by side.
"""

from __future__ import annotations

import graphlib
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from ..errors import PipelineError
from ..flow import Flow
from ..sources.taps import CollectorSink, Sink, Tap
from ..staging import staged

Op = Callable[[Flow], Flow]
Join = Callable[[Flow, Flow], Flow]


def _label(op) -> str:
    name = getattr(op, "__qualname__", type(op).__name__)
    return name.split(".<locals>")[0]


@dataclass(frozen=True)
class Stage:
    """A tap's or published name, and steps after it: ("op", f), ("join", f, right stage) or ("publish", name)."""

    source: str
    steps: tuple = field(default=())

    def _with(self, *step) -> Stage:
        return replace(self, steps=(*self.steps, step))

    def then(self, op: Op) -> Stage:
        return self._with("op", op)

    def __or__(self, op: Op) -> Stage:
        return self.then(op)

    def apply(self, f: Callable[[Stage], Stage]) -> Stage:
        return f(self)

    def chain(self, ops: Sequence[Op]) -> Stage:
        return replace(self, steps=(*self.steps, *(("op", o) for o in ops)))

    def join_with(self, join: Join, right: Stage) -> Stage:
        return self._with("join", join, right)

    def multi_join(self, joins: Sequence[tuple[Join, Stage]]) -> Stage:
        made = self
        for join, right in joins:
            made = made.join_with(join, right)
        return made

    def publish(self, name: str) -> Stage:
        return self._with("publish", name)

    def __mod__(self, name: str) -> Stage:
        return self.publish(name)


def stage(name: str) -> Stage:
    return Stage(name)


def tap_name(made: Stage) -> str:
    return made.source


def stage_name(made: Stage) -> str:
    """The published name of a stage's end, or what it does last."""
    if not made.steps:
        return made.source
    last = made.steps[-1]
    return last[1] if last[0] == "publish" else _label(last[1])


def _published(made: Stage) -> list[tuple[str, Stage]]:
    """Names that a stage publishes, with the steps that lead to them."""
    found = []
    for i, step in enumerate(made.steps):
        if step[0] == "publish":
            found.append((step[1], replace(made, steps=made.steps[:i])))
        elif step[0] == "join":
            found += _published(step[2])
    return found


def _needs(made: Stage) -> list[str]:
    """Names that a stage reads, once for each place."""
    return [made.source] + [n for s in made.steps if s[0] == "join" for n in _needs(s[2])]


class Graph:
    """Stages by sink and taps by name, checked: every name is known and published once, and none needs itself."""

    def __init__(self, sinks: Sequence[tuple[Sink, Stage]], taps: Mapping[str, Tap]):
        self.sinks, self.taps = list(sinks), dict(taps)
        self.named: dict[str, Stage] = {}
        for _, made in self.sinks:
            for name, before in _published(made):
                if self.named.get(name, before) is not before and self.named[name] != before:
                    raise PipelineError(f"{name} is published twice")
                self.named[name] = before
        both = set(self.named) & set(self.taps)
        if both:
            raise PipelineError(f"reused tap name {', '.join(sorted(both))}")
        known = set(self.named) | set(self.taps)
        for made in [*self.named.values(), *(s for _, s in self.sinks)]:
            missing = sorted(set(_needs(made)) - known)
            if missing:
                raise PipelineError(f"no tap or published name {', '.join(missing)}")
        try:
            self.order = [n for n in graphlib.TopologicalSorter({n: set(_needs(s)) for n, s in self.named.items()}).static_order()]
        except graphlib.CycleError as e:
            raise PipelineError(f"circular dependency: {' -> '.join(e.args[1])}") from e
        self.uses = Counter(n for s in [*self.named.values(), *(s for _, s in self.sinks)] for n in _needs(s))

    @property
    def read_later(self) -> bool:
        return any(isinstance(s, CollectorSink) for s, _ in self.sinks)

    def flows(self) -> tuple[list[tuple[Sink, Flow]], list[Flow]]:
        """The flow for each sink, and those that are kept because they are read more than once."""
        held: dict[str, Flow] = {}
        kept: list[Flow] = []

        def resolve(name: str) -> Flow:
            if name not in held:
                flow = self.taps[name].open() if name in self.taps else build(self.named[name])
                if name in self.named and self.uses[name] > 1:
                    if self.read_later:
                        flow = flow.with_df(staged(flow.df, "published"))
                    else:
                        flow = flow.with_df(flow.df.persist())
                        kept.append(flow)
                held[name] = flow
            return held[name]

        def build(made: Stage) -> Flow:
            at, flow = 0, None
            for i in reversed(range(len(made.steps))):  # go on from the last published name
                if made.steps[i][0] == "publish":
                    at, flow = i + 1, resolve(made.steps[i][1])
                    break
            flow = flow if flow is not None else resolve(made.source)
            for step in made.steps[at:]:
                flow = step[1](flow) if step[0] == "op" else step[1](flow, build(step[2]))
            return flow

        for name in self.order:
            resolve(name)
        return [(sink, build(made)) for sink, made in self.sinks], kept


def multi_run(sinks: Sequence[tuple[Sink, Stage]], taps: Mapping[str, Tap], threads: int = 4) -> None:
    """Runs every sink; the first error is raised after all have ended."""
    flows, kept = Graph(sinks, taps).flows()
    try:
        with ThreadPoolExecutor(max(1, min(threads, len(flows)))) as pool:
            done = [pool.submit(sink.run, flow) for sink, flow in flows]
        for d in done:
            d.result()
    finally:
        for flow in kept:
            flow.df.unpersist()


def run(sink: Sink, made: Stage, taps: Mapping[str, Tap]) -> None:
    multi_run([(sink, made)], taps)


def run_simple(tap: Tap, ops: Sequence[Op], sink: Sink) -> None:
    run(sink, stage("input").chain(ops), {"input": tap})


def to_dot(sinks: Sequence[tuple[Sink, Stage]], taps: Mapping[str, Tap]) -> str:
    """The graph in Graphviz's language."""
    lines, count = ["digraph flows {"], 0
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
    seen: set[str] = set()
    for name in taps:
        lines.append(f"  {quote(name)} [shape=ellipse];")

    def node(label: str) -> str:
        nonlocal count
        count += 1
        lines.append(f"  n{count} [shape=box, label={quote(label)}];")
        return f"n{count}"

    def draw(made: Stage) -> str:
        at = quote(made.source)
        steps = made.steps
        for i in reversed(range(len(steps))):
            if steps[i][0] == "publish" and steps[i][1] in seen:
                at, steps = quote(steps[i][1]), steps[i + 1 :]
                break
        for step in steps:
            if step[0] == "publish":
                seen.add(step[1])
                lines.append(f"  {quote(step[1])} [shape=hexagon];")
                new = quote(step[1])
            else:
                new = node(_label(step[1]))
                if step[0] == "join":
                    lines.append(f"  {draw(step[2])} -> {new} [style=dashed];")
            lines.append(f"  {at} -> {new};")
            at = new
        return at

    for sink, made in sinks:
        end = draw(made)
        lines += [f"  {quote('sink ' + sink.name)} [shape=ellipse];", f"  {end} -> {quote('sink ' + sink.name)};"]
    return "\n".join([*lines, "}"])
