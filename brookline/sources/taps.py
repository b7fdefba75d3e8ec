"""Named places to read from and write to."""

from __future__ import annotations

import io
import sys
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..flow import POS, Flow, name_col
from ..schema import FlowSchema
from ..staging import staged
from .delimited import header_line, parse_lines, rendered
from .formats import BINARY, CSV, NULL, TAB, Format, format_of
from .serde import BINARY_FORM, XML_FORM, deserialize_rows, serialize_chunks

_SEPARATORS = {"csv": ",", "tab": "\t"}


@dataclass(frozen=True)
class Tap:
    """A source: open() gives a flow."""

    open: Callable[[], Flow]

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence, schema: FlowSchema) -> Tap:
        return cls(lambda: Flow.rows(spark, rows, schema))

    @classmethod
    def from_flow(cls, flow: Flow) -> Tap:
        return cls(lambda: flow)


@dataclass(frozen=True)
class Sink:
    """A destination: run(flow) consumes it."""

    name: str
    run: Callable[[Flow], None]


class CollectorSink(Sink):
    """Keeps the flow, whose rows a caller may then collect."""

    def __init__(self, name: str = "collector"):
        self.__dict__["held"] = None
        super().__init__(name, lambda flow: self.__dict__.update(held=flow))

    @property
    def flow(self) -> Flow:
        return self.__dict__["held"]

    @property
    def rows(self) -> list:
        return self.flow.collect()


def NullSink() -> Sink:  # noqa: N802
    """Runs the flow and drops its rows."""
    return Sink("null", lambda flow: flow.df.write.format("noop").mode("overwrite").save())


def flow_sink(name: str, f: Callable[[Flow], None]) -> Sink:
    return Sink(name, f)


def pipe_sink(sink: Sink) -> Callable[[Flow], Flow]:
    """Hands the flow to a sink and passes it on; it is written to the shared folder in between, so it is worked out once."""

    def run(flow: Flow) -> Flow:
        held = flow.with_df(staged(flow.df, "tee"))
        sink.run(held)
        return held

    return run


def read_from_parquet(spark: SparkSession, path: str, **more) -> Tap:
    return Tap(lambda: Flow.of(spark.read.parquet(path), **more))


def read_from_file(spark: SparkSession, made: Format, path: str, schema: FlowSchema | None = None) -> Tap:
    """"-" reads this process's standard input, and "" nothing."""
    if path == "-":
        return read_from_stream(spark, made, sys.stdin.buffer, schema)
    if path == "":
        return Tap(lambda: NULL.read(spark, path, schema))
    if made.name.removesuffix(".gz") in ("xml", "binary") and not _is_folder(spark, path):
        return Tap(lambda: read_from_string(spark, made, bytes(spark.read.format("binaryFile").load(path).first()["content"]), schema).open())
    return Tap(lambda: made.read(spark, path, schema))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether Spark's writers made it; write_to_file's single files are not folders. Paths with wildcards count as folders."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    return not files.exists(place) or files.getFileStatus(place).isDirectory() or path.endswith(".parquet")


def read_from_file_auto(spark: SparkSession, path: str, schema: FlowSchema | None = None) -> Tap:
    return read_from_file(spark, format_of(path), path, schema)


def read_from_string(spark: SparkSession, made: Format, text: str | bytes, schema: FlowSchema | None = None) -> Tap:
    """Rows of a text that the driver holds."""

    def opened() -> Flow:
        kind = made.name.removesuffix(".gz")
        data = text.encode() if isinstance(text, str) else text
        if made.name.endswith(".gz"):
            import gzip

            data = gzip.decompress(data)
        if kind in _SEPARATORS:
            lines = spark.createDataFrame([(x,) for x in data.decode().splitlines()], "value string").withColumn(POS, F.monotonically_increasing_id())
            return parse_lines(lines, _SEPARATORS[kind], schema)
        if kind == "null":
            return NULL.read(spark, "", schema)
        rows, found = deserialize_rows(data, XML_FORM if kind == "xml" else BINARY_FORM)
        return Flow.rows(spark, [tuple(r[n] for n in found.names) for r in rows], found)

    return Tap(opened)


def read_from_stream(spark: SparkSession, made: Format, stream: IO[bytes], schema: FlowSchema | None = None) -> Tap:
    return Tap(lambda: read_from_string(spark, made, stream.read(), schema).open())


def read_from_web(spark: SparkSession, made: Format, url: str, schema: FlowSchema | None = None, timeout: float = 3600) -> Tap:
    """An HTTP document, read by the driver."""

    def opened() -> Flow:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return read_from_string(spark, made, answer.read(), schema).open()

    return Tap(opened)


def read_from_multi_file(spark: SparkSession, path: str) -> Tap:
    """A folder of columns, as write_multi_file wrote it."""
    return Tap(lambda: BINARY.read(spark, path, None))


def write_multi_file(path: str) -> Sink:
    return Sink(path, lambda flow: BINARY.write(flow, path, "none"))


def write_to_string(made: Format, flow: Flow) -> bytes:
    """The flow in the format, for results that the driver can hold."""
    out = io.BytesIO()
    write_to_stream(made, out).run(flow)
    return out.getvalue()


def write_to_stream(made: Format, stream: IO[bytes]) -> Sink:
    """Rows go to the stream a partition at a time."""

    def run(flow: Flow) -> None:
        kind = made.name.removesuffix(".gz")
        if kind in _SEPARATORS:
            sep = _SEPARATORS[kind]
            if flow.has_pos or flow.schema.key.orderings:
                flow, order = flow.in_order()
                flow = flow.with_df(flow.df.orderBy(*order))
            lines = rendered(flow, sep)
            chunks = [(header_line(flow.schema, sep) + "\n").encode()]
            body = ((r["value"] + "\n").encode() for r in lines.select("value").toLocalIterator())
        elif kind == "null":
            return NULL.write(flow, "", "none")
        elif kind in ("xml", "binary"):
            ordered = flow.df
            if flow.has_pos or flow.schema.key.orderings:
                held, order = flow.in_order()
                ordered = held.df.orderBy(*order)
            rows = ordered.select(*[name_col(n) for n in flow.schema.names]).toLocalIterator()
            chunks, body = (), serialize_chunks(rows, flow.schema, XML_FORM if kind == "xml" else BINARY_FORM)
        else:
            raise SchemaError(f"{made.name} can't be written to a stream")
        if made.name.endswith(".gz"):
            import gzip

            with gzip.GzipFile(fileobj=stream, mode="wb") as packed:
                for x in (*chunks, *body):
                    packed.write(x)
        else:
            for x in chunks:
                stream.write(x)
            for x in body:
                stream.write(x)

    return Sink(made.name, run)


def write_to_file(made: Format, path: str, single: bool = False) -> Sink:
    """"-" writes to standard output; else a folder of part files, as Spark writes them.

    single: one file, in the flow's order, that the driver writes a partition at a time to any file system Spark knows.
    """
    if path == "-":
        return write_to_stream(made, sys.stdout.buffer)
    if single:
        return Sink(path, lambda flow: _write_single(made, path, flow))
    return Sink(path, lambda flow: made.write(flow, path, made.compression))


class _HadoopFile(io.RawIOBase):
    """A file of Hadoop's, to write bytes to."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        self._out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
        super().close()


def _write_single(made: Format, path: str, flow: Flow) -> None:
    with io.BufferedWriter(_HadoopFile(flow.df.sparkSession, path), 1 << 20) as out:
        write_to_stream(made, out).run(flow)


def write_to_file_auto(path: str, single: bool = False) -> Sink:
    return write_to_file(format_of(path), path, single)


__all__ = [n for n in dir() if not n.startswith("_")] + ["CSV", "TAB"]
