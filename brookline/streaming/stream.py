"""Unbounded flows: the operators that keep no order and no state run on a stream as they run on a table.

A stream has no arrival numbers, so operators that need them (limit, sliding_window, ids, ordered joins) are refused
by Spark or belong in foreachBatch, which write_stream takes as a function of a flow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..flow import Flow
from ..schema import FlowSchema

#: Operators that may stand in a stream; join and join_as_column with a right side that is a table.
STREAM_SAFE = (
    "map_rows", "fast_map", "simple_map", "map_add", "add_column", "add_columns", "add_column_regex", "add_columns_regex", "drop_columns", "keep_columns", "reorder_columns_by",
    "rename_columns", "rename_columns_by", "fill_columns", "schema_apply", "partial_schema_apply", "update_column", "to_lower", "trim_whitespace", "strip_quotes", "cleanup_input",
    "line_splitter", "simple_filter", "filter_column", "downsample", "flatten", "add_outer_column", "add_inner_columns", "rename_inner_columns", "update_nested", "inner_pipe",
    "sort_nested_by", "assert_probe", "fold", "print_status",
)


def read_stream(spark: SparkSession, path: str, schema: FlowSchema, fmt: str = "parquet", files_per_trigger: int = 1, **options: str) -> Flow:
    """New files of a folder as a flow; rows with nulls get the columns' defaults."""
    reader = spark.readStream.format(fmt).schema(schema.struct).option("maxFilesPerTrigger", files_per_trigger)
    return Flow(reader.options(**options).load(path), schema).fill_nulls()


def tumbling(flow: Flow, time: str, size: str, late: str, keys: list[str], aggregates: dict) -> DataFrame:
    """Event-time windows of a size with a watermark: keys, window_start and aggregates (name -> expression)."""
    marked = flow.df.withWatermark(time, late)
    grouped = marked.groupBy(F.window(time, size).alias("w"), *keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def write_stream(flow: Flow | DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, path: str | None = None, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Starts the stream: into a format's folder, or a function of each batch; with once, what is there is taken."""
    df = flow.frame() if isinstance(flow, Flow) else flow
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        out = out.trigger(availableNow=True)
    if callable(sink):
        return out.foreachBatch(sink).start()
    return out.format(sink).start(path) if path else out.format(sink).start()
