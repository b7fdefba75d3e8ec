"""Taps and sinks: where flows come from and go to."""

from .delimited import read_delimited, rejected_lines, write_delimited
from .formats import BINARY, CSV, NULL, TAB, XML, Format, compressed, format_of, register_suffix
from .jdbc import Database, DbTable, append_db, infer_schema, read_db, write_db
from .serde import (
    compress_flow, compress_rows, decompress_rows, deserialize_rows, deserialize_schema, serialize_rows, serialize_schema, spill_flow,
)
from .taps import (
    CollectorSink, NullSink, Sink, Tap, flow_sink, pipe_sink, read_from_file, read_from_file_auto, read_from_multi_file, read_from_parquet, read_from_stream, read_from_string,
    read_from_web, write_multi_file, write_to_file, write_to_file_auto, write_to_stream, write_to_string,
)

__all__ = [n for n in dir() if not n.startswith("_")]
