"""Flows over Structured Streaming."""

from .stream import STREAM_SAFE, read_stream, write_stream

__all__ = ["STREAM_SAFE", "read_stream", "write_stream"]
