"""Dataflow analytics on Spark DataFrames: named taps, stages, joins, nested tables and sinks."""
