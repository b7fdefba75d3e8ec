"""Formats by name and by file suffix.

BINARY is Parquet: it keeps types, nesting, defaults and marks. XML is Spark's own, one element a row, with the schema
beside the data. NULL reads nothing and drops what is written.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import FormatNotFound
from ..flow import POS, Flow
from ..schema import FlowSchema
from .delimited import read_delimited, write_delimited

_SCHEMA = "_flow_schema"


@dataclass(frozen=True)
class Format:
    """read(spark, path, schema) gives a flow, write(flow, path, compression) writes one."""

    name: str
    read: Callable[[SparkSession, str, FlowSchema | None], Flow]
    write: Callable[[Flow, str, str], None]
    compression: str = "none"


def compressed(inner: Format) -> Format:
    return replace(inner, name=inner.name + ".gz", compression="gzip")


def _read_parquet(spark: SparkSession, path: str, schema: FlowSchema | None) -> Flow:
    flow = Flow.of(spark.read.parquet(path))
    return flow if schema is None else Flow(flow.df.select(*schema.names), schema)


def _write_parquet(flow: Flow, path: str, compression: str) -> None:
    flow.frame().write.mode("overwrite").option("compression", "gzip" if compression == "gzip" else "snappy").parquet(path)


def _write_xml(flow: Flow, path: str, compression: str) -> None:
    out = flow.frame().write.mode("overwrite").format("xml").option("rowTag", "data").option("rootTag", "dataSeq").option("attributePrefix", "_at_").option("nullValue", "\\N")
    (out.option("compression", "gzip") if compression == "gzip" else out).save(path)
    spark = flow.df.sparkSession
    spark.createDataFrame([(flow.schema.struct.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_SCHEMA}")


def _read_xml(spark: SparkSession, path: str, schema: FlowSchema | None) -> Flow:
    if schema is None:
        import json

        schema = FlowSchema.of(T.StructType.fromJson(json.loads(spark.read.text(f"{path}/{_SCHEMA}").first()[0])))
    df = spark.read.format("xml").schema(schema.struct).option("rowTag", "data").option("ignoreSurroundingSpaces", "false").option("attributePrefix", "_at_").option("nullValue", "\\N").option("pathGlobFilter", "part-*").load(path)
    return Flow(df, schema).fill_nulls()


def _read_null(spark: SparkSession, path: str, schema: FlowSchema | None) -> Flow:
    schema = schema or FlowSchema(())
    return Flow(spark.createDataFrame([], schema.struct), schema)


def delimited(name: str, separator: str) -> Format:
    return Format(name, lambda spark, path, schema: read_delimited(spark, path, separator, schema), lambda flow, path, c: write_delimited(flow, path, separator, c))


CSV, TAB = delimited("csv", ","), delimited("tab", "\t")
BINARY = Format("binary", _read_parquet, _write_parquet)
XML = Format("xml", _read_xml, _write_xml)
NULL = Format("null", _read_null, lambda flow, path, c: flow.df.write.format("noop").mode("overwrite").save())
SUFFIXES = {".bin": BINARY, ".parquet": BINARY, ".xml": XML, ".tab": TAB, ".tsv": TAB, ".csv": CSV, ".null": NULL, ".nul": NULL}


def register_suffix(suffix: str, made: Format) -> None:
    SUFFIXES[suffix] = made


def format_of(path: str) -> Format:
    """By the suffix; .gz in the end compresses what the suffix before it says, and "-" is tab separated."""
    if path == "-":
        return TAB
    stem, suffix = os.path.splitext(path)
    if suffix == ".gz":
        return compressed(format_of(stem))
    if suffix not in SUFFIXES:
        raise FormatNotFound(f"no format is known for {path}")
    return SUFFIXES[suffix]
