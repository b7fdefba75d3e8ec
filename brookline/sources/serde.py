"""Rows and schemas as bytes, and compressed or spilled flows."""

from __future__ import annotations

import base64
import gzip
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import types as T

from .. import types as types_
from ..errors import SchemaError
from ..flow import Flow
from ..schema import FlowKey, FlowSchema
from ..staging import staged

XML_FORM, BINARY_FORM = "xml", "binary"
_MAGIC = b"brookline-rows-1\n"


def _schema_json(schema: FlowSchema) -> str:
    return json.dumps({"fields": schema.struct.jsonValue(), "key": [list(o) for o in schema.key.orderings], "unique": schema.key.unique})


def _schema_of(text: str) -> FlowSchema:
    held = json.loads(text)
    return FlowSchema.of(T.StructType.fromJson(held["fields"]), FlowKey(tuple(map(tuple, held["key"])), held["unique"]))


def serialize_schema(schema: FlowSchema, form: str = BINARY_FORM) -> bytes:
    text = _schema_json(schema)
    if form == XML_FORM:
        root = ET.Element("schema")
        root.text = text
        return ET.tostring(root, encoding="utf-8")
    return _MAGIC + text.encode()


def deserialize_schema(data: bytes, form: str = BINARY_FORM) -> FlowSchema:
    try:
        if form == XML_FORM:
            return _schema_of(ET.fromstring(data).text or "")
        if not data.startswith(_MAGIC):
            raise SchemaError("not a serialized schema")
        return _schema_of(data[len(_MAGIC) :].decode())
    except (ET.ParseError, ValueError) as e:
        raise SchemaError(f"not a serialized schema: {e}") from e


def _arrow(kind: T.DataType) -> pa.DataType:
    if types_.is_nested(kind):
        return pa.list_(pa.struct([(f.name, _arrow(f.dataType)) for f in kind.elementType.fields]))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return {types_.INT: pa.int64(), types_.FLOAT: pa.float64(), types_.STRING: pa.string()}[types_.logical(kind)]


def plain(value: Any) -> Any:
    """A row as a dictionary, nested rows included."""
    if isinstance(value, T.Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def _to_xml(parent: ET.Element, name: str, value: Any) -> None:
    if isinstance(value, list):
        held = ET.SubElement(parent, "rows", name=name)
        for row in value:
            x = ET.SubElement(held, "row")
            for k, v in row.items():
                _to_xml(x, k, v)
    elif value is not None:
        ET.SubElement(parent, "val", name=name, b64="1").text = base64.b64encode(str(value).encode()).decode()


def _from_xml(element: ET.Element, schema: FlowSchema) -> dict:
    row = {}
    for x in element:
        column = schema.column(x.attrib["name"])
        if x.tag == "rows":
            inner = schema.inner(column.name)
            row[column.name] = [_from_xml(r, inner) for r in x]
        else:
            text = base64.b64decode(x.text or "").decode()
            row[column.name] = types_.parse(text, types_.logical(column.type))
    return {c.name: row.get(c.name) for c in schema.columns}


def serialize_chunks(rows: Iterable, schema: FlowSchema, form: str = BINARY_FORM, most: int = 4096) -> Iterator[bytes]:
    """The bytes of serialize_rows piece by piece, so many rows at a time."""
    rows = iter(rows)
    chunks = iter(lambda: [plain(r) for r in islice(rows, most)], [])
    if form == XML_FORM:
        head = ET.Element("schema")
        head.text = _schema_json(schema)
        yield b"<flow>" + ET.tostring(head, encoding="utf-8", xml_declaration=False) + b"<rows>"
        for chunk in chunks:
            held = []
            for r in chunk:
                x = ET.Element("row")
                for k, v in r.items():
                    _to_xml(x, k, v)
                held.append(ET.tostring(x, encoding="utf-8", xml_declaration=False))
            yield b"".join(held)
        yield b"</rows></flow>"
        return
    arrow = pa.schema([(c.name, _arrow(c.type)) for c in schema.columns], metadata={"flow": _schema_json(schema)})
    out = io.BytesIO()
    out.write(_MAGIC)
    with pa.ipc.new_stream(out, arrow) as writer:
        for chunk in chunks:
            writer.write_table(pa.Table.from_pylist(chunk, arrow))
            yield out.getvalue()
            out.seek(0)
            out.truncate()
    yield out.getvalue()


def serialize_rows(rows: Iterable, schema: FlowSchema, form: str = BINARY_FORM) -> bytes:
    """Rows (Row objects or dictionaries) with their schema in front."""
    return b"".join(serialize_chunks(rows, schema, form))


def deserialize_rows(data: bytes, form: str = BINARY_FORM) -> tuple[list[dict], FlowSchema]:
    try:
        if form == XML_FORM:
            root = ET.fromstring(data)
            schema = _schema_of(root.findtext("schema") or "")
            return [_from_xml(x, schema) for x in root.find("rows")], schema
        if not data.startswith(_MAGIC):
            raise SchemaError("not serialized rows")
        with pa.ipc.open_stream(data[len(_MAGIC) :]) as reader:
            table = reader.read_all()
        return table.to_pylist(), _schema_of(table.schema.metadata[b"flow"].decode())
    except (ET.ParseError, pa.ArrowInvalid) as e:
        raise SchemaError(f"not serialized rows: {e}") from e


def compress_rows(rows: list, schema: FlowSchema, form: str = BINARY_FORM) -> bytes:
    return gzip.compress(serialize_rows(rows, schema, form))


def decompress_rows(data: bytes, form: str = BINARY_FORM) -> tuple[list[dict], FlowSchema]:
    return deserialize_rows(gzip.decompress(data), form)


def compress_flow(flow: Flow) -> Flow:
    """Kept in memory as compressed columns, and on disk where memory ends, once an action has run."""
    return flow.with_df(flow.df.persist(StorageLevel.MEMORY_AND_DISK))


def spill_flow(flow: Flow) -> Flow:
    """Written to the shared folder and read from there."""
    return flow.with_df(staged(flow.df, "spilled"))
