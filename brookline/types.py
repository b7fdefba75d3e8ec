"""Logical types, their Spark types, defaults, and coercion as column expressions.

INT is 64-bit signed, UNSIGNED is decimal(20, 0) with a mark in the field's metadata (UnsignedType here), DECIMAL is any
other decimal, FLOAT is double, STRING is string, and a nested table is an array of structs.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

INT, UNSIGNED, DECIMAL, FLOAT, STRING = "int", "unsigned", "decimal", "float", "string"


class UnsignedType(T.DecimalType):
    """decimal(20, 0) that holds 64-bit numbers without sign."""

    def __init__(self):
        super().__init__(20, 0)

    @classmethod
    def typeName(cls) -> str:  # noqa: N802
        return "decimal"

    def __repr__(self) -> str:
        return "UnsignedType()"


SPARK = {INT: T.LongType(), UNSIGNED: UnsignedType(), FLOAT: T.DoubleType(), STRING: T.StringType()}
DEFAULTS: dict[str, Any] = {INT: 0, UNSIGNED: 0, DECIMAL: 0, FLOAT: 0.0, STRING: ""}
_WRAP = 1 << 64


def logical(kind: T.DataType, strict: bool = True) -> str:
    """The logical name of a Spark type; narrower numbers count as their wide kin. Not strict: others by Spark's name."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(kind, T.DecimalType):
        return UNSIGNED if isinstance(kind, UnsignedType) else DECIMAL
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return FLOAT
    if isinstance(kind, T.StringType):
        return STRING
    if is_nested(kind):
        return "nested"
    if not strict:
        return kind.simpleString()
    raise SchemaError(f"{kind.simpleString()} has no place among the types of a flow")


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def default_of(kind: T.DataType) -> Any:
    """None for types that only pass through: times, booleans, plain arrays and the like."""
    if is_nested(kind):
        return []
    return DEFAULTS.get(logical(kind, strict=False))


def literal(value: Any, kind: T.DataType) -> Column:
    if is_nested(kind):
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def coerce(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """value as the target type: numbers round half to even, text parses or fails, and `na`, `n\\a` and `\\n` are NaN."""
    if source == target:
        return value
    a, b = logical(source), logical(target)
    if a == b == "nested":
        return coerce_nested(value, source, target)
    if "nested" in (a, b):
        raise SchemaError(f"no coercion from {source.simpleString()} to {target.simpleString()}")
    if a == b:
        return value.cast(target)
    if a == UNSIGNED and b == INT:
        raise SchemaError("no coercion from unsigned to int")
    if a == INT and b == UNSIGNED:
        wide = value.cast(T.DecimalType(20, 0))
        return F.when(wide < 0, (wide + F.lit(Decimal(_WRAP))).cast(target)).otherwise(wide.cast(target))
    if a == FLOAT and b in (INT, UNSIGNED):
        return F.rint(value).cast(target)
    if a == DECIMAL and b in (INT, UNSIGNED):
        return F.bround(value, 0).cast(target)
    if a == FLOAT and b == STRING:
        # whole numbers print without a fraction
        whole = (value == F.rint(value)) & (F.abs(value) < 1e15)
        return F.when(whole, F.when(whole, value).cast("long").cast("string")).otherwise(value.cast("string"))
    if a == STRING and b == FLOAT:
        text = F.lower(F.trim(value))
        missing = text.isin("na", "n\\a", "\\n")
        return F.when(missing, F.lit(float("nan"))).otherwise(F.when(~missing, value).cast("double"))
    return (F.trim(value) if a == STRING else value).cast(target)


def coerce_nested(value: Column, source: T.ArrayType, target: T.ArrayType) -> Column:
    """Inner fields are coerced by position."""
    have, want = source.elementType.fields, target.elementType.fields
    if len(have) != len(want):
        raise SchemaError("nested tables differ in their number of columns")
    return F.transform(value, lambda x: F.struct(*[coerce(x[h.name], h.dataType, w.dataType).alias(w.name) for h, w in zip(have, want)]))


def best_fit(text: str) -> int | float | str:
    """The text as an int if it is one, else a float, else itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def best_fit_type(column: Column) -> Column:
    """Per row, the narrowest type that a text fits: int, float or string."""
    return F.when(column.try_cast("bigint").isNotNull(), INT).when(column.try_cast("double").isNotNull(), FLOAT).otherwise(STRING)


def parse(text: str, kind: str) -> Any:
    """A text as a Python value of the logical type."""
    try:
        if kind == DECIMAL:
            return Decimal(text)
        if kind == INT:
            value = int(text)
            if not -(1 << 63) <= value < 1 << 63:
                raise SchemaError("numeric overflow")
            return value
        if kind == UNSIGNED:
            value = int(text)
            if not 0 <= value < _WRAP:
                raise SchemaError("numeric overflow")
            return value
        if kind == FLOAT:
            return float("nan") if text.strip().lower() in ("na", "n\\a", "\\n") else float(text)
        if kind == STRING:
            return text
    except (ValueError, InvalidOperation) as e:
        raise SchemaError(f"invalid format: {text!r} as {kind}") from e
    raise SchemaError(f"a text can't be a {kind}")
