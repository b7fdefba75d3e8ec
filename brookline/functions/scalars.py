"""Arithmetic with a check of types, text clean-up, and the splitter of delimited lines; all built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as types_
from ..errors import SchemaError
from ..schema import FlowColumn


def _arithmetic(op: Callable[[Column, Column], Column], a: Column, b: Column, left: FlowColumn, right: FlowColumn) -> Column:
    x, y = types_.logical(left.type), types_.logical(right.type)
    if x != y or x not in (types_.INT, types_.UNSIGNED, types_.DECIMAL, types_.FLOAT):
        raise SchemaError(f"no arithmetic of {x} and {y}")
    out = op(a, b)
    return out.cast(T.DecimalType(20, 0)) if x == types_.UNSIGNED else out


#: (a, b, column of a, column of b) -> expression; both of one numeric type.
add = partial(_arithmetic, lambda a, b: a + b)
subtract = partial(_arithmetic, lambda a, b: a - b)
multiply = partial(_arithmetic, lambda a, b: a * b)


def equal(a: Column, b: Column) -> Column:
    """NaN equals itself."""
    return a.eqNullSafe(b)


def less(a: Column, b: Column, kind: T.DataType) -> Column:
    """NaN comes before every other number."""
    if types_.logical(kind) == types_.FLOAT:
        return F.when(F.isnan(b), False).when(F.isnan(a), True).otherwise(a < b)
    return a < b


def trim_whitespace(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_quotes(text: Column) -> Column:
    """Without one pair of equal quotes around the text."""
    n = F.length(text)
    pair = lambda q: text.startswith(q) & text.endswith(q)
    return F.when((n >= 2) & (pair('"') | pair("'")), F.substring(text, F.lit(2), n - 2)).otherwise(text)


def split_delimited(line: Column, separator: str) -> Column:
    """The fields of a line.

    A quote of either kind that begins a field makes separators literal up to the next such quote, or to the line's
    end; quotes stay in the value.
    """
    s = "\\x%02x" % ord(separator)
    field = rf""""[^"]*(?:"[^{s}]*|$)|'[^']*(?:'[^{s}]*|$)|[^{s}]*"""
    return F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f"(?s){s}({field})"), F.lit(1))


def group_indexes(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with its groups' names taken out, and each name's group number from the left."""
    names: dict[str, int] = {}
    out, at, n = [], 0, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?P?<([A-Za-z_]\w*)>|\((?!\?)", pattern, re.DOTALL):
        if m[0].startswith("("):
            n += 1
            if m[1]:
                names[m[1]] = n
                out += [pattern[at : m.start()], "("]
                at = m.end()
    return "".join(out) + pattern[at:], names
