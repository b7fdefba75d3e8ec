"""Schemas with defaults, and the order and uniqueness that a flow is known to have."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as types_
from .errors import SchemaError

ASC, DESC, GROUPED, UNORDERED = "asc", "desc", "grouped", "unordered"
_DEFAULT, _UNSIGNED = "default", "unsigned"


@dataclass(frozen=True)
class FlowKey:
    """orderings: (direction, column) pairs, most significant first; unique: no two rows agree on all of them.

    A unique key without columns says that there is at most one row.
    """

    orderings: tuple[tuple[str, str], ...] = ()
    unique: bool = False

    @classmethod
    def asc(cls, *names: str, unique: bool = False) -> FlowKey:
        return cls(tuple((ASC, n) for n in names), unique)

    @property
    def names(self) -> list[str]:
        return [n for _, n in self.orderings]

    @property
    def singleton(self) -> bool:
        return self.unique and not self.orderings

    def least_restrictive(self, other: FlowKey) -> FlowKey:
        """The orderings that both begin with."""
        common = []
        for a, b in zip(self.orderings, other.orderings):
            if a != b:
                break
            common.append(a)
        whole = len(common) == len(self.orderings) == len(other.orderings)
        return FlowKey(tuple(common), self.unique and other.unique and whole)

    @staticmethod
    def fits(have: str, want: str) -> bool:
        return have == want or want == GROUPED and have in (ASC, DESC) or want == UNORDERED

    def satisfies(self, wanted: FlowKey) -> bool:
        """Whether rows in this order are also in the wanted one."""
        if len(wanted.orderings) > len(self.orderings):
            return False
        same = all(a[1] == b[1] and self.fits(a[0], b[0]) for a, b in zip(self.orderings, wanted.orderings))
        return same and (not wanted.unique or self.unique and len(self.orderings) == len(wanted.orderings))

    def _prefix(self, kept: Callable[[str], bool]) -> FlowKey:
        left = []
        for o in self.orderings:
            if not kept(o[1]):
                break
            left.append(o)
        return FlowKey(tuple(left), self.unique and len(left) == len(self.orderings))

    def subset(self, names: Iterable[str]) -> FlowKey:
        """What stays known when only these columns stay: the part before the first lost one."""
        held = set(names)
        return self._prefix(held.__contains__)

    def drop(self, names: Iterable[str]) -> FlowKey:
        lost = set(names)
        return self._prefix(lambda n: n not in lost)

    def rename(self, new: dict[str, str]) -> FlowKey:
        return FlowKey(tuple((d, new.get(n, n)) for d, n in self.orderings), self.unique)

    def grouped(self) -> FlowKey:
        """Equal keys still stand together, in no known direction."""
        return FlowKey(tuple((GROUPED, n) for _, n in self.orderings), self.unique)

    def set_unique(self, unique: bool) -> FlowKey:
        return replace(self, unique=unique)

    def sort_columns(self) -> list[Column]:
        return [F.col(f"`{n}`").desc() if d == DESC else F.col(f"`{n}`").asc() for d, n in self.orderings if d != UNORDERED]


@dataclass(frozen=True)
class FlowColumn:
    name: str
    type: T.DataType
    default: Any = None

    @classmethod
    def make(cls, name: str, kind: str | T.DataType, default: Any = None) -> FlowColumn:
        """kind: a logical name, a DDL type or a Spark type. Without a default the type's own is taken."""
        if isinstance(kind, str):
            kind = types_.SPARK[kind] if kind in types_.SPARK else T._parse_datatype_string(kind)
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            kind = T.LongType()
        if types_.is_nested(kind) and default:
            raise SchemaError(f"the default of nested column {name} must be empty")
        return cls(name, kind, types_.default_of(kind) if default is None else default)

    @property
    def field(self) -> T.StructField:
        marks = {_DEFAULT: json.dumps(self.default)} | ({_UNSIGNED: True} if isinstance(self.type, types_.UnsignedType) else {})
        return T.StructField(self.name, self.type, True, marks)

    @property
    def literal(self) -> Column:
        return types_.literal(self.default, self.type)


@dataclass(frozen=True)
class FlowSchema:
    columns: tuple[FlowColumn, ...]
    key: FlowKey = field(default_factory=FlowKey)

    def __post_init__(self):
        seen: set[str] = set()
        for c in self.columns:
            if c.name in seen:
                raise SchemaError(f"reused name {c.name}")
            seen.add(c.name)
        for n in self.key.names:
            if n not in seen:
                raise SchemaError(f"key column {n} is not in the schema")

    @classmethod
    def make(cls, *columns: FlowColumn | tuple, key: FlowKey | None = None) -> FlowSchema:
        """Of (name, kind) or (name, kind, default) tuples."""
        return cls(tuple(c if isinstance(c, FlowColumn) else FlowColumn.make(*c) for c in columns), key or FlowKey())

    @classmethod
    def of(cls, struct: T.StructType, key: FlowKey | None = None) -> FlowSchema:
        """Of a Spark schema; defaults are read from the fields' metadata."""
        made = []
        for f in struct.fields:
            marks = f.metadata or {}
            kind = types_.UnsignedType() if marks.get(_UNSIGNED) else f.dataType
            default = json.loads(marks[_DEFAULT]) if _DEFAULT in marks else types_.default_of(kind)
            made.append(FlowColumn(f.name, kind, default))
        return cls(tuple(made), key or FlowKey())

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def simple(self) -> list[tuple[str, str]]:
        """Names and logical types."""
        return [(c.name, types_.logical(c.type, strict=False)) for c in self.columns]

    def with_key(self, key: FlowKey) -> FlowSchema:
        return replace(self, key=key)

    def with_defaults(self, **values: Any) -> FlowSchema:
        self.require(values)
        return replace(self, columns=tuple(replace(c, default=values.get(c.name, c.default)) for c in self.columns))

    def contains(self, name: str) -> bool:
        return name in self.names

    def require(self, names: Iterable[str]) -> None:
        missing = [n for n in names if n not in self.names]
        if missing:
            raise SchemaError(f"no column {', '.join(missing)} among {', '.join(self.names)}")

    def column(self, name: str) -> FlowColumn:
        self.require([name])
        return next(c for c in self.columns if c.name == name)

    def index(self, name: str) -> int:
        self.require([name])
        return self.names.index(name)

    def try_index(self, name: str) -> int | None:
        return self.names.index(name) if name in self.names else None

    def pick(self, names: Sequence[str]) -> FlowSchema:
        """These columns in this order, without a key."""
        return FlowSchema(tuple(map(self.column, names)))

    def inner(self, name: str) -> FlowSchema:
        kind = self.column(name).type
        if not types_.is_nested(kind):
            raise SchemaError(f"{name} is not a nested table")
        return FlowSchema.of(kind.elementType)

    def add(self, column: FlowColumn) -> FlowSchema:
        """The column comes first."""
        return FlowSchema((column, *self.columns), self.key)

    def concat(self, other: FlowSchema) -> FlowSchema:
        """The other's columns come after; the key stays."""
        return FlowSchema(self.columns + other.columns, self.key)

    def drop(self, names: Iterable[str]) -> FlowSchema:
        names = list(names)
        self.require(names)
        return FlowSchema(tuple(c for c in self.columns if c.name not in names), self.key.drop(names))

    def keep(self, names: Iterable[str]) -> FlowSchema:
        """The order of columns stays."""
        names = list(names)
        self.require(names)
        return FlowSchema(tuple(c for c in self.columns if c.name in names), self.key.subset(names))

    def update(self, new: dict[str, FlowColumn]) -> FlowSchema:
        """Columns replaced by old name; unknown names are ignored."""
        renamed = {o: c.name for o, c in new.items()}
        return FlowSchema(tuple(new.get(c.name, c) for c in self.columns), self.key.rename(renamed))

    def rename(self, new: dict[str, str]) -> FlowSchema:
        return self.update({o: replace(self.column(o), name=n) for o, n in new.items() if o in self.names})

    def default_row(self) -> dict[str, Any]:
        return {c.name: c.default for c in self.columns}

    def check(self, row: Sequence) -> None:
        """Whether a row's values are as many and of such types as the columns."""
        if len(row) != len(self.columns):
            raise SchemaError(f"{len(row)} values for {len(self.columns)} columns")
        fits = {types_.INT: (int,), types_.UNSIGNED: (int,), types_.DECIMAL: (int, Decimal), types_.FLOAT: (float, int), types_.STRING: (str,), "nested": (list, tuple)}
        for c, v in zip(self.columns, row):
            kind = types_.logical(c.type)
            if not isinstance(v, fits[kind]) or isinstance(v, bool) or kind == types_.UNSIGNED and v < 0:
                raise SchemaError(f"{v!r} is not a {kind} for {c.name}")
