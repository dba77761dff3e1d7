"""Names that expressions and predicates can refer to: a frame's columns and bound variables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import plain


class Unsupported(NotImplementedError):
    """What this engine knows of and does not do."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: Any) -> Column:
    """A constant; dicts become structs and lists arrays. Times stay without a zone, as tables hold them."""
    value = plain(value)
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items())) if value else F.lit(None).cast("struct<>")
    if isinstance(value, list):
        return F.array(*(literal(v) for v in value))
    if isinstance(value, Decimal):
        return F.lit(value)
    return F.lit(value)


@dataclass(frozen=True)
class Scope:
    """The columns in reach by their schema, and variables by name with their columns and types."""

    schema: T.StructType
    variables: Mapping[str, tuple[Column, T.DataType | None]] = field(default_factory=dict)

    def bind(self, name: str, column: Column, kind: T.DataType | None = None) -> Scope:
        return Scope(self.schema, {**self.variables, name: (column, kind)})

    def root(self) -> Column:
        return F.struct(*(F.col(quoted(f.name)) for f in self.schema.fields))

    def path(self, path: str) -> tuple[Column, T.DataType]:
        """A dotted path's column and type; what is missing is null. Arrays of documents give arrays of values."""
        name, _, rest = path.partition(".")
        if path in self.schema.names:
            name, rest = path, ""
        if name not in self.schema.names:
            return F.lit(None), T.NullType()
        return step(F.col(quoted(name)), self.schema[name].dataType, rest)

    def variable(self, path: str) -> tuple[Column, T.DataType | None]:
        name, _, rest = path.partition(".")
        if name in ("ROOT", "CURRENT"):
            return step(self.root(), self.schema, rest) if rest else (self.root(), self.schema)
        if name == "NOW":
            return F.localtimestamp(), T.TimestampNTZType()
        if name == "REMOVE":
            return F.lit(None), T.NullType()
        if name not in self.variables:
            raise ValueError(f"undefined variable: {name}")
        column, kind = self.variables[name]
        if not rest:
            return column, kind
        if kind is None:
            for part in rest.split("."):
                column = column.getField(part)
            return column, None
        return step(column, kind, rest)


def step(column: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType]:
    """Follow a dotted path below a column."""
    if not path:
        return column, kind
    if isinstance(kind, T.ArrayType):
        first = path.split(".")[0]
        if first.isdigit():  # a position
            return step(F.get(column, int(first)), kind.elementType, path.partition(".")[2])
        probe = step(F.lit(None), kind.elementType, path)[1]
        if isinstance(probe, T.NullType):
            return F.lit(None), probe
        inner = F.transform(column, lambda x: step(x, kind.elementType, path)[0])
        return (F.flatten(inner), probe) if isinstance(probe, T.ArrayType) else (inner, T.ArrayType(probe))
    name, _, rest = path.partition(".")
    if isinstance(kind, T.StructType):
        if path in kind.names:
            return column.getField(path), kind[path].dataType
        if name not in kind.names:
            return F.lit(None), T.NullType()
        return step(column.getField(name), kind[name].dataType, rest)
    if isinstance(kind, T.MapType):
        return step(F.try_element_at(column, F.lit(name)), kind.valueType, rest)
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$." + path, "variant"), kind
    return F.lit(None), T.NullType()
