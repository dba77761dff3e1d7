"""Query documents as filter columns.

Comparisons stay bare so that they reach the scan; only negations are made two-valued. A missing field and null are the
same on typed columns (convention). A condition on an array column holds if any element fulfils it.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import truth, type_name, typed
from tessera.functions.scope import Scope, Unsupported, literal
from tessera.functions.values import Regex
from tessera.operators import geo
from tessera.operators.collation import Collation

_NUMBERS = (T.NumericType,)


@dataclass
class Compiler:
    """Compiles the query documents of one find or match; ``order`` collects the distances of near queries."""

    scope: Scope
    collation: Collation | None = None
    text_fields: tuple[str, ...] | None = None
    order: list[Column] = field(default_factory=list)

    def query(self, query: dict | None) -> Column:
        parts = [self._entry(k, v) for k, v in (query or {}).items()]
        return functools.reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))

    def _entry(self, key: str, value: Any) -> Column | None:
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} needs a list that is not empty")
            parts = [self.query(v) for v in value]
            if key == "$and":
                return functools.reduce(lambda a, b: a & b, parts)
            if key == "$nor":
                return ~functools.reduce(lambda a, b: a | b, [sure(p) for p in parts])
            return functools.reduce(lambda a, b: a | b, parts)
        if key == "$expr":
            return truth(*typed(value, self.scope))
        if key == "$jsonSchema":
            return self.json_schema(value, self.scope.root(), self.scope.schema, top=True)
        if key == "$text":
            return self._text(value)
        if key == "$where":
            if not callable(value):
                raise Unsupported("$where takes a Python callable")
            arrow = "variant" not in self.scope.schema.simpleString()  # Arrow has no such type
            return sure(F.udf(lambda row: bool(value(row.asDict(recursive=True))), "boolean", useArrow=arrow)(self.scope.root()))
        if key == "$comment":
            return None
        if key.startswith("$"):
            raise Unsupported(f"query operator {key}")
        column, kind = self.scope.path(key)
        return self.condition(column, kind, value)

    def condition(self, column: Column, kind: T.DataType, value: Any) -> Column:
        if isinstance(value, dict) and any(k.startswith("$") for k in value):
            rest = dict(value)
            if "$regex" in rest:
                pattern, options = rest.pop("$regex"), rest.pop("$options", "")
                pattern = pattern if isinstance(pattern, Regex) else Regex(pattern, options)
                rest["$regex"] = pattern
            for name in ("$near", "$nearSphere"):
                if name in rest:
                    keep, distance = geo.near(column, kind, rest.pop(name), name == "$nearSphere", rest.pop("$minDistance", None), rest.pop("$maxDistance", None))
                    self.order.append(distance)
                    rest[""] = keep
            parts = [v if k == "" else self._operator(k, column, kind, v) for k, v in rest.items()]
            parts = [p for p in parts if p is not None]
            return functools.reduce(lambda a, b: a & b, parts, F.lit(True))
        return self._equal(column, kind, value)

    def _any(self, column: Column, kind: T.DataType, test: Callable[[Column, T.DataType], Column]) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.exists(column, lambda x: test(x, kind.elementType))
        return test(column, kind)

    def _collated(self, column: Column, kind: T.DataType) -> Column:
        return self.collation.key(column) if self.collation and isinstance(kind, T.StringType) else column

    def _equal(self, column: Column, kind: T.DataType, value: Any) -> Column:
        if isinstance(value, Regex | re.Pattern):
            return self._regex(column, kind, value)
        if value is None:
            none = column.isNull()
            return none | F.exists(column, lambda x: x.isNull()) if isinstance(kind, T.ArrayType) else none
        if isinstance(value, list) and isinstance(kind, T.ArrayType):
            whole = column == (F.array(*(_constant(kind.elementType, v) for v in value)) if value else literal(value))
            nested = isinstance(kind.elementType, T.ArrayType)
            return whole | F.array_contains(column, literal(value)) if nested else whole
        return self._any(column, kind, lambda x, k: self._compare(x, k, value, lambda a, b: a == b))

    def _compare(self, column: Column, kind: T.DataType, value: Any, f: Callable[[Column, Column], Column]) -> Column:
        """A comparison within the value's kind of type; another kind never matches."""
        if isinstance(kind, T.VariantType):
            name = "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"
            same = F.schema_of_variant(column).isin(*_VARIANT_KINDS[name])
            return same & f(F.try_variant_get(column, "$", name), literal(float(value) if name == "double" else value))
        if not _comparable(kind, value):
            return F.lit(False)
        if isinstance(value, dict) and isinstance(kind, T.StructType):
            if set(value) != set(kind.names):
                return F.lit(False)
            return f(column, F.struct(*(literal(value[n]).cast(kind[n].dataType).alias(n) for n in kind.names)))
        other = _constant(kind, value)
        if self.collation and isinstance(kind, T.StringType):
            return f(self.collation.key(column), self.collation.key(other))
        return f(column, other)

    def _regex(self, column: Column, kind: T.DataType, value: Any) -> Column:
        if isinstance(value, re.Pattern):
            options = "".join(n for n, flag in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if value.flags & flag)
            value = Regex(value.pattern, options)
        value = value if isinstance(value, Regex) else Regex(value)

        def test(x: Column, k: T.DataType) -> Column:
            if isinstance(k, T.VariantType):
                return F.try_variant_get(x, "$", "string").rlike(value.java())
            return x.rlike(value.java()) if isinstance(k, T.StringType) else F.lit(False)

        return self._any(column, kind, test)

    def _in(self, column: Column, kind: T.DataType, values: list) -> Column:
        plain = [v for v in values if v is not None and not isinstance(v, Regex | re.Pattern | list | dict)]
        parts = [self._equal(column, kind, v) for v in values if v is None or isinstance(v, Regex | re.Pattern | list | dict)]
        plain = [v for v in plain if isinstance(kind, T.ArrayType | T.VariantType) or _comparable(kind, v)]
        if plain and not isinstance(kind, T.ArrayType | T.VariantType) and not self.collation:
            parts.append(column.isin(*(_constant(kind, v) for v in plain)))
        else:
            parts += [self._equal(column, kind, v) for v in plain]
        return functools.reduce(lambda a, b: a | b, parts, F.lit(False))

    def _operator(self, name: str, column: Column, kind: T.DataType, value: Any) -> Column | None:
        simple = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
        if name in simple:
            if value is None:
                return column.isNull() if name in ("$gte", "$lte") else F.lit(False)
            return self._any(column, kind, lambda x, k: self._compare(x, k, value, simple[name]))
        if name == "$eq":
            return self._equal(column, kind, value)
        if name == "$ne":
            if value is not None and not isinstance(kind, T.ArrayType | T.VariantType) and _comparable(kind, value) and not isinstance(value, dict | list):
                return ~self._collated(column, kind).eqNullSafe(self._collated(_constant(kind, value), kind))
            return ~sure(self._equal(column, kind, value))
        if name == "$in":
            return self._in(column, kind, value)
        if name == "$nin":
            return ~sure(self._in(column, kind, value))
        if name == "$not":
            inner = self._regex(column, kind, value) if isinstance(value, Regex | re.Pattern) else self.condition(column, kind, value)
            return ~sure(inner)
        if name == "$exists":
            return column.isNotNull() if value else column.isNull()
        if name == "$type":
            return self._type(column, kind, value)
        if name == "$mod":
            divisor, remainder = value
            return self._any(column, kind, lambda x, k: F.try_mod(x.cast("long"), F.lit(int(divisor))) == int(remainder) if isinstance(k, _NUMBERS) else F.lit(False))
        if name == "$regex":
            return self._regex(column, kind, value)
        if name == "$all":
            items = [v["$elemMatch"] if isinstance(v, dict) and "$elemMatch" in v else v for v in value]
            if not items:
                return F.lit(False)
            tests = [self._element(column, kind, v) if isinstance(v, dict) else self._equal(column, kind, v) for v in items]
            return functools.reduce(lambda a, b: a & b, tests)
        if name == "$elemMatch":
            return self._element(column, kind, value)
        if name == "$size":
            return F.coalesce(F.size(column) == int(value), F.lit(False)) & column.isNotNull() if isinstance(kind, T.ArrayType) else F.lit(False)
        if name.startswith("$bits"):
            mask = F.lit(sum(1 << b for b in value) if isinstance(value, list) else int(value)).cast("long")
            tests = {
                "$bitsAllClear": lambda x: x.bitwiseAND(mask) == 0,
                "$bitsAllSet": lambda x: x.bitwiseAND(mask) == mask,
                "$bitsAnyClear": lambda x: x.bitwiseAND(mask) != mask,
                "$bitsAnySet": lambda x: x.bitwiseAND(mask) != 0,
            }
            return self._any(column, kind, lambda x, k: tests[name](x.cast("long")) if isinstance(k, _NUMBERS) else F.lit(False))
        if name == "$geoWithin":
            return geo.within(column, kind, value)
        if name == "$geoIntersects":
            return geo.intersects(column, kind, value)
        if name in ("$comment", "$options"):
            return None
        raise Unsupported(f"query operator {name}")

    def _element(self, column: Column, kind: T.DataType, value: dict) -> Column:
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        if all(k.startswith("$") for k in value):
            return F.exists(column, lambda x: self.condition(x, kind.elementType, value))
        if not isinstance(kind.elementType, T.StructType):
            return F.lit(False)

        def fits(x: Column) -> Column:
            inner = Compiler(_Below(kind.elementType, x, self.scope), self.collation)
            return inner.query(value)

        return F.exists(column, fits)

    def _type(self, column: Column, kind: T.DataType, value: Any) -> Column:
        # Type numbers by name.
        numbers = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 16: "int", 17: "timestamp", 18: "long", 19: "decimal"}
        names = {numbers.get(v, v) for v in (value if isinstance(value, list) else [value])}
        if "number" in names:
            names |= {"int", "long", "double", "decimal"}
        if isinstance(kind, T.VariantType):
            kinds = {"string": ("STRING",), "bool": ("BOOLEAN",), "int": ("BIGINT",), "long": ("BIGINT",), "double": ("DOUBLE", "DECIMAL"), "null": ("VOID",)}
            schema = F.schema_of_variant(column)
            wanted = [p for n in names for p in kinds.get(n, ())]
            out = functools.reduce(lambda a, b: a | b, [schema.startswith(p) for p in wanted], F.lit(False))
            out = out | schema.startswith("ARRAY") if "array" in names else out
            return out | schema.startswith("OBJECT") if "object" in names else out
        null = column.isNull() if "null" in names else F.lit(False)
        if type_name(kind) in names:
            return null | column.isNotNull()
        if isinstance(kind, T.ArrayType) and type_name(kind.elementType) in names:
            return null | (F.size(F.filter(column, lambda x: x.isNotNull())) > 0)
        return null

    def _text(self, spec: dict) -> Column:
        """All quoted phrases, any of the plain words if there is no phrase, and none of the words after a minus."""
        fields = self.text_fields or tuple(f.name for f in self.scope.schema.fields if isinstance(f.dataType, T.StringType))
        body = F.concat_ws(" ", *(self.scope.path(f)[0] for f in fields))
        search = spec["$search"]
        if not spec.get("$caseSensitive"):
            body, search = F.lower(body), search.lower()
        phrases = re.findall(r'"([^"]+)"', search)
        bare = re.sub(r'"[^"]*"', " ", search).split()
        terms = [w for t in bare if not t.startswith("-") for w in re.findall(r"\w+", t)]
        without = [w for t in bare if t.startswith("-") for w in re.findall(r"\w+", t)]
        found = F.split(body, r"[^\p{L}\p{N}_]+")
        has = lambda ws: F.arrays_overlap(found, F.array(*map(F.lit, ws)))
        out = functools.reduce(lambda a, b: a & b, [body.contains(p) for p in phrases], F.lit(True))
        if not phrases:
            out = out & (has(terms) if terms else F.lit(False))
        return out & ~has(without) if without else out

    def json_schema(self, spec: dict, column: Column, kind: T.DataType, top: bool = False) -> Column:
        """Required fields, types, ranges, lengths, patterns and nested schemas; absent fields pass what is not required."""
        tests = []
        kinds = spec.get("bsonType") or spec.get("type")
        if kinds and not top:
            names = {"integer": "int", "boolean": "bool"}
            wanted = [names.get(k, k) for k in (kinds if isinstance(kinds, list) else [kinds])]
            tests.append(self._type(column, kind, wanted))
        at = lambda name: self.scope.path(name) if top else _field(column, kind, name)
        tests += [at(name)[0].isNotNull() for name in spec.get("required", [])]
        for name, inner in spec.get("properties", {}).items():
            below, below_kind = at(name)
            tests.append(below.isNull() | self.json_schema(inner, below, below_kind))
        for key, f in (("minimum", lambda v: column >= v), ("maximum", lambda v: column <= v)):
            if key in spec and isinstance(kind, _NUMBERS):
                bound = _constant(kind, spec[key])
                tests.append(f(bound) & (column != bound) if spec.get("exclusive" + key.capitalize()) else f(bound))
        if "multipleOf" in spec and isinstance(kind, _NUMBERS):
            tests.append(F.try_mod(column, F.lit(spec["multipleOf"])) == 0)
        if isinstance(kind, T.StringType):
            tests += [F.length(column) >= spec["minLength"]] if "minLength" in spec else []
            tests += [F.length(column) <= spec["maxLength"]] if "maxLength" in spec else []
            tests += [column.rlike(spec["pattern"])] if "pattern" in spec else []
        if isinstance(kind, T.ArrayType):
            tests += [F.size(column) >= spec["minItems"]] if "minItems" in spec else []
            tests += [F.size(column) <= spec["maxItems"]] if "maxItems" in spec else []
            if isinstance(spec.get("items"), dict):
                tests.append(F.forall(column, lambda x: sure(self.json_schema(spec["items"], x, kind.elementType))))
        if "enum" in spec:
            tests.append(self._in(column, kind, spec["enum"]))
        again = lambda s: sure(self.json_schema(s, column, kind, top))
        tests += [functools.reduce(lambda a, b: a & b, map(again, spec["allOf"]))] if "allOf" in spec else []
        tests += [functools.reduce(lambda a, b: a | b, map(again, spec["anyOf"]))] if "anyOf" in spec else []
        if "oneOf" in spec:
            tests.append(sum((again(s).cast("int") for s in spec["oneOf"]), F.lit(0)) == 1)
        tests += [~again(spec["not"])] if "not" in spec else []
        return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


_VARIANT_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("BIGINT", "DOUBLE", *(f"DECIMAL({p},{s})" for p in range(1, 19) for s in range(p + 1)))}


def _field(column: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.StructType) and name in kind.names:
        return column.getField(name), kind[name].dataType
    return F.lit(None), T.NullType()


class _Below(Scope):
    """The fields of an array's element as a scope."""

    def __init__(self, schema: T.StructType, element: Column, outer: Scope):
        object.__setattr__(self, "schema", schema)
        object.__setattr__(self, "variables", outer.variables)
        object.__setattr__(self, "element", element)

    def root(self) -> Column:
        return self.element

    def path(self, path: str) -> tuple[Column, T.DataType]:
        from tessera.functions.scope import step

        return step(self.element, self.schema, path)


def sure(column: Column) -> Column:
    """Two-valued: unknown counts as false."""
    return F.coalesce(column, F.lit(False))


def _comparable(kind: T.DataType, value: Any) -> bool:
    import datetime as dt
    from decimal import Decimal

    if isinstance(kind, T.BooleanType) or isinstance(value, bool):
        return isinstance(kind, T.BooleanType) and isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, int | float | Decimal)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType | T.DateType):
        return isinstance(value, dt.datetime | dt.date)
    if isinstance(kind, T.StructType):
        return hasattr(value, "t") or isinstance(value, dict)
    if isinstance(kind, T.StringType):
        return not isinstance(value, int | float | Decimal | dt.datetime | dict | list)
    return not isinstance(kind, T.NullType)


def _constant(kind: T.DataType, value: Any) -> Column:
    """The literal that a column is compared with. A column of single precision holds fractions rounded, so they are rounded for it
    as well, and 0.3 equals a stored 0.3; what single precision cannot hold, at either end, is compared as it is."""
    from decimal import Decimal

    if not isinstance(kind, T.FloatType) or not isinstance(value, float | Decimal):
        return literal(value)
    try:
        near = struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        return literal(value)
    return literal(value) if near == 0 and value != 0 else F.lit(near).cast("float")


def compile_query(query: dict | None, schema: T.StructType, collation: Collation | None = None, **variables: tuple[Column, T.DataType]) -> Column:
    return Compiler(Scope(schema, variables), collation).query(query)
