"""Expressions of documents as Spark columns. Operators that fail on bad input elsewhere give null (try_* functions)."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scope import Scope, Unsupported, literal, quoted

Typed = tuple[Column, T.DataType | None]
_OPERATORS: dict[str, Callable[[Any, Scope], Column]] = {}


def operator(*names: str):
    def register(f):
        for name in names:
            _OPERATORS[name] = f
        return f

    return register


def names() -> list[str]:
    return sorted(_OPERATORS)


def compile_expression(value: Any, scope: Scope) -> Column:
    return typed(value, scope)[0]


def typed(value: Any, scope: Scope) -> Typed:
    """The column of an expression and, where it is a path or variable, its type."""
    if isinstance(value, Column):
        return value, None
    if isinstance(value, str) and value.startswith("$$"):
        return scope.variable(value[2:])
    if isinstance(value, str) and value.startswith("$"):
        return scope.path(value[1:])
    if isinstance(value, list):
        return F.array(*(compile_expression(v, scope) for v in value)), None
    if isinstance(value, dict):
        heads = [k for k in value if k.startswith("$")]
        if heads:
            if len(value) != 1:
                raise ValueError("an expression has one operator")
            if heads[0] not in _OPERATORS:
                raise Unsupported(f"expression {heads[0]}")
            return _OPERATORS[heads[0]](value[heads[0]], scope), None
        return F.struct(*(compile_expression(v, scope).alias(k) for k, v in value.items())), None
    return literal(value), None


def _all(args: Any, scope: Scope) -> list[Column]:
    return [compile_expression(a, scope) for a in (args if isinstance(args, list) else [args])]


def _one(args: Any, scope: Scope) -> Column:
    return _all(args, scope)[0]


def truth(column: Column, kind: T.DataType | None = None) -> Column:
    """Whether a value counts as true: not null, false or zero."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column != 0, F.lit(False))
    if kind is not None:
        return column.isNotNull()
    return F.coalesce(column.cast("boolean"), F.lit(False))


@operator("$literal")
def _literal(args, scope):
    return literal(args)


@operator("$multiply")
def _multiply(args, scope):
    return functools.reduce(F.try_multiply, _all(args, scope))


@operator("$add")
def _add(args, scope):
    return functools.reduce(F.try_add, _all(args, scope))


@operator("$subtract")
def _subtract(args, scope):
    return F.try_subtract(*_all(args, scope))


@operator("$divide")
def _divide(args, scope):
    return F.try_divide(*_all(args, scope))


@operator("$mod")
def _mod(args, scope):
    return F.try_mod(*_all(args, scope))


@operator("$sqrt")
def _sqrt(args, scope):
    x = _one(args, scope)
    return F.when(x >= 0, F.sqrt(x))


def _plain(name: str, f: Callable[..., Column]) -> None:
    operator(name)(lambda args, scope: f(*_all(args, scope)))


for _name, _f in {
    "$abs": F.abs, "$floor": F.floor, "$ceil": F.ceil, "$exp": F.exp, "$ln": F.ln, "$pow": F.pow, "$toLower": F.lower, "$toUpper": F.upper,
    "$concat": F.concat, "$strLenCP": F.length, "$isArray": lambda c: F.typeof(c).startswith("array"), "$year": F.year, "$month": F.month,
    "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$toString": lambda c: c.cast("string"),
}.items():
    _plain(_name, _f)


@operator("$round")
def _round(args, scope):
    args = args if isinstance(args, list) else [args]
    return F.bround(compile_expression(args[0], scope), args[1] if len(args) > 1 else 0)


@operator("$ifNull")
def _if_null(args, scope):
    return F.coalesce(*_all(args, scope))


@operator("$cond")
def _cond(args, scope):
    test, yes, no = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
    return F.when(truth(*typed(test, scope)), compile_expression(yes, scope)).otherwise(compile_expression(no, scope))


@operator("$switch")
def _switch(args, scope):
    out = compile_expression(args.get("default"), scope)
    for branch in reversed(args["branches"]):
        out = F.when(truth(*typed(branch["case"], scope)), compile_expression(branch["then"], scope)).otherwise(out)
    return out


@operator("$and")
def _and(args, scope):
    return functools.reduce(lambda a, b: a & b, [truth(*typed(a, scope)) for a in args], F.lit(True))


@operator("$or")
def _or(args, scope):
    return functools.reduce(lambda a, b: a | b, [truth(*typed(a, scope)) for a in args], F.lit(False))


@operator("$not")
def _not(args, scope):
    return ~truth(*typed(args[0] if isinstance(args, list) else args, scope))


def _comparison(name: str, f: Callable[[Column, Column], Column]) -> None:
    @operator(name)
    def compare(args, scope):
        a, b = _all(args, scope)
        return f(a, b)


def _below(a: Column, b: Column) -> Column:
    """Null sorts below everything; convention."""
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


_comparison("$eq", lambda a, b: a.eqNullSafe(b))
_comparison("$ne", lambda a, b: ~a.eqNullSafe(b))
_comparison("$lt", _below)
_comparison("$gt", lambda a, b: _below(b, a))
_comparison("$lte", lambda a, b: ~_below(b, a))
_comparison("$gte", lambda a, b: ~_below(a, b))
_comparison("$cmp", lambda a, b: F.when(a.eqNullSafe(b), 0).when(_below(a, b), -1).otherwise(1))


@operator("$in")
def _in(args, scope):
    item, array = _all(args, scope)
    return F.coalesce(F.array_contains(array, item), F.lit(False))


@operator("$size")
def _size(args, scope):
    x = _one(args, scope)
    return F.when(x.isNotNull(), F.size(x))


@operator("$concatArrays")
def _concat_arrays(args, scope):
    """All elements in a row; null if any argument is."""
    given = args if isinstance(args, list) else [args]
    parts = [typed(a, scope) for a in given]
    if any(a is None or isinstance(kind, T.NullType) for a, (_, kind) in zip(given, parts, strict=True)):
        return F.lit(None)
    return F.concat(*(column for column, _ in parts))


def _fields(value: Any, scope: Scope) -> tuple[Column, dict[str, Column]]:
    """A document and its fields by name."""
    if isinstance(value, dict) and not any(k.startswith("$") for k in value):
        fields = {k: compile_expression(v, scope) for k, v in value.items()}
        return F.struct(*(c.alias(k) for k, c in fields.items())) if fields else F.lit(None), fields
    if isinstance(value, dict) and "$mergeObjects" in value:
        return _merge(value["$mergeObjects"], scope)
    column, kind = typed(value, scope)
    if value is None or isinstance(kind, T.NullType):
        return F.lit(None), {}
    if not isinstance(kind, T.StructType):
        raise Unsupported("$mergeObjects of documents whose fields are not known")
    return column, {f.name: column.getField(f.name) for f in kind.fields}


def _merge(args: Any, scope: Scope) -> tuple[Column, dict[str, Column]]:
    fields: dict[str, Column] = {}
    for arg in args if isinstance(args, list) else [args]:
        for name, column in _fields(arg, scope)[1].items():
            fields[name] = F.coalesce(column, fields[name]) if name in fields else column
    return F.struct(*(c.alias(k) for k, c in fields.items())), fields


@operator("$mergeObjects")
def _merge_objects(args, scope):
    """One document with the fields of all; of equal names the last counts. Nulls are missing (convention)."""
    return _merge(args, scope)[0]


@operator("$slice")
def _slice(args, scope):
    array, *rest = _all(args, scope)
    if len(rest) == 1:
        n = rest[0].cast("int")
        size = F.size(array)
        return F.when(n >= 0, F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(
            F.slice(array, F.greatest(size + n, F.lit(0)) + 1, F.greatest(-n, F.lit(0)))
        )
    at, n = (x.cast("int") for x in rest)
    begin = F.when(at < 0, F.greatest(F.size(array) + at, F.lit(0))).otherwise(at)
    return F.slice(array, begin + 1, n)


@operator("$arrayElemAt")
def _elem_at(args, scope):
    array, at = _all(args, scope)
    return F.get(array, F.when(at < 0, F.size(array) + at).otherwise(at).cast("int"))


def _element(kind: T.DataType | None) -> T.DataType | None:
    return kind.elementType if isinstance(kind, T.ArrayType) else None


@operator("$map")
def _map(args, scope):
    array, kind = typed(args["input"], scope)
    name = args.get("as", "this")
    return F.transform(array, lambda x: compile_expression(args["in"], scope.bind(name, x, _element(kind))))


@operator("$filter")
def _filter(args, scope):
    array, kind = typed(args["input"], scope)
    name = args.get("as", "this")
    return F.filter(array, lambda x: truth(*typed(args["cond"], scope.bind(name, x, _element(kind)))))


@operator("$reduce")
def _reduce(args, scope):
    array, kind = typed(args["input"], scope)
    start = compile_expression(args["initialValue"], scope)
    return F.reduce(array, start, lambda value, this: compile_expression(args["in"], scope.bind("value", value).bind("this", this, _element(kind))))


@operator("$sortArray")
def _sort_array(args, scope):
    array, kind = typed(args["input"], scope)
    by = args["sortBy"]
    if isinstance(by, int):
        return F.sort_array(array, by > 0)

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(list(by.items())):
            a, b = (compile_expression(f"$$x.{path}", scope.bind("x", v, _element(kind))) for v in (x, y))
            out = F.when(a.eqNullSafe(b), out).when(_below(a, b), -way).otherwise(way)
        return out

    return F.array_sort(array, compare)


@operator("$setField")
def _set_field(args, scope):
    name = args["field"]["$literal"] if isinstance(args["field"], dict) else args["field"]
    base, kind = typed(args["input"], scope)
    if args["value"] == "$$REMOVE":
        return base.dropFields(quoted(name))
    return base.withField(quoted(name), compile_expression(args["value"], scope))


@operator("$type")
def _type(args, scope):
    column, kind = typed(args, scope)
    if kind is None:
        return F.typeof(column)
    return F.when(column.isNull(), "null").otherwise(type_name(kind))


def type_name(kind: T.DataType) -> str:
    kinds = (
        (T.StringType, "string"), (T.BooleanType, "bool"), (T.IntegerType, "int"), (T.ShortType, "int"), (T.ByteType, "int"), (T.LongType, "long"),
        (T.DoubleType, "double"), (T.FloatType, "double"), (T.DecimalType, "decimal"), (T.TimestampNTZType, "date"), (T.TimestampType, "date"),
        (T.DateType, "date"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"), (T.BinaryType, "binData"), (T.NullType, "null"),
    )
    return next((name for cls, name in kinds if isinstance(kind, cls)), "object")


@operator("$toHashedIndexKey")
def _hashed(args, scope):
    """A 64-bit hash; stands in for an algorithm that has no public definition here."""
    return F.xxhash64(_one(args, scope))


@operator("$function")
def _function(args, scope):
    """A Python callable over its arguments, in Arrow batches; returns text unless ``returns`` names a type."""
    body = args["body"]
    if not callable(body):
        raise Unsupported("function bodies are Python callables")
    return F.udf(body, args.get("returns", "string"), useArrow=True)(*_all(args.get("args", []), scope))


def _string_test(name: str, key: str, f: Callable[[Column, Column], Column]) -> None:
    @operator(name)
    def test(args, scope):
        return f(compile_expression(args["input"], scope), compile_expression(args[key], scope))


_string_test("$encStrStartsWith", "prefix", lambda a, b: a.startswith(b))
_string_test("$encStrEndsWith", "suffix", lambda a, b: a.endswith(b))
_string_test("$encStrContains", "substring", lambda a, b: a.contains(b))


def ts_seconds(column: Column, timestamp: bool = False) -> Column:
    """The seconds of a 64-bit timestamp, its upper half; of a plain number its value over 2^32, not rounded."""
    return F.shiftright(column.cast("long"), 32) if timestamp else column / float(2**32)


def bson_size(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value as a binary document stores it; 0 for null, which is missing."""
    fixed = {T.DoubleType: 8, T.FloatType: 8, T.LongType: 8, T.IntegerType: 4, T.ShortType: 4, T.ByteType: 4, T.BooleanType: 1, T.TimestampNTZType: 8, T.TimestampType: 8, T.DateType: 8, T.DecimalType: 16}
    if isinstance(kind, T.StructType):
        parts = [F.when(column.getField(f.name).isNotNull(), F.lit(2 + len(f.name.encode())) + bson_size(column.getField(f.name), f.dataType)).otherwise(0) for f in kind.fields]
        size = functools.reduce(lambda a, b: a + b, parts, F.lit(5))
    elif isinstance(kind, T.ArrayType):  # elements are named by their places
        each = F.transform(column, lambda x, i: F.lit(2) + F.length(i.cast("string")) + bson_size(x, kind.elementType))
        size = F.lit(5) + F.aggregate(each, F.lit(0), lambda a, x: a + x)
    elif isinstance(kind, T.StringType):
        size = F.octet_length(column) + 5
    elif isinstance(kind, T.BinaryType):
        size = F.octet_length(column) + 5
    elif type(kind) in fixed:
        size = F.lit(fixed[type(kind)])
    else:
        raise Unsupported(f"the size of a {kind.simpleString()}")
    return F.when(column.isNotNull(), size).otherwise(0)


def data_format(size: Column) -> Column:
    """Bytes as text: whole B and KiB, MiB and GiB cut to two places; null is 0B."""
    kib, mib = F.floor(size / 1024), F.floor(size / (1024 * 1024))
    cut = lambda x: F.regexp_replace((F.floor(x / 1024 * 100) / 100).cast("string"), r"\.0$", "")
    return (
        F.when(size.isNull(), "0B")
        .when(size < 1024, F.concat(F.floor(size).cast("string"), F.lit("B")))
        .when(size < 1024**2, F.concat(kib.cast("string"), F.lit("KiB")))
        .when(size < 1024**3, F.concat(cut(kib), F.lit("MiB")))
        .otherwise(F.concat(cut(mib), F.lit("GiB")))
    )
