"""Update documents as columns over the matched rows of a copy-on-write."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scope import Scope, Unsupported, literal, quoted
from tessera.functions.values import plain
from tessera.operators.predicates import Compiler, _Below, sure
from tessera.operators.stages import put
from tessera.sources.documents import kind_of


def is_replacement(update: Any) -> bool:
    """A document without operators replaces; a list of stages or any operator updates."""
    return not isinstance(update, list) and not any(k.startswith("$") for k in update)


def _widened(df: DataFrame, names: dict[str, Any]) -> DataFrame:
    """The frame with a null column for every new top-level field."""
    new = {n: v for n, v in names.items() if n not in df.columns}
    return df.withColumns({n: F.lit(None).cast(_settle(kind_of(plain(v)))) for n, v in new.items()}) if new else df


def _settle(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _at(base: Column, kind: T.DataType, path: list[str], change, filters: dict[str, dict], scope: Scope) -> Column:
    """A column with the value at a path changed; ``$[]`` is every element and ``$[name]`` those that its filter finds."""
    if not path:
        return change(base, kind)
    name, *rest = path
    if name.startswith("$[") and isinstance(kind, T.ArrayType):
        def element(x: Column) -> Column:
            changed = _at(x, kind.elementType, rest, change, filters, scope)
            if name == "$[]":
                return changed
            key = name[2:-1]
            query = filters[key]
            if isinstance(kind.elementType, T.StructType) and key not in query:
                below = {k.removeprefix(key + "."): v for k, v in query.items()}
                found = Compiler(_Below(kind.elementType, x, scope)).query(below)
            else:
                found = Compiler(scope).condition(x, kind.elementType, query[key])
            return F.when(sure(found), changed).otherwise(x)

        return F.transform(base, element)
    if isinstance(kind, T.ArrayType) and name.isdigit():
        return F.transform(base, lambda x, i: F.when(i == int(name), _at(x, kind.elementType, rest, change, filters, scope)).otherwise(x))
    if isinstance(kind, T.StructType) and name in kind.names:
        inner = _at(base.getField(name), kind[name].dataType, rest, change, filters, scope)
        return F.struct(*((inner if f.name == name else base.getField(f.name)).alias(f.name) for f in kind.fields))
    return put(base, kind, path, change(F.lit(None), T.NullType()))


def _fit(value: Any, kind: T.DataType) -> Column:
    column = literal(value)
    if isinstance(kind, T.VariantType):
        from tessera.functions.values import stringify

        return F.parse_json(F.lit(stringify(value)))
    return column if isinstance(kind, T.NullType) else column.cast(kind)


def _change(name: str, value: Any):
    """What an update operator does to a value. All but $set, $inc, $unset and $currentDate are extensions."""
    changes = {
        "$set": lambda c, k: _fit(value, k),
        "$unset": lambda c, k: F.lit(None).cast(k) if not isinstance(k, T.NullType) else c,
        "$inc": lambda c, k: F.coalesce(c, F.lit(0)) + literal(value),
        "$mul": lambda c, k: F.coalesce(c, F.lit(0)) * literal(value),
        "$min": lambda c, k: F.least(c, literal(value)),
        "$max": lambda c, k: F.greatest(c, literal(value)),
        "$currentDate": lambda c, k: F.localtimestamp(),
        "$push": lambda c, k: F.concat(F.coalesce(c, F.array().cast(k)), F.array(literal(value))) if not isinstance(k, T.NullType) else F.array(literal(value)),
        "$addToSet": lambda c, k: F.array_union(F.coalesce(c, F.array().cast(k)), F.array(literal(value))) if not isinstance(k, T.NullType) else F.array(literal(value)),
        "$pull": lambda c, k: F.array_remove(c, literal(value)),
    }
    if name not in changes:
        raise Unsupported(f"update operator {name}")
    return changes[name]


def apply_update(df: DataFrame, matched: Column, update: Any, array_filters: list[dict] | None = None) -> DataFrame:
    """The frame with an update of the rows where ``matched`` holds. New fields become columns, null elsewhere."""
    if isinstance(update, list):
        from tessera.plans.pipeline import Context, run_stages

        def none(name: str) -> DataFrame:
            raise Unsupported("an update does not read collections")

        changed = run_stages(df.where(matched), update, Context(df.sparkSession, none))
        return df.where(~matched).unionByName(changed, allowMissingColumns=True)
    filters = {next(iter(f)).split(".")[0]: f for f in array_filters or []}
    flat = [(op, path, v) for op, spec in update.items() if op != "$setOnInsert" for path, v in spec.items()]
    for op, path, _ in flat:
        if path.startswith("$") or ".$" in path and "$[" not in path:
            raise ValueError(f"the name {path!r} may not start with '$'")
    top = {path.split(".")[0]: dt.datetime(1970, 1, 1) if op == "$currentDate" else [v] if op in ("$push", "$addToSet") else v for op, path, v in flat if op not in ("$unset", "$rename") and "." not in path}
    df = _widened(df, top)
    scope = Scope(df.schema)
    columns: dict[str, Column] = {}
    kinds: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    for op, path, value in flat:
        if op == "$rename":
            columns[value] = columns.get(path, F.col(quoted(path)))
            columns[path] = F.lit(None).cast(kinds[path])
            continue
        head, *rest = path.split(".")
        if head not in kinds and op == "$unset":
            continue
        base = columns.get(head, F.col(quoted(head)) if head in kinds else F.lit(None))
        columns[head] = _at(base, kinds.get(head, T.NullType()), rest, _change(op, value), filters, scope)
    names = [*df.columns, *(c for c in columns if c not in df.columns)]
    return df.select(*(_whole(df, c, columns, matched) for c in names))


def _whole(df: DataFrame, name: str, columns: dict[str, Column], matched: Column) -> Column:
    if name not in columns:
        return F.col(quoted(name))
    if name not in df.columns:
        return F.when(matched, columns[name]).alias(name)
    new = df.select(columns[name].alias("x")).schema["x"].dataType
    old = df.schema[name].dataType
    if new == old or not (isinstance(new, T.StructType) and isinstance(old, T.StructType)):
        return F.when(matched, columns[name]).otherwise(F.col(quoted(name))).alias(name)
    fields = [F.col(quoted(name)).getField(f.name) if f.name in old.names else F.lit(None).cast(f.dataType) for f in new.fields]
    before = F.when(F.col(quoted(name)).isNotNull(), F.struct(*(c.alias(f.name) for c, f in zip(fields, new.fields, strict=True))))
    return F.when(matched, columns[name]).otherwise(before).alias(name)


def upserted(query: dict, update: Any) -> dict:
    """The document that an upsert inserts: the query's equalities, then the update."""
    if is_replacement(update):
        seed = {"_id": query["_id"]} if "_id" in query and not isinstance(query["_id"], dict) else {}
        return {**seed, **update}
    out: dict = {}

    def put_in(path: str, value: Any) -> None:
        at = out
        *heads, last = path.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = value

    def equalities(q: dict) -> None:
        for k, v in q.items():
            if k == "$and":
                for part in v:
                    equalities(part)
            elif not k.startswith("$") and not (isinstance(v, dict) and any(x.startswith("$") for x in v)):
                put_in(k, v)
            elif not k.startswith("$") and isinstance(v, dict) and "$eq" in v:
                put_in(k, v["$eq"])

    equalities(query)
    stages = update if isinstance(update, list) else [update]
    for spec in stages:
        for op, fields in spec.items():
            if op in ("$set", "$setOnInsert", "$inc", "$min", "$max", "$addFields"):
                for path, v in fields.items():
                    put_in(path, v)
            elif op in ("$push", "$addToSet"):
                for path, v in fields.items():
                    put_in(path, [v])
            elif op == "$currentDate":
                for path in fields:
                    put_in(path, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))  # noqa: UP017
    return out


def sure_match(df: DataFrame, query: dict, collation=None) -> Column:
    return sure(Compiler(Scope(df.schema), collation).query(query))
