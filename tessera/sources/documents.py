"""Python documents as DataFrames: one schema over all of them, a variant where a field has several kinds of values."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import Int32, ObjectId, from_ejson, plain, stringify


def kind_of(value: Any) -> T.DataType:
    """The Spark type of one value."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, Int32):
        return T.IntegerType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, Decimal):
        return T.DecimalType(38, max(0, -value.as_tuple().exponent))
    if isinstance(value, dt.datetime):
        return T.TimestampNTZType()
    if isinstance(value, bytes):
        return T.BinaryType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, kind_of(v)) for k, v in value.items()])
    if isinstance(value, list):
        out: T.DataType = T.NullType()
        for v in value:
            out = merged(out, kind_of(v))
        return T.ArrayType(out)
    return T.StringType()


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds both: numbers widen, documents have the fields of both, anything else is a variant."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    order = (T.IntegerType, T.LongType, T.DoubleType)
    if isinstance(a, order) and isinstance(b, order):
        return max(a, b, key=lambda k: order.index(type(k)))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        return T.StructType([T.StructField(n, merged(a[n].dataType if n in a.names else T.NullType(), b[n].dataType if n in b.names else T.NullType())) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    return T.VariantType()


def settled(kind: T.DataType) -> T.DataType:
    """Fields that are null everywhere are text."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in kind.fields])
    return T.ArrayType(settled(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _sent(kind: T.DataType) -> T.DataType:
    """The type in which values go to Spark: variants as JSON text."""
    if isinstance(kind, T.VariantType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _sent(f.dataType)) for f in kind.fields])
    return T.ArrayType(_sent(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _fitted(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return stringify(value)
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value]
    return float(value) if isinstance(kind, T.DoubleType) else value


def _received(column, kind: T.DataType):
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(column)
    return column


def frame_of(spark: SparkSession, documents: Iterable[dict], schema: T.StructType | None = None) -> DataFrame:
    rows = [plain(d) for d in documents]
    kind: T.DataType = schema or T.StructType([])
    for row in rows:
        kind = merged(kind, kind_of(row))
    kind = settled(kind)
    sent = spark.createDataFrame([_fitted(r, kind) for r in rows], _sent(kind))
    if not kind.fields:
        return sent
    return sent.select(*(_received(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f.name) for f in kind.fields))


def with_ids(documents: Iterable[dict]) -> list[dict]:
    """Documents with an ``_id`` first; a new one where there is none."""
    return [{"_id": d["_id"], **d} if "_id" in d else {"_id": ObjectId(), **d} for d in documents]


def document_of(row: Any) -> Any:
    """A row as a document; variants as their values, and fields that are null are left out (they count as missing)."""
    if isinstance(row, T.Row):
        return {k: document_of(v) for k, v in zip(row.__fields__, row, strict=True) if v is not None}
    if isinstance(row, list):
        return [document_of(v) for v in row]
    if hasattr(row, "toPython"):
        return from_ejson(row.toPython())
    return row


def read_ejson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file of extended JSON lines with a known schema: wrappers are taken off in the JVM, field by field."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    wrappers = {
        T.LongType: ("$numberLong", "bigint"), T.IntegerType: ("$numberInt", "int"), T.DoubleType: ("$numberDouble", "double"), T.StringType: ("$oid", "string"),
    }
    out = []
    for f in kind.fields:
        at = "$." + f.name if f.name.isidentifier() else f"$['{f.name}']"
        plain_value = F.try_variant_get("v", at, f.dataType.simpleString() if not isinstance(f.dataType, T.TimestampNTZType) else "string")
        if isinstance(f.dataType, T.TimestampNTZType):
            text = F.coalesce(F.try_variant_get("v", f"{at}['$date']", "string"), plain_value)
            millis = F.try_variant_get("v", f"{at}['$date']['$numberLong']", "bigint")
            value = F.coalesce(F.timestamp_millis(millis).cast("timestamp_ntz"), F.try_to_timestamp(text).cast("timestamp_ntz"))
        elif type(f.dataType) in wrappers:
            wrapper, name = wrappers[type(f.dataType)]
            value = F.coalesce(F.try_variant_get("v", f"{at}['{wrapper}']", name), plain_value)
        else:
            value = plain_value
        out.append(value.alias(f.name))
    return lines.select(*out)
