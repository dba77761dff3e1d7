"""Values of documents: constructors, the extended JSON codec, sizes and printable forms."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
import re
import secrets
import struct
import time
import uuid
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

UTC = dt.timezone.utc  # noqa: UP017
_FIRST, _LAST = dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)


class Int32(int):
    """A 32-bit integer; text is read up to its first non-digit, no argument gives 0."""

    def __new__(cls, value: Any = "0"):
        if isinstance(value, str):
            found = re.match(r"\s*[-+]?\d+", value)
            if not found:
                raise ValueError(f"not a number: {value!r}")
            value = int(found[0])
        value = int(value)
        if not -(2**31) <= value < 2**31:
            raise OverflowError("out of the range of a 32-bit integer")
        return super().__new__(cls, value)


class Long(int):
    """A 64-bit integer."""

    def __new__(cls, value: Any = "0"):
        value = int(value)
        if not -(2**63) <= value < 2**63:
            raise OverflowError("out of the range of a 64-bit integer")
        return super().__new__(cls, value)


class Double(float):
    """A double; the kind of plain numbers with a fraction."""


def number_decimal(value: Any = "0") -> Decimal:
    return Decimal(str(value))


@dataclass(frozen=True, order=True)
class Timestamp:
    """Seconds and an ordinal within the second."""

    t: int = 0
    i: int = 0

    @classmethod
    def of(cls, value: Any = 0, i: int = 0) -> Timestamp:
        if isinstance(value, dict):
            return cls(int(value["t"]), int(value["i"]))
        if isinstance(value, Long):
            return cls(value >> 32, value & 0xFFFFFFFF)
        return cls(int(value), i)

    def to_long(self) -> int:
        return self.t << 32 | self.i


def ts_to_seconds(value: Any) -> float:
    """The seconds of a timestamp; a plain number is divided by 2 ** 32."""
    if isinstance(value, Timestamp):
        return value.t
    return value >> 32 if isinstance(value, Long) else value / 4294967296


@dataclass(frozen=True)
class ObjectId:
    """Twelve bytes as 24 hexadecimal digits: seconds, five random bytes of the process, and a counter."""

    hex: str = ""

    _process = secrets.token_bytes(5)
    _counter = [secrets.randbelow(1 << 24)]

    def __post_init__(self):
        text = self.hex
        if isinstance(text, bytes):
            text = text.hex()
        elif isinstance(text, int):
            text = struct.pack(">I", text & 0xFFFFFFFF).hex() + "0" * 16
        elif not text:
            ObjectId._counter[0] = (ObjectId._counter[0] + 1) % (1 << 24)
            text = struct.pack(">I", int(time.time())).hex() + self._process.hex() + f"{self._counter[0]:06x}"
        if not re.fullmatch("[0-9a-fA-F]{24}", text):
            raise ValueError("an object id has 24 hexadecimal digits")
        object.__setattr__(self, "hex", text.lower())

    def __str__(self) -> str:
        return self.hex

    def __repr__(self) -> str:
        return f"ObjectId('{self.hex}')"


@dataclass(frozen=True)
class Binary:
    """Bytes with a subtype."""

    subtype: int
    data: bytes

    def __repr__(self) -> str:
        if self.subtype == 4 and len(self.data) == 16:
            return f"UUID('{uuid.UUID(bytes=self.data)}')"
        if self.subtype == 5:
            return f"MD5('{self.data.hex()}')"
        if self.subtype == 9 and len(self.data) >= 2:
            kinds = {0x03: ("fromInt8Array", "b", "Int8Array"), 0x27: ("fromFloat32Array", "<f", "Float32Array"), 0x10: ("fromPackedBits", "B", "Uint8Array")}
            if self.data[0] in kinds:
                name, kind, array = kinds[self.data[0]]
                numbers = [x[0] for x in struct.iter_unpack(kind, self.data[2:])]
                return f"Binary.{name}(new {array}({numbers}))"
        return f"Binary.createFromBase64('{base64.b64encode(self.data).decode()}', {self.subtype})"


def bin_data(subtype: int, text: str) -> Binary:
    return Binary(subtype, base64.b64decode(text, validate=True))


def hex_data(subtype: int, text: str) -> Binary:
    return Binary(subtype, bytes.fromhex(text))


def md5(text: str) -> Binary:
    return Binary(5, bytes.fromhex(text))


def uuid_of(text: str | None = None) -> Binary:
    return Binary(4, (uuid.UUID(text) if text else uuid.uuid4()).bytes)


def _reorder(data: bytes, order: str) -> bytes:
    if order == "java":
        return data[7::-1] + data[:7:-1]
    if order == "csharp":
        return data[3::-1] + data[5:3:-1] + data[7:5:-1] + data[8:]
    return data


def legacy_uuid(text: str | None, order: str) -> Binary:
    """A UUID of subtype 3 in the byte order of a language: java turns both halves around, csharp the first three groups."""
    return Binary(3, _reorder((uuid.UUID(text) if text else uuid.uuid4()).bytes, order))


@dataclass(frozen=True)
class Code:
    code: str
    scope: dict | None = None


@dataclass(frozen=True)
class DBRef:
    ref: str
    id: Any
    db: str | None = None
    fields: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Regex:
    pattern: str
    options: str = ""

    def java(self) -> str:
        """The pattern with its options as inline flags."""
        flags = "".join(x for x in "imsx" if x in self.options)
        return f"(?{flags}){self.pattern}" if flags else self.pattern


@dataclass(frozen=True)
class MinKey:
    pass


@dataclass(frozen=True)
class MaxKey:
    pass


class Symbol(str):
    pass


_ISO = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?$")


def iso_date(text: str | None = None) -> dt.datetime:
    """A UTC time without zone, in milliseconds: separators are optional and a missing zone means UTC."""
    if not text:
        now = dt.datetime.now(UTC).replace(tzinfo=None)
        return now.replace(microsecond=now.microsecond // 1000 * 1000)
    found = _ISO.match(text.strip())
    if not found:
        raise ValueError(f"{text!r} is not a valid ISODate")
    year, month, day, hour, minute, second = (int(x or 0) for x in found.groups()[:6])
    micros = int(((found[7] or "") + "000")[:3]) * 1000
    zone = found[8]
    out = dt.datetime(year, month, day, hour, minute, second, micros)
    if zone and zone not in "Zz":
        shift = dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
        out = out - shift if zone[0] == "+" else out + shift
    if not _FIRST <= out <= _LAST:
        raise ValueError(f"{text!r} is out of range")
    return out


def _millis(value: dt.datetime) -> int:
    value = value.replace(tzinfo=UTC) if value.tzinfo is None else value
    return round((value - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(milliseconds=1))


def from_millis(value: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)


def to_ejson(value: Any, relaxed: bool = True) -> Any:
    """A value as plain JSON with type wrappers; relaxed keeps numbers and usual dates plain."""
    go = lambda x: to_ejson(x, relaxed)
    if value is None or isinstance(value, bool | str) and not isinstance(value, Symbol):
        return value
    if isinstance(value, Symbol):
        return {"$symbol": str(value)}
    if isinstance(value, int):
        if relaxed:
            return int(value)
        small = isinstance(value, Int32) or not isinstance(value, Long) and -(2**31) <= value < 2**31
        return {"$numberInt" if small else "$numberLong": str(int(value))}
    if isinstance(value, float):
        if relaxed and math.isfinite(value):
            return float(value)
        text = {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value) or ("NaN" if math.isnan(value) else repr(float(value)))
        return {"$numberDouble": text}
    if isinstance(value, Decimal):
        return {"$numberDecimal": str(value)}
    if isinstance(value, dt.datetime):
        if relaxed and value.year >= 1970:
            return {"$date": value.strftime("%Y-%m-%dT%H:%M:%S") + f".{value.microsecond // 1000:03d}Z"}
        return {"$date": {"$numberLong": str(_millis(value))}}
    if isinstance(value, ObjectId):
        return {"$oid": value.hex}
    if isinstance(value, Timestamp):
        return {"$timestamp": {"t": value.t, "i": value.i}}
    if isinstance(value, Binary | bytes):
        value = value if isinstance(value, Binary) else Binary(0, value)
        return {"$binary": {"base64": base64.b64encode(value.data).decode(), "subType": f"{value.subtype:02x}"}}
    if isinstance(value, Regex):
        return {"$regularExpression": {"pattern": value.pattern, "options": value.options}}
    if isinstance(value, MinKey | MaxKey):
        return {"$minKey" if isinstance(value, MinKey) else "$maxKey": 1}
    if isinstance(value, Code):
        return {"$code": value.code} | ({"$scope": go(value.scope)} if value.scope is not None else {})
    if isinstance(value, DBRef):
        return {"$ref": value.ref, "$id": go(value.id)} | ({"$db": value.db} if value.db else {}) | {k: go(v) for k, v in value.fields.items()}
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: go(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [go(v) for v in value]
    raise TypeError(f"no extended JSON form for {type(value).__name__}")


def from_ejson(value: Any) -> Any:
    """Plain JSON with type wrappers as a value."""
    if isinstance(value, list):
        return [from_ejson(v) for v in value]
    if not isinstance(value, dict):
        return value
    keys = set(value)
    if len(keys) == 1:
        (key,), (x,) = value.keys(), value.values()
        if key == "$date":
            if isinstance(x, str):
                return iso_date(x)
            return from_millis(int(x["$numberLong"] if isinstance(x, dict) else x))
        if key == "$binary":
            return Binary(int(x["subType"], 16), base64.b64decode(x["base64"]))
        if key == "$timestamp":
            return Timestamp(int(x["t"]), int(x["i"]))
        if key == "$regularExpression":
            return Regex(x["pattern"], x.get("options", ""))
        kinds = {
            "$oid": ObjectId, "$numberInt": Int32, "$numberLong": Long, "$numberDouble": Double, "$numberDecimal": Decimal,
            "$uuid": uuid_of, "$symbol": Symbol, "$code": Code, "$minKey": lambda _: MinKey(), "$maxKey": lambda _: MaxKey(), "$undefined": lambda _: None,
        }
        if key in kinds:
            return kinds[key](x)
    if keys == {"$code", "$scope"}:
        return Code(value["$code"], from_ejson(value["$scope"]))
    if {"$ref", "$id"} <= keys:
        rest = {k: from_ejson(v) for k, v in value.items() if k not in ("$ref", "$id", "$db")}
        return DBRef(value["$ref"], from_ejson(value["$id"]), value.get("$db"), rest)
    return {k: from_ejson(v) for k, v in value.items()}


def stringify(value: Any, relaxed: bool = True, indent: int | None = None) -> str:
    return json.dumps(to_ejson(value, relaxed), ensure_ascii=False, indent=indent)


def parse(text: str) -> Any:
    return from_ejson(json.loads(text))


def bson_size(value: Any) -> int:
    """Bytes of an encoded document: a length, one element for each key, and a closing zero."""
    items = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
    return 5 + sum(2 + len(str(k).encode()) + _size(v) for k, v in items)


def _size(v: Any) -> int:
    if v is None or isinstance(v, MinKey | MaxKey):
        return 0
    if isinstance(v, bool):
        return 1
    if isinstance(v, Long):
        return 8
    if isinstance(v, int):
        return 4 if -(2**31) <= v < 2**31 else 8
    if isinstance(v, float | dt.datetime | Timestamp):
        return 8
    if isinstance(v, Decimal):
        return 16
    if isinstance(v, ObjectId):
        return 12
    if isinstance(v, str):
        return 5 + len(v.encode())
    if isinstance(v, Binary | bytes):
        return 5 + len(v.data if isinstance(v, Binary) else v)
    if isinstance(v, Regex):
        return 2 + len(v.pattern.encode()) + len(v.options)
    if isinstance(v, Code):
        return 5 + len(v.code.encode()) + (0 if v.scope is None else 4 + bson_size(v.scope))
    if isinstance(v, DBRef):
        return bson_size({"$ref": v.ref, "$id": v.id} | ({"$db": v.db} if v.db else {}) | v.fields)
    if hasattr(v, "asDict"):
        v = v.asDict()
    return bson_size(v)


def plain(value: Any) -> Any:
    """A value as Spark holds it: wrapper types become their columns' values."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Int32 | Long):
        return int(value)
    if isinstance(value, Double):
        return float(value)
    if isinstance(value, ObjectId | Symbol):
        return str(value)
    if isinstance(value, Timestamp):
        return {"t": value.t, "i": value.i}
    if isinstance(value, Binary):
        return str(uuid.UUID(bytes=value.data)) if value.subtype == 4 and len(value.data) == 16 else {"subType": value.subtype, "data": value.data}
    if isinstance(value, Code):
        return {"code": value.code, "scope": None if value.scope is None else stringify(value.scope)}
    if isinstance(value, DBRef):
        return {"$ref": value.ref, "$id": plain(value.id), "$db": value.db}
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(UTC).replace(tzinfo=None)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value
