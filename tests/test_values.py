from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import values as v


def test_numbers():
    assert v.Int32() == 0 and v.Int32("12abc") == 12 and v.Long("123") == 123 and v.number_decimal("1.5") == Decimal("1.5")
    with pytest.raises(OverflowError):
        v.Int32(2**31)
    with pytest.raises(OverflowError):
        v.Long(2**63)


def test_dates():
    assert v.iso_date("2012-12-19") == v.iso_date("20121219T00:00:00Z") == dt.datetime(2012, 12, 19)
    assert v.iso_date("2012-12-19T06:01:17.171+01:30") == dt.datetime(2012, 12, 19, 4, 31, 17, 171000)
    with pytest.raises(ValueError):
        v.iso_date("nonsense")


def test_object_ids():
    assert v.ObjectId("5EBBE8E2905BB493D6981B6B").hex == "5ebbe8e2905bb493d6981b6b"
    assert v.ObjectId() != v.ObjectId() and v.ObjectId(1).hex == "00000001" + "0" * 16
    with pytest.raises(ValueError):
        v.ObjectId("abc")


def test_timestamps():
    assert v.Timestamp.of({"t": 3, "i": 4}) == v.Timestamp(3, 4) == v.Timestamp.of(v.Long(3 << 32 | 4))
    assert v.ts_to_seconds(v.Timestamp(3, 4)) == 3 and v.ts_to_seconds(2**33) == 2


def test_uuids():
    text = "00112233-4455-6677-8899-aabbccddeeff"
    assert v.legacy_uuid(text, "java").data.hex() == "7766554433221100ffeeddccbbaa9988"
    assert v.legacy_uuid(text, "csharp").data.hex() == "33221100554477668899aabbccddeeff"
    assert v.legacy_uuid(text, "python").data.hex() == text.replace("-", "")
    assert repr(v.uuid_of(text)) == f"UUID('{text}')" and repr(v.md5("00" * 16)) == f"MD5('{'00' * 16}')"
    assert "fromInt8Array" in repr(v.Binary(9, bytes([3, 0, 1, 255])))


def test_sizes():
    assert v.bson_size({}) == 5 and v.bson_size({"a": 1}) == 12 and v.bson_size({"a": "x"}) == 14 and v.bson_size({"a": [1]}) == 20


leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text() | st.binary().map(lambda b: v.Binary(0, b))
leaf |= st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)).map(lambda d: d.replace(microsecond=d.microsecond // 1000 * 1000))
names = st.text(st.characters(exclude_characters="$", exclude_categories=["Cs"]), max_size=4)


@settings(deadline=None, max_examples=60, suppress_health_check=[HealthCheck.too_slow])
@given(st.dictionaries(names, st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(names, x, max_size=3), max_leaves=8), max_size=4))
def test_extended_json_round_trip(document):
    assert v.parse(v.stringify(document, relaxed=False)) == document


def test_extended_json_wrappers():
    found = v.parse('{"a":{"$oid":"5ebbe8e2905bb493d6981b6b"},"b":{"$numberLong":"5"},"c":{"$date":"2020-01-01T00:00:00Z"},"d":{"$numberDouble":"Infinity"},"e":{"$regularExpression":{"pattern":"x","options":"i"}}}')
    assert isinstance(found["a"], v.ObjectId) and isinstance(found["b"], v.Long) and found["c"] == dt.datetime(2020, 1, 1)
    assert found["d"] == math.inf and found["e"].java() == "(?i)x"
