"""Predicates against a small matcher of plain Python."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions.scope import Unsupported
from tessera.operators.predicates import compile_query

ROWS = [(i, a, s, arr) for i, (a, s, arr) in enumerate((a, s, arr) for a in (None, 0, 1, 2, 7) for s in (None, "cat", "Cat1", "dog") for arr in (None, [], [1], [1, 2, 7]))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i int, a int, s string, arr array<int>").cache()


def test_value(op, arg, x):
    if op == "$eq":
        return x is None if arg is None else x == arg
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if x is None or isinstance(x, str) != isinstance(arg, str):
            return False
        return {"$gt": x > arg, "$gte": x >= arg, "$lt": x < arg, "$lte": x <= arg}[op]
    if op == "$in":
        return any(test_value("$eq", a, x) for a in arg)
    if op == "$mod":
        return x is not None and x % arg[0] == arg[1]
    if op == "$regex":
        return isinstance(x, str) and bool(re.search(arg, x))
    raise KeyError(op)


test_value.__test__ = False


def holds(field, spec, row):
    x = row[field]
    for op, arg in spec.items():
        if op == "$ne":
            ok = not holds(field, {"$eq": arg}, row)
        elif op == "$nin":
            ok = not holds(field, {"$in": arg}, row)
        elif op == "$not":
            ok = not holds(field, arg, row)
        elif op == "$exists":
            ok = (x is not None) == arg
        elif op == "$size":
            ok = isinstance(x, list) and len(x) == arg
        elif op == "$all":
            ok = isinstance(x, list) and bool(arg) and all(a in x for a in arg)
        elif isinstance(x, list):
            ok = any(test_value(op, arg, e) for e in x)
        else:
            ok = test_value(op, arg, x)
        if not ok:
            return False
    return True


def matches(query, row):
    for key, spec in query.items():
        if key == "$and":
            ok = all(matches(q, row) for q in spec)
        elif key == "$or":
            ok = any(matches(q, row) for q in spec)
        elif key == "$nor":
            ok = not any(matches(q, row) for q in spec)
        else:
            ok = holds(key, spec if isinstance(spec, dict) else {"$eq": spec}, row)
        if not ok:
            return False
    return True


number = st.sampled_from([0, 1, 2, 5, 7])
compare = st.tuples(st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), number).map(lambda p: dict([p]))
member = st.tuples(st.sampled_from(["$in", "$nin"]), st.lists(number, min_size=1, max_size=3)).map(lambda p: dict([p]))
numeric = compare | member | st.just({"$mod": [2, 1]}) | st.booleans().map(lambda b: {"$exists": b})
numeric |= numeric.filter(lambda s: "$exists" not in s).map(lambda s: {"$not": s})
text = st.sampled_from([{"$regex": "^[cC]"}, {"$eq": "cat"}, {"$ne": "cat"}, {"$in": ["cat", "dog"]}, {"$nin": ["dog", None]}, {"$not": {"$regex": "1$"}}, {"$gt": "D"}])
array = st.sampled_from([{"$eq": 1}, {"$gt": 1}, {"$size": 0}, {"$size": 3}, {"$all": [1, 7]}, {"$in": [2, 9]}, {"$ne": 7}, {"$nin": [1]}, {"$not": {"$gt": 1}}])
clause = numeric.map(lambda s: {"a": s}) | text.map(lambda s: {"s": s}) | array.map(lambda s: {"arr": s}) | number.map(lambda n: {"a": n}) | st.just({"a": None})
queries = st.recursive(clause, lambda q: st.tuples(st.sampled_from(["$and", "$or", "$nor"]), st.lists(q, min_size=1, max_size=3)).map(lambda p: dict([p])), max_leaves=5)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(query=queries)
def test_against_the_matcher(frame, query):
    found = {r["i"] for r in frame.where(compile_query(query, frame.schema)).select("i").collect()}
    names = ("i", "a", "s", "arr")
    assert found == {r[0] for r in ROWS if matches(query, dict(zip(names, r, strict=True)))}


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(compile_query({"id": {"$gte": 3, "$lt": 5}, "s": "4"}, df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "EqualTo(s,4)" in plan


def test_other_operators(spark):
    docs = spark.createDataFrame([(1, [(1, "x"), (5, "y")], [3.0, 4.0], 20), (2, [(2, "z")], [50.0, 60.0], 54), (3, None, None, None)], "i int, items array<struct<q:int,n:string>>, at array<double>, bits int")
    ids = lambda q: [r["i"] for r in docs.where(compile_query(q, docs.schema)).orderBy("i").collect()]
    assert ids({"items": {"$elemMatch": {"q": {"$gt": 4}, "n": "y"}}}) == [1] and ids({"items": {"$elemMatch": {"q": 1, "n": "y"}}}) == []
    assert ids({"items.n": "z"}) == [2] and ids({"items.q": {"$in": [5, 2]}}) == [1, 2]
    assert ids({"at": {"$geoWithin": {"$box": [[0, 0], [10, 10]]}}}) == [1]
    assert ids({"at": {"$geoWithin": {"$polygon": [[0, 0], [10, 0], [10, 10]]}}}) == []
    assert ids({"at": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[40, 50], [60, 50], [60, 70], [40, 70], [40, 50]]]}}}}) == [2]
    assert ids({"at": {"$geoIntersects": {"$geometry": {"type": "Point", "coordinates": [3, 4]}}}}) == [1]
    assert ids({"at": {"$near": [0, 0], "$maxDistance": 6}}) == [1] and ids({"at": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [50, 60]}, "$maxDistance": 10}}}) == [2]
    assert ids({"bits": {"$bitsAllSet": [2, 4]}}) == [1, 2] and ids({"bits": {"$bitsAllClear": 1}}) == [1, 2]
    assert ids({"bits": {"$type": "int"}, "missing": {"$exists": False}}) == [1, 2] and ids({"bits": "20"}) == []
    assert ids({"$where": lambda d: d["i"] > 1}) == [2, 3] and ids({"$comment": "x"}) == [1, 2, 3]
    with pytest.raises(Unsupported):
        compile_query({"a": {"$unknown": 1}}, docs.schema)


def test_single_precision_holds_fractions_rounded(spark):
    """0.3 is stored as a little more and 0.35 as a little less; neither lies between the two."""
    docs = spark.createDataFrame([(1, 0.3, [0.3]), (2, 0.35, [0.35]), (3, 0.32, [0.1, 0.32]), (4, None, None), (5, 0.0, []), (6, float("inf"), [0.5])], "i int, x float, arr array<float>")
    ids = lambda q: [r["i"] for r in docs.where(compile_query(q, docs.schema)).orderBy("i").collect()]
    assert ids({"arr": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}}}) == [3] and ids({"x": {"$gt": 0.3, "$lt": 0.35}}) == [3]
    assert ids({"x": {"$gte": 0.3, "$lte": 0.35}}) == [1, 2, 3] and ids({"x": 0.3}) == [1] and ids({"x": {"$in": [0.3, 0.35, 7]}}) == [1, 2]
    assert ids({"x": {"$ne": 0.3}}) == [2, 3, 4, 5, 6] and ids({"x": {"$nin": [0.3]}}) == [2, 3, 4, 5, 6] and ids({"arr": [0.1, 0.32]}) == [3] and ids({"arr": 0.3}) == [1]
    assert ids({"$jsonSchema": {"required": ["x"], "properties": {"x": {"minimum": 0.3, "maximum": 0.35}}}}) == [1, 2, 3]
    assert ids({"x": 1e-300}) == [] and ids({"x": {"$lt": 1e-300}}) == [5] and ids({"x": {"$lt": 1e300}}) == [1, 2, 3, 5]


def test_rows_equally_near_keep_an_order(spark):
    """Keys of 10^8 and more, many on each point: a limit takes those of the smallest keys, from points on all sides."""
    from tessera.plans.pipeline import aggregate

    keys = [10**8 * (1 + i % 7) + i for i in range(400)]
    rows = [(k, [float(49 + k % 3), float(17 + k % 2)], {"m": k}) for k in keys]
    frame = spark.createDataFrame(rows, "k long, at array<double>, m map<string,long>").repartition(7)
    found = [r["k"] for r in aggregate(frame, [{"$match": {"at": {"$near": [50, 18], "$maxDistance": 2}}}, {"$limit": 150}]).collect()]
    assert found == [k for _, k in sorted(((k % 3 - 1) ** 2 + (k % 2 - 1) ** 2, k) for k in keys)][:150]


def test_near_order_agrees_with_its_sql_for_large_keys(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans import catalog

    keys = [k * 15_000 + i for k in range(40) for i in range(1, 700)]
    for t in catalog.TABLES:
        pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(catalog.oracle_sql()["near_order"]).fetchall()
    assert [tuple(r) for r in catalog.queries()["near_order"](spark, str(tmp_path)).collect()] == want
