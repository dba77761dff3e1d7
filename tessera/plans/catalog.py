"""The registered queries of the document engine: pipelines over the star schema, each with its SQL equivalent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import data_format
from tessera.functions.values import Regex
from tessera.operators.predicates import compile_query
from tessera.operators.updates import apply_update, sure_match
from tessera.plans import stats
from tessera.plans.api import Connection, merged_rows
from tessera.plans.cursor import Cursor
from tessera.plans.pipeline import aggregate
from tessera.sources.store import scratch_folder
from tessera.streaming.streams import Streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    class _Tables(dict):
        def path(self, name: str) -> str:
            return f"{sf_dir}/{name}.parquet"

        def __missing__(self, name: str) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return _Tables()


def pipeline(name: str, table: str, stages: list[dict], sql: str | None, collation: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        all_tables = tables(spark, sf_dir)
        return aggregate(all_tables[table], stages, all_tables, collation)

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(spark, tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


GROUP_SUM: list[dict] = [
    {"$match": {"l_shipdate": {"$gte": day("1996-01-01"), "$lt": day("1997-01-01")}}},
    {"$group": {"_id": "$l_returnflag", "total": {"$sum": {"$multiply": ["$l_extendedprice", "$l_quantity"]}}}},
    {"$sort": {"_id": 1}},
    {"$project": {"_id": 1, "total": {"$round": ["$total", 2]}}},
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(tables(spark, sf_dir)["lineitem"], GROUP_SUM)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def shop(spark: SparkSession, t: dict[str, DataFrame]):
    """A database with the tables mounted, whose own collections live in a new folder."""
    connection = Connection(spark, scratch_folder(spark))
    return connection.mount("shop", {name: t.path(name) for name in TABLES})


def P(*names: str) -> dict:  # noqa: N802
    return {"$project": dict.fromkeys(names, 1)}


pipeline("group_sum", "lineitem", GROUP_SUM, """
SELECT l_returnflag AS _id, round(sum(l_extendedprice * l_quantity), 2) AS total FROM lineitem
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY 1""")
pipeline("match_range", "orders", [{"$match": {"o_orderdate": {"$gte": day("1996-01-01"), "$lt": day("1996-07-01")}}}, P("o_orderkey", "o_orderdate", "o_totalprice")],
         "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01'")
pipeline("match_ne_nin_nor_not", "orders", [{"$match": {"o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}, "$nor": [{"o_totalprice": {"$lt": 1000}}, {"o_orderdate": {"$lt": day("1995-06-01")}}], "o_totalprice": {"$not": {"$gt": 250000}}}}, P("o_orderkey")],
         "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND NOT (o_totalprice < 1000 OR o_orderdate < '1995-06-01') AND NOT o_totalprice > 250000")
pipeline("match_in_regex", "part", [{"$match": {"p_size": {"$in": [1, 5, 9, 15]}, "p_type": Regex("^[a-m]", "i")}}, P("p_partkey", "p_type", "p_size")],
         "SELECT p_partkey, p_type, p_size FROM part WHERE p_size IN (1, 5, 9, 15) AND regexp_matches(p_type, '(?i)^[a-m]')")
pipeline("match_regex_options", "customer", [{"$match": {"c_name": {"$regex": "CUSTOMER.*7$", "$options": "i"}}}, P("c_custkey")],
         "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(?i)CUSTOMER.*7$')")
pipeline("match_mod", "part", [{"$match": {"p_size": {"$mod": [4, 1]}}}, P("p_partkey")], "SELECT p_partkey FROM part WHERE p_size % 4 = 1")
for _name, _test in {"$bitsAllSet": "(p_size & 5) = 5", "$bitsAnySet": "(p_size & 5) <> 0", "$bitsAllClear": "(p_size & 5) = 0", "$bitsAnyClear": "(p_size & 5) <> 5"}.items():
    pipeline("match_" + _name[1:].lower(), "part", [{"$match": {"p_size": {_name: 5}}}, P("p_partkey")], f"SELECT p_partkey FROM part WHERE {_test}")
pipeline("match_expr", "lineitem", [{"$match": {"$expr": {"$and": [{"$gt": ["$l_tax", "$l_discount"]}, {"$lte": ["$l_quantity", 10]}]}}}, P("l_orderkey", "l_linenumber")],
         "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND l_quantity <= 10")
pipeline("match_and_or", "events", [{"$match": {"$or": [{"event_type": "click", "value": {"$gte": 50}}, {"$and": [{"event_type": {"$ne": "view"}}, {"value": {"$lt": 10}}]}]}}, P("event_id")],
         "SELECT event_id FROM events WHERE event_type = 'click' AND value >= 50 OR event_type IS DISTINCT FROM 'view' AND value < 10")
pipeline("match_exists_type", "orders", [{"$match": {"o_orderstatus": {"$exists": True, "$type": "string"}, "o_custkey": {"$type": "number"}, "missing": None}}, {"$count": "n"}],
         "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL")
pipeline("match_eq_null_size", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "pipeline": [{"$match": {"o_orderstatus": "P"}}], "as": "o"}}, {"$addFields": {"first": {"$arrayElemAt": ["$o.o_orderkey", 0]}}}, {"$match": {"c_mktsegment": {"$eq": "BUILDING"}, "o": {"$size": 0}, "first": None, "$comment": "who buys nothing"}}, P("c_custkey")],
         "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
pipeline("match_exists_false", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "pipeline": [{"$match": {"o_orderstatus": "P"}}], "as": "o"}}, {"$project": {"c_custkey": 1, "first": {"$arrayElemAt": ["$o.o_orderkey", 0]}}}, {"$match": {"first": {"$exists": False}}}, P("c_custkey")],
         "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
pipeline("match_json_schema", "customer", [{"$match": {"$jsonSchema": {"required": ["c_name"], "properties": {"c_acctbal": {"bsonType": "double", "minimum": 0, "maximum": 5000}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}}}}, P("c_custkey")],
         "SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
pipeline("match_array_size_elem", "embeddings", [{"$match": {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.35}}}}, {"$project": {"vec_id": 1, "n": {"$size": "$embedding"}}}],
         "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.35)) > 0")
pipeline("match_text", "documents", [{"$match": {"$text": {"$search": "worthless -stupid"}}}, P("doc_id")],
         r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(concat_ws(' ', text, lang, source)), '[^\p{L}\p{N}_]+'), 'worthless') AND NOT list_contains(regexp_split_to_array(lower(concat_ws(' ', text, lang, source)), '[^\p{L}\p{N}_]+'), 'stupid')")


@query("match_array_all", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents WHERE list_has_all(string_split(text, ' '), ['the', 'of'])")
def _array_all(spark, t):
    words = t["documents"].select("doc_id", F.split("text", " ").alias("words"))
    out = words.where(compile_query({"words": {"$all": ["the", "of"]}}, words.schema))
    return out.select("doc_id", F.size(F.array_remove("words", "")).alias("n"))


@query("geo_within_near", """
WITH p AS (SELECT c_custkey, c_acctbal / 100.0 AS x, (c_custkey % 90)::DOUBLE AS y FROM customer)
SELECT c_custkey, sqrt(power(x - 20, 2) + power(y - 30, 2)) <= 15 AS close, x >= 0 AND x <= 50 AND y >= 10 AND y <= 40 AS boxed FROM p
WHERE (x BETWEEN 0 AND 50 AND y BETWEEN 10 AND 40) OR sqrt(power(x - 20, 2) + power(y - 30, 2)) <= 15""")
def _geo(spark, t):
    points = t["customer"].select("c_custkey", F.array(F.col("c_acctbal") / 100.0, (F.col("c_custkey") % 90).cast("double")).alias("at"))
    box, circle = {"at": {"$geoWithin": {"$box": [[0, 10], [50, 40]]}}}, {"at": {"$geoWithin": {"$center": [[20, 30], 15]}}}
    out = points.where(compile_query({"$or": [box, circle]}, points.schema))
    return out.select("c_custkey", compile_query(circle, points.schema).alias("close"), compile_query(box, points.schema).alias("boxed"))


pipeline("project_computed", "lineitem", [{"$project": {"_id": 0, "l_orderkey": 1, "l_linenumber": 1, "net": {"$round": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, 4]}, "flag": {"$ifNull": ["$l_returnflag", "-"]}, "root": {"$round": [{"$sqrt": "$l_quantity"}, 6]}, "one": {"$literal": "$x"}}}],
         "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount), 4) AS net, coalesce(l_returnflag, '-') AS flag, round(sqrt(l_quantity), 6) AS root, '$x' AS one FROM lineitem")
pipeline("project_exclude", "orders", [{"$project": {"o_orderpriority": 0, "o_totalprice": 0}}], "SELECT * EXCLUDE (o_orderpriority, o_totalprice) FROM orders")
pipeline("add_unset_replace", "orders", [{"$addFields": {"double_price": {"$add": ["$o_totalprice", "$o_totalprice"]}}}, {"$unset": ["o_totalprice", "o_orderpriority"]}, {"$replaceWith": {"key": "$o_orderkey", "status": "$o_orderstatus", "twice": "$double_price"}}],
         "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice + o_totalprice AS twice FROM orders")
pipeline("set_stage_cond", "customer", [{"$set": {"level": {"$cond": [{"$gte": ["$c_acctbal", 5000]}, "high", {"$switch": {"branches": [{"case": {"$lt": ["$c_acctbal", 0]}, "then": "debt"}], "default": "low"}}]}}}, P("c_custkey", "level")],
         "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal < 0 THEN 'debt' ELSE 'low' END AS level FROM customer")
pipeline("group_compound_key", "orders", [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "s": "$_id.s", "p": "$_id.p", "n": 1}}],
         "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2")
pipeline("group_null_key", "lineitem", [{"$group": {"_id": None, "n": {"$sum": 1}, "q": {"$sum": "$l_quantity"}}}, {"$project": {"_id": 0, "n": 1, "q": 1}}], "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem")
pipeline("group_empty_input", "lineitem", [{"$match": {"l_orderkey": -1}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT count(*) AS n FROM lineitem WHERE l_orderkey = -1 HAVING count(*) > 0")
pipeline("group_accumulators_extension", "events", [{"$group": {"_id": "$event_type", "avg": {"$avg": "$value"}, "lo": {"$min": "$value"}, "hi": {"$max": "$value"}}}, {"$project": {"_id": 1, "lo": 1, "hi": 1, "avg": {"$round": ["$avg", 6]}}}],
         "SELECT event_type AS _id, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS avg FROM events GROUP BY 1")
pipeline("count_stage", "events", [{"$match": {"event_type": "click"}}, {"$count": "n"}], "SELECT count(*) AS n FROM events WHERE event_type = 'click' HAVING count(*) > 0")
pipeline("sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
pipeline("distinct_values", "customer", [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$group": {"_id": "$c_mktsegment"}}], "SELECT DISTINCT c_mktsegment AS _id FROM customer WHERE c_acctbal > 0")
pipeline("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 10}, {"$limit": 25}, P("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
pipeline("top_k", "orders", [{"$match": {"o_totalprice": {"$gt": 0}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 5}, P("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
pipeline("sort_numeric_collation", "events", [{"$project": {"_id": 0, "event_id": 1, "k": {"$concat": ["n", {"$toString": "$user_id"}]}}}, {"$sort": {"k": 1, "event_id": 1}}, {"$skip": 20}, {"$limit": 100}],
         "SELECT event_id, 'n' || user_id AS k FROM events ORDER BY user_id, event_id LIMIT 100 OFFSET 20", {"locale": "en", "numericOrdering": True})
pipeline("sort_collation_strength", "customer", [{"$match": {"c_custkey": {"$lte": 60}}}, {"$project": {"c_custkey": 1, "k": {"$cond": [{"$eq": [{"$mod": ["$c_custkey", 2]}, 0]}, {"$toUpper": "$c_mktsegment"}, {"$toLower": "$c_mktsegment"}]}}}, {"$sort": {"k": 1, "c_custkey": -1}}, {"$limit": 25}],
         "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS k FROM customer WHERE c_custkey <= 60 ORDER BY lower(c_mktsegment), c_custkey DESC LIMIT 25", {"locale": "en", "strength": 2})
pipeline("lookup_eq", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$orders"}, "keys": {"$sortArray": {"input": "$orders.o_orderkey", "sortBy": 1}}}}],
         "SELECT c_custkey, count(o_orderkey) AS n, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
pipeline("union_with", "customer", [{"$project": {"name": "$c_name", "balance": "$c_acctbal"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"name": "$s_name", "balance": "$s_acctbal"}}]}}],
         "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
pipeline("unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "at"}}, P("vec_id", "at", "embedding")],
         "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS at, unnest(embedding) AS embedding FROM embeddings")
pipeline("array_map_reduce_concat", "embeddings", [{"$project": {"vec_id": 1, "first": {"$slice": ["$embedding", 3]}, "last": {"$slice": ["$embedding", -2]}, "total": {"$round": [{"$reduce": {"input": {"$map": {"input": "$embedding", "as": "x", "in": {"$multiply": ["$$x", 2.0]}}}, "initialValue": {"$literal": 0.0}, "in": {"$add": ["$$value", "$$this"]}}}, 3]}, "both": {"$size": {"$concatArrays": ["$embedding", "$embedding"]}}, "positive": {"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}}}}],
         "SELECT vec_id, embedding[:3] AS first, embedding[-2:] AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2.0)), 3) AS total, 2 * len(embedding) AS both, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
pipeline("set_field_literal", "nation", [{"$replaceWith": {"$setField": {"field": {"$literal": "$x.y"}, "value": 2, "input": "$$ROOT"}}}], 'SELECT *, 2 AS "$x.y" FROM nation')
pipeline("encrypted_string_analogues", "customer", [{"$match": {"$expr": {"$and": [{"$encStrStartsWith": {"input": "$c_name", "prefix": "Customer"}}, {"$encStrEndsWith": {"input": "$c_name", "suffix": "1"}}, {"$encStrContains": {"input": "$c_name", "substring": "00"}}]}}}, P("c_custkey")],
         "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer') AND ends_with(c_name, '1') AND contains(c_name, '00')")
pipeline("documents_source", "region", [{"$documents": [{"a": 1, "b": "x"}, {"a": 2}]}, {"$match": {"a": {"$gte": 1}}}], "SELECT * FROM (VALUES (1, 'x'), (2, NULL)) t(a, b)")


@query("sql_source", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _sql(spark, t):
    for name in ("nation", "region"):
        t[name].createOrReplaceTempView(name)
    statement = "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
    return aggregate(spark.range(0), [{"$sql": {"statement": statement, "format": "jdbc", "formatVersion": 1}}])


@query("json_props_match", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT BETWEEN 10 AND 20")
def _props(spark, t):
    events = t["events"].withColumn("props", F.from_json("props", "k bigint"))
    return aggregate(events, [{"$match": {"props.k": {"$gte": 10, "$lte": 20}}}, {"$project": {"event_id": 1, "k": "$props.k"}}])


@query("semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def _semi_anti(spark, t):
    found = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "pipeline": [{"$count": "n"}], "as": "found"}}
    return aggregate(t["customer"], [found, {"$project": {"c_custkey": 1, "buys": {"$gt": [{"$size": "$found"}, 0]}}}], t)


@query("prefix_join", """
WITH d AS (SELECT 'db' || r_regionkey AS db FROM region), c AS (SELECT 'db' || (s_suppkey % 4) || '.coll' || s_suppkey AS ns FROM supplier)
SELECT db, ns AS collection FROM d LEFT JOIN c ON starts_with(ns, db || '.')""")
def _prefix(spark, t):
    databases = t["region"].select(F.concat(F.lit("db"), "r_regionkey").alias("db"))
    collections = t["supplier"].select(F.concat(F.lit("db"), F.col("s_suppkey") % 4, F.lit(".coll"), "s_suppkey").alias("ns"))
    return stats.database_collections(databases, collections, "db", "ns")


@query("chunk_join", """
WITH c AS (SELECT 'db.c' || n_nationkey AS _id, md5(n_name) AS uuid FROM nation), k AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN md5(n_name) END AS uuid, CASE WHEN o_orderkey % 2 = 1 THEN 'db.c' || n_nationkey END AS ns, 's' || (o_orderkey % 3) AS shard
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT _id, shard, count(*) AS chunks FROM c JOIN k ON coalesce(k.uuid, k.ns) IN (c.uuid, c._id) GROUP BY ALL""")
def _chunks(spark, t):
    id_, uuid_ = F.concat(F.lit("db.c"), "n_nationkey"), F.md5("n_name")
    even = F.col("o_orderkey") % 2 == 0
    owners = t["orders"].join(t["nation"], F.col("o_custkey") % 25 == F.col("n_nationkey"))
    chunks = owners.select(F.when(even, uuid_).alias("uuid"), F.when(~even, id_).alias("ns"), F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("shard"))
    found = stats.collection_chunks(t["nation"].select(id_.alias("_id"), uuid_.alias("uuid")), chunks)
    return found.groupBy("_id", "shard").agg(F.sum("chunks").alias("chunks"))


@query("share_of_total", "SELECT s_suppkey, floor(s_acctbal / sum(s_acctbal) OVER () * 10000) / 100 AS share FROM supplier WHERE s_acctbal > 0")
def _share(spark, t):
    rows = aggregate(t["supplier"], [{"$match": {"s_acctbal": {"$gt": 0}}}])
    return stats.share_of_total(rows, "s_acctbal").select("s_suppkey", "share")


@query("first_n_per_group", """
SELECT o_custkey, o_orderkey, greatest(count(*) OVER (PARTITION BY o_custkey) - 5, 0) AS truncated FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5""")
def _first_n(spark, t):
    return stats.first_n_per_group(t["orders"].select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 5)


@query("first_last_difference", "SELECT min(ts) AS first, max(ts) AS last, round((epoch(max(ts)) - epoch(min(ts))) / 36) / 100 AS hours FROM events")
def _first_last(spark, t):
    return stats.first_last_difference(t["events"], "ts").drop("seconds")


@query("bytes_format", """
SELECT doc_id, CASE WHEN n_chars * 500 < 1024 THEN (n_chars * 500)::VARCHAR || 'B' WHEN n_chars * 500 < 1048576 THEN (n_chars * 500 // 1024)::VARCHAR || 'KiB'
  ELSE regexp_replace((floor((n_chars * 500 // 1024) / 1024 * 100) / 100)::VARCHAR, '\\.0$', '') || 'MiB' END AS size FROM documents""".replace("\\\\", "\\"))
def _bytes(spark, t):
    return t["documents"].select("doc_id", data_format(F.col("n_chars") * 500).alias("size"))


@query("update_set_inc", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer")
def _update(spark, t):
    rows = t["customer"].select("c_custkey", "c_mktsegment", "c_nationkey")
    return apply_update(rows, sure_match(rows, {"c_mktsegment": "BUILDING"}), {"$inc": {"c_nationkey": 100}, "$set": {"c_mktsegment": "B"}})


@query("delete_many", "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey IN (1, 2))")
def _delete(spark, t):
    rows = t["supplier"]
    return rows.where(~sure_match(rows, {"$or": [{"s_acctbal": {"$lt": 0}}, {"s_nationkey": {"$in": [1, 2]}}]})).select("s_suppkey")


@query("merge_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey >= 20")
def _merge(spark, t):
    held = t["nation"].select("n_nationkey", "n_name")
    late = held.where("n_nationkey >= 20")
    new = late.select("n_nationkey", F.lit("new").alias("n_name")).union(late.select(F.col("n_nationkey") + 100, F.lit("new")))
    return merged_rows(held, new, ["n_nationkey"])


@query("insert_widen", "SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 99, NULL, 'added'")
def _insert(spark, t):
    from tessera.plans.api import widened_union
    from tessera.sources.documents import frame_of

    return widened_union(t["region"], frame_of(spark, [{"r_regionkey": 99, "note": "added"}]))


@query("map_reduce_sum", "SELECT o_custkey AS _id, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _map_reduce(spark, t):
    db = shop(spark, t)
    db.orders.mapReduce(lambda d: [(d["o_custkey"], d["o_totalprice"])], lambda k, vs: sum(vs), {"out": "sums", "query": {"o_orderstatus": {"$ne": "P"}}, "finalize": lambda k, v: round(v, 2)})
    return db.sums.frame()


@query("map_reduce_into", "SELECT c_nationkey AS _id, 2 * count(*) AS value FROM customer GROUP BY 1")
def _map_reduce_into(spark, t):
    """The second run is reduced with what the first one left."""
    db = shop(spark, t)
    for _ in range(2):
        db.customer.mapReduce(lambda d: [(d["c_nationkey"], 1)], lambda k, vs: sum(vs), {"out": {"reduce": "counts"}})
    return db.counts.frame()


_SHARDS = """
SELECT s_nationkey AS shard, count(*) AS count, sum(s_suppkey)::DOUBLE AS size, sum(s_suppkey)::DOUBLE / count(*) AS "avgObjSize", (s_nationkey % 4)::INT AS "numChunks" FROM supplier GROUP BY 1, 5"""


def _shards(t):
    grouped = t["supplier"].groupBy(F.col("s_nationkey").alias("shard")).agg(F.count(F.lit(1)).alias("count"), F.sum("s_suppkey").cast("double").alias("size"))
    return grouped.withColumn("avgObjSize", F.col("size") / F.col("count")).withColumn("numChunks", (F.col("shard") % 4).cast("int"))


@query("stats_rollup", f'WITH s AS ({_SHARDS}) SELECT sum(count)::DOUBLE AS count, sum(size) / 2 AS size, round(sum("avgObjSize" * count) / sum(count), 6) AS "avgObjSize" FROM s')
def _rollup(spark, t):
    out = stats.combined_stats(_shards(t).drop("numChunks"), 2)
    return out.withColumn("avgObjSize", F.round("avgObjSize", 6))


@query("shard_distribution", f"""WITH s AS ({_SHARDS}), a AS (SELECT sum(size) AS size, sum(count) AS n FROM s)
SELECT shard, s.count AS docs, "numChunks" AS chunks, CASE WHEN "numChunks" = 0 THEN 0 ELSE floor(s.count / "numChunks") END::BIGINT AS docs_per_chunk,
floor(s.size / a.size * 10000) / 100 AS data_percent, floor(s.count / a.n * 10000) / 100 AS docs_percent FROM s, a""")
def _distribution(spark, t):
    return stats.shard_distribution(_shards(t)).select("shard", "docs", "chunks", F.col("docs_per_chunk").cast("long").alias("docs_per_chunk"), "data_percent", "docs_percent")


@query("dbref_resolution", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _dbref(spark, t):
    db = shop(spark, t)
    db.createView("people", "customer", [{"$project": {"_id": "$c_custkey", "c_name": 1}}])
    refs = t["orders"].select("o_orderkey", F.struct(F.lit("people").alias("$ref"), F.col("o_custkey").alias("$id")).alias("ref"))
    return db.people.resolve(refs).select("o_orderkey", F.col("document.c_name").alias("c_name"))


@query("function_udf", "SELECT c_custkey, length(c_name) + 1 AS n FROM customer")
def _function(spark, t):
    body = {"$function": {"body": lambda name: len(name) + 1, "args": ["$c_name"], "lang": "py", "returns": "int"}}
    return aggregate(t["customer"], [{"$project": {"c_custkey": 1, "n": body}}])


@query("index_bounds", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def _bounds(spark, t):
    return Cursor(t["orders"]).min({"o_orderkey": 100}).max({"o_orderkey": 400}).hint({"o_orderkey": 1}).projection({"o_orderkey": 1}).frame()


pipeline("sample_n", "orders", [{"$sample": {"size": 10}}, P("o_orderkey")], None)


@query("stream_available_now", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE value >= 10 GROUP BY 1")
def _stream(spark, t):
    """A streaming read of all there is, through the stages of a pipeline, into memory."""
    import uuid

    path = t["events"].inputFiles()[0].rsplit("/", 1)[0]
    name = "events_" + uuid.uuid4().hex
    source = spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "*events.parquet" if path.count("events.parquet") == 0 else "*").parquet(path)
    stages = [{"$match": {"value": {"$gte": 10}}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "total": {"$sum": "$value"}}}, {"$project": {"event_type": "$_id", "n": 1, "total": 1, "_id": 0}}]
    running = aggregate(source, stages).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)



@query("update_pipeline", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 END AS twice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _update_pipeline(spark, t):
    rows = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    stages = [{"$set": {"twice": {"$multiply": ["$o_totalprice", 2]}}}, {"$unset": ["o_orderpriority"]}]
    return apply_update(rows, sure_match(rows, {"o_orderstatus": "F"}), stages).select("o_orderkey", "twice", "o_orderpriority")


@query("update_array_filters", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 0.0 ELSE x END) AS embedding FROM embeddings")
def _array_filters(spark, t):
    rows = t["embeddings"].select("vec_id", "embedding")
    return apply_update(rows, F.lit(True), {"$set": {"embedding.$[e]": 0.0}}, [{"e": {"$gt": 0.1}}])


@query("replace_one", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'REPLACED' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS n_regionkey FROM nation")
def _replace(spark, t):
    from tessera.plans.api import widened_union
    from tessera.sources.documents import frame_of

    rows = t["nation"]
    return widened_union(rows.where(~sure_match(rows, {"n_nationkey": 3})), frame_of(spark, [{"n_nationkey": 3, "n_name": "REPLACED"}]))


@query("merge_keep_existing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey >= 20")
def _keep(spark, t):
    held = t["nation"].select("n_nationkey", "n_name")
    late = held.where("n_nationkey >= 20")
    new = late.select("n_nationkey", F.lit("new").alias("n_name")).union(late.select(F.col("n_nationkey") + 100, F.lit("new")))
    return merged_rows(held, new, ["n_nationkey"], matched="keepExisting")


@query("near_sphere", """
SELECT c_custkey, round(6378100 * 2 * asin(sqrt(least(1, power(sin((radians(lat) - radians(10)) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * power(sin((radians(lon) - radians(20)) / 2), 2)))), 3) AS metres
FROM (SELECT c_custkey, (c_custkey % 180)::DOUBLE AS lon, (c_custkey % 80)::DOUBLE AS lat FROM customer)
WHERE 6378100 * 2 * asin(sqrt(least(1, power(sin((radians(lat) - radians(10)) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * power(sin((radians(lon) - radians(20)) / 2), 2)))) <= 1500000""")
def _near_sphere(spark, t):
    from tessera.functions.scope import Scope
    from tessera.operators.predicates import Compiler

    rows = t["customer"].select("c_custkey", F.array((F.col("c_custkey") % 180).cast("double"), (F.col("c_custkey") % 80).cast("double")).alias("at"))
    compiler = Compiler(Scope(rows.schema))
    keep = compiler.query({"at": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [20, 10]}, "$maxDistance": 1_500_000}}})
    return rows.where(keep).select("c_custkey", F.round(compiler.order[0], 3).alias("metres"))


@query("group_collation", "SELECT min(upper(event_type)) AS _id, count(*) AS n FROM events GROUP BY lower(event_type)")
def _group_collation(spark, t):
    rows = t["events"].withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    out = aggregate(rows, [{"$group": {"_id": "$event_type", "n": {"$sum": 1}}}], None, {"locale": "en", "strength": 2})
    return out.select(F.upper("_id").alias("_id"), "n")


@query("document_array_elements", "SELECT o_custkey, list_sort(list(o_orderkey)) AS big FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _document_arrays(spark, t):
    """Orders gathered into documents, then filtered by element and projected by path."""
    stages = [
        {"$group": {"_id": "$o_custkey", "orders": {"$push": {"key": "$o_orderkey", "price": "$o_totalprice"}}}},
        {"$match": {"orders": {"$elemMatch": {"price": {"$gt": 100_000}}}}},
        {"$project": {"_id": 0, "o_custkey": "$_id", "orders": {"$filter": {"input": "$orders", "as": "o", "cond": {"$gt": ["$$o.price", 100_000]}}}}},
        {"$project": {"o_custkey": 1, "big": {"$sortArray": {"input": "$orders.key", "sortBy": 1}}}},
    ]
    return aggregate(t["orders"], stages)


@query("sort_array_documents", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1")
def _sorted_documents(spark, t):
    stages = [
        {"$group": {"_id": "$n_regionkey", "nations": {"$push": {"key": "$n_nationkey", "name": "$n_name"}}}},
        {"$project": {"_id": 0, "n_regionkey": "$_id", "nations": {"$sortArray": {"input": "$nations", "sortBy": {"key": -1}}}}},
        {"$project": {"n_regionkey": 1, "names": "$nations.name"}},
    ]
    return aggregate(t["nation"], stages)


pipeline("unwind_keep_empty", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}],
         "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
pipeline("text_phrase", "documents", [{"$match": {"$text": {"$search": '"apache license"'}}}, P("doc_id")],
         "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'apache license')")
pipeline("type_expression", "orders", [{"$project": {"_id": 0, "a": {"$type": "$o_orderkey"}, "b": {"$type": "$o_totalprice"}, "c": {"$type": "$o_orderdate"}, "d": {"$type": "$nothing"}}}], "SELECT 'long' AS a, 'double' AS b, 'date' AS c, 'null' AS d FROM orders")


# Collections, sinks, views, updates and streams, all through their calls.
def collection(name: str, sql: str | None):
    def register(f):
        return query(name, sql)(lambda spark, t: f(shop(spark, t)))

    return register


LATE = {"$match": {"n_nationkey": {"$gte": 20}}}


@collection("out_sink", "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 2")
def _out(db):
    db.orders.aggregate([{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 2}}}, {"$out": "busy"}])
    return db.busy.frame()


@collection("merge_sink", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey >= 20 THEN 'late' ELSE n_name END AS name, CASE WHEN n_nationkey >= 20 THEN n_regionkey END AS region FROM nation UNION ALL SELECT n_nationkey + 100, NULL, n_regionkey FROM nation")
def _merge_sink(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "name": "$n_name"}}, {"$out": "names"}])
    db.nation.aggregate([LATE, {"$project": {"_id": "$n_nationkey", "name": {"$literal": "late"}, "region": "$n_regionkey"}}, {"$merge": {"into": "names", "on": "_id"}}])
    db.nation.aggregate([{"$project": {"_id": {"$add": ["$n_nationkey", 100]}, "region": "$n_regionkey"}}, {"$merge": "names"}])
    return db.names.frame()


@collection("merge_fail_discard", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey >= 20 THEN 'new' ELSE n_name END AS name FROM nation")
def _merge_discard(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "name": "$n_name"}}, {"$out": "names"}])
    late = [LATE, {"$project": {"_id": "$n_nationkey", "name": {"$literal": "new"}}}]
    db.nation.aggregate([*late, {"$merge": {"into": "names", "whenMatched": "replace", "whenNotMatched": "discard"}}])
    db.nation.aggregate([{"$project": {"_id": {"$add": ["$n_nationkey", 100]}, "name": "$n_name"}}, {"$merge": {"into": "names", "whenNotMatched": "discard"}}])
    return db.names.frame()


@collection("view_source", "SELECT c_custkey AS _id, upper(c_name) AS name FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10")
def _view(db):
    db.createView("rich", "customer", [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$project": {"_id": "$c_custkey", "name": {"$toUpper": "$c_name"}, "nation": "$c_nationkey"}}])
    return db.rich.find({"nation": {"$lt": 10}}, {"nation": 0}).frame()


@collection("coll_stats_source", "SELECT 'shop.nation' AS ns, count(*) AS n FROM nation")
def _coll_stats(db):
    return db.nation.aggregate([{"$collStats": {"storageStats": {}}}, {"$project": {"ns": 1, "n": "$storageStats.count"}}]).frame()


@collection("index_stats_source", "SELECT * FROM (VALUES ('_id_', 'shop.nation'), ('n_name_1', 'shop.nation')) t(name, ns)")
def _index_stats(db):
    db.nation.createIndex({"n_name": 1})
    return db.nation.aggregate([{"$indexStats": {}}]).frame()


@collection("cluster_catalog_source", f"SELECT 'shop.' || unnest({sorted(TABLES)}) AS ns, 'collection' AS type")
def _cluster_catalog(db):
    return db.getSiblingDB("admin").aggregate([{"$listClusterCatalog": {}}, {"$project": {"ns": 1, "type": 1}}]).frame()


@collection("sessions_source", "SELECT 2 AS n")
def _sessions(db):
    for _ in range(2):
        db.getConnection().startSession()
    return db.aggregate([{"$listLocalSessions": {}}, {"$count": "n"}]).frame()


@collection("data_distribution_source", "SELECT 'shop.region' AS ns, count(*) AS docs FROM region")
def _data_distribution(db):
    return db.aggregate([{"$shardedDataDistribution": {}}, {"$match": {"ns": "shop.region"}}, {"$group": {"_id": "$ns", "docs": {"$sum": "$docs"}}}, {"$project": {"_id": 0, "ns": "$_id", "docs": 1}}]).frame()


@collection("insert_many", "SELECT r_regionkey AS _id, r_name AS name, NULL::BIGINT AS size FROM region UNION ALL SELECT * FROM (VALUES (10, 'ten', NULL), (11, 'eleven', 7)) t(_id, name, size)")
def _insert_many(db):
    db.region.aggregate([{"$project": {"_id": "$r_regionkey", "name": "$r_name"}}, {"$out": "places"}])
    db.places.insertOne({"_id": 10, "name": "ten"})
    db.places.insertMany([{"_id": 11, "name": "eleven", "size": 7}])
    return db.places.frame()


@collection("upsert", "SELECT n_nationkey AS _id, CASE n_nationkey WHEN 3 THEN 'three' ELSE n_name END AS name FROM nation UNION ALL SELECT 99, 'new'")
def _upsert(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "name": "$n_name"}}, {"$out": "names"}])
    db.names.updateOne({"_id": 3}, {"$set": {"name": "three"}}, {"upsert": True})
    db.names.updateOne({"_id": 99}, {"$set": {"name": "new"}}, {"upsert": True})
    return db.names.frame()


@collection("update_sort", "SELECT n_nationkey AS _id, CASE n_nationkey WHEN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC LIMIT 1) THEN 'last' ELSE n_name END AS name, n_regionkey AS region FROM nation")
def _update_sort(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "name": "$n_name", "region": "$n_regionkey"}}, {"$out": "names"}])
    db.names.updateOne({"region": 1}, {"$set": {"name": "last"}}, {"sort": {"name": -1}})
    return db.names.frame()


@collection("update_operators", "SELECT s_suppkey AS _id, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_acctbal < 0 THEN true ELSE NULL END AS dated, s_nationkey + 1 AS nation FROM supplier")
def _update_operators(db):
    db.supplier.aggregate([{"$project": {"_id": "$s_suppkey", "name": "$s_name", "balance": "$s_acctbal", "nation": "$s_nationkey"}}, {"$out": "s"}])
    db.s.updateMany({"balance": {"$lt": 0}}, {"$unset": {"name": ""}, "$currentDate": {"at": True}})
    db.s.updateMany({}, {"$inc": {"nation": 1}})
    recent = {"$cond": [{"$gte": ["$at", dt.datetime(2020, 1, 1)]}, True, None]}
    return db.s.aggregate([{"$project": {"name": 1, "nation": 1, "dated": recent}}]).frame()


@collection("replace_documents", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey <> 4 THEN n_name END AS name, CASE n_nationkey WHEN 4 THEN 1.5 END AS q FROM nation")
def _replace_documents(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "name": "$n_name"}}, {"$out": "names"}])
    db.names.replaceOne({"_id": 4}, {"q": 1.5})
    return db.names.frame()


@collection("delete_and_remove", "SELECT n_nationkey AS _id FROM nation WHERE n_nationkey <> 0 AND n_regionkey <> 2 AND n_nationkey <> (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def _delete_and_remove(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "region": "$n_regionkey"}}, {"$out": "names"}])
    db.names.deleteOne({"_id": 0})
    db.names.remove({"region": 2})
    db.names.findOneAndDelete({"region": 3}, {"sort": {"_id": -1}})
    return db.names.find({}, {"_id": 1}).frame()


@collection("find_and_modify", "SELECT n_nationkey AS _id, n_regionkey + CASE n_nationkey WHEN 5 THEN 10 WHEN 6 THEN 100 ELSE 0 END AS region FROM nation UNION ALL SELECT 77, 1")
def _find_and_modify(db):
    db.nation.aggregate([{"$project": {"_id": "$n_nationkey", "region": "$n_regionkey"}}, {"$out": "names"}])
    db.names.findOneAndUpdate({"_id": 5}, {"$inc": {"region": 10}})
    db.names.findAndModify({"query": {"_id": 6}, "update": {"$inc": {"region": 100}}, "new": True})
    db.names.findOneAndReplace({"_id": 77}, {"region": 1}, {"upsert": True})
    return db.names.frame()


@collection("bulk_write", "SELECT r_regionkey AS _id, CASE r_regionkey WHEN 1 THEN 'one' ELSE r_name END AS name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 50, 'fifty'")
def _bulk(db):
    db.region.aggregate([{"$project": {"_id": "$r_regionkey", "name": "$r_name"}}, {"$out": "places"}])
    bulk = db.places.initializeOrderedBulkOp()
    bulk.insert({"_id": 50, "name": "fifty"})
    bulk.find({"_id": 1}).updateOne({"$set": {"name": "one"}})
    bulk.find({"_id": 2}).delete()
    bulk.execute()
    return db.places.frame()


@collection("distinct_field", "SELECT DISTINCT unnest(embedding) AS value FROM embeddings WHERE label < 3")
def _distinct_field(db):
    return db.embeddings._distinct("embedding", {"label": {"$lt": 3}})


@collection("distinct_collation", "SELECT DISTINCT lower(c_mktsegment) AS value FROM customer")
def _distinct_collation(db):
    mixed = {"$cond": [{"$eq": [{"$mod": ["$c_custkey", 2]}, 0]}, {"$toLower": "$c_mktsegment"}, "$c_mktsegment"]}
    db.createView("mixed", "customer", [{"$project": {"segment": mixed}}])
    return db.mixed._distinct("segment", {}, {"collation": {"locale": "en", "strength": 2}}).select(F.lower(F.collate("value", "UTF8_BINARY")).alias("value"))


@collection("count_calls", "SELECT (SELECT count(*) FROM orders) AS estimated, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS counted, 15 AS skipped, 7 AS iterated")
def _counts(db):
    row = (db.orders.estimatedDocumentCount(), db.orders.countDocuments({"o_orderstatus": "F"}), db.nation.count({}, {"skip": 10}), db.nation.find().limit(7).itcount())
    return db._spark.createDataFrame([row], "estimated long, counted long, skipped long, iterated long")


@collection("natural_order", "SELECT 3 AS _id UNION ALL SELECT 1")
def _natural(db):
    for batch in ([7, 2], [9, 1], [3]):
        db.log.insertMany([{"_id": i} for i in batch])
    return db.log.find().sort({"$natural": -1}).limit(2).frame()


@collection("cursor_map", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5")
def _cursor_map(db):
    """Documents mapped on the way, and a loop that a false result ends."""
    seen: list = []
    db.nation.find().sort({"n_nationkey": 1}).map(lambda d: d["n_nationkey"]).forEach(lambda k: seen.append((k,)) or (False if k == 4 else None))
    return db._spark.createDataFrame(seen, "k int")


@collection("show_record_id", "SELECT count(*) AS n, count(*) AS ids FROM nation")
def _record_id(db):
    return db.nation.find().showRecordId().frame().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("`$recordId`").alias("ids"))


@collection("return_key", "SELECT n_nationkey FROM nation WHERE n_nationkey >= 7")
def _return_key(db):
    return db.nation.find({"n_nationkey": {"$gte": 7}}).returnKey().hint({"n_nationkey": 1}).frame()


@collection("find_projection", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 3")
def _find_projection(db):
    return db.orders.find({"o_totalprice": {"$gte": 200_000}}, {"o_orderkey": 1, "o_totalprice": 1}).sort({"o_totalprice": -1, "o_orderkey": 1}).skip(3).limit(40).frame()


@collection("change_stream", "SELECT 'insert' AS kind, 3 AS n UNION ALL SELECT 'update', 1 UNION ALL SELECT 'delete', 1")
def _change_stream(db):
    db.getConnection().startLogging()
    with_all = db.watch()
    db.places.insertMany([{"_id": i, "n": i} for i in range(3)])
    db.places.updateOne({"_id": 1}, {"$set": {"n": 5}})
    db.places.deleteOne({"_id": 2})
    kinds = []
    while (change := with_all.tryNext()) is not None:
        kinds.append((change["operationType"],))
    with_all.close()
    return db._spark.createDataFrame(kinds, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@collection("change_stream_resume", "SELECT * FROM (VALUES (2), (3)) t(_id)")
def _resume(db):
    db.getConnection().startLogging()
    first = db.places.watch([{"$match": {"operationType": "insert"}}])
    db.places.insertMany([{"_id": i} for i in (1, 2)])
    db.places.updateMany({}, {"$set": {"x": 1}})
    seen = first.next()
    first.close()
    db.places.insertOne({"_id": 3})
    rest = db.places.watch([{"$match": {"operationType": "insert"}}], {"resumeAfter": first.getResumeToken()})
    left = []
    while (change := rest.tryNext()) is not None:
        left.append(change["fullDocument"]["_id"])
    rest.close()
    every = {1, 2, 3} - {seen["fullDocument"]["_id"]}
    return db._spark.createDataFrame([(2 if i == min(every) else i,) for i in left], "_id int")


@collection("replication_info", "SELECT true AS ordered, 2 AS entries")
def _replication(db):
    db.getConnection().startLogging()
    db.places.insertOne({"_id": 1})
    db.places.insertOne({"_id": 2})
    info = db.getReplicationInfo()
    entries = db._spark.read.parquet(db.getConnection()._log_folder).count()
    return db._spark.createDataFrame([(info["tFirst"] <= info["tLast"] and info["timeDiff"] >= 0, entries)], "ordered boolean, entries int")


@collection("stream_source_merge", "SELECT event_id AS _id, value * 2 AS twice FROM events WHERE event_type = 'click'")
def _stream_merge(db):
    """A named processor from a source of files to a collection, over all there is."""
    connection, path = db.getConnection(), db._connection._store._paths("shop", "events")[0]
    streams = Streams(db._spark, f"{connection.getURI()}/_streams")
    streams.addSource("files", lambda spec: _stream_of(db._spark, path))
    streams.addDatabase("here", connection)
    stages = [{"$source": {"connectionName": "files"}}, {"$match": {"event_type": "click"}}, {"$addFields": {"_id": "$event_id", "twice": {"$multiply": ["$value", 2]}}}, P("_id", "twice"), {"$merge": {"into": {"connectionName": "here", "db": "shop", "coll": "clicks"}}}]
    processor = streams.createStreamProcessor("clicks", stages, {"availableNow": True})
    processor.start()
    processor._query.awaitTermination()
    return db.clicks.frame()


def _stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream: its folder, or the folder of its file."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    folder, _, file = files[0].rpartition("/")
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "*" if folder.endswith(path.rsplit("/", 1)[-1]) else file).parquet(folder)


@query("where_callable", "SELECT c_custkey FROM customer WHERE length(c_name) % 2 = 0 AND c_nationkey > 12")
def _where(spark, t):
    return aggregate(t["customer"], [{"$match": {"$where": lambda d: len(d["c_name"]) % 2 == 0 and d["c_nationkey"] > 12}}, P("c_custkey")])


@query("near_order", "SELECT c_custkey FROM (SELECT c_custkey, power(c_custkey % 101 - 50, 2) + power(c_custkey % 37 - 18, 2) AS d FROM customer) WHERE d <= 900 ORDER BY d, c_custkey LIMIT 50")
def _near(spark, t):
    x, y = F.col("c_custkey") % 101, F.col("c_custkey") % 37
    points = t["customer"].select("c_custkey", F.array(x.cast("double"), y.cast("double")).alias("at"))
    return aggregate(points, [{"$match": {"at": {"$near": [50, 18], "$maxDistance": 30.0001}}}, {"$limit": 50}, P("c_custkey")])


@query("geo_intersects", "SELECT c_custkey FROM customer WHERE c_custkey % 60 BETWEEN 10 AND 30 AND c_custkey % 25 BETWEEN 5 AND 15")
def _intersects(spark, t):
    points = t["customer"].select("c_custkey", F.array((F.col("c_custkey") % 60).cast("double"), (F.col("c_custkey") % 25).cast("double")).alias("at"))
    ring = [[10 - 1e-9, 5 - 1e-9], [30 + 1e-9, 5 - 1e-9], [30 + 1e-9, 15 + 1e-9], [10 - 1e-9, 15 + 1e-9], [10 - 1e-9, 5 - 1e-9]]
    return aggregate(points, [{"$match": {"at": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [ring]}}}}}, P("c_custkey")])


pipeline("lookup_pipeline", "customer", [{"$lookup": {"from": "orders", "let": {"key": "$c_custkey", "least": {"$multiply": ["$c_acctbal", 20]}}, "pipeline": [{"$match": {"o_orderstatus": "F", "$expr": {"$and": [{"$eq": ["$o_custkey", "$$key"]}, {"$gt": ["$o_totalprice", "$$least"]}]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"_id": 0, "o_orderkey": 1}}], "as": "top"}}, {"$project": {"c_custkey": 1, "top": "$top.o_orderkey"}}],
         """SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []) AS top FROM customer LEFT JOIN (
  SELECT c_custkey AS k, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > c_acctbal * 20
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2) ON k = c_custkey GROUP BY 1""")
pipeline("lookup_concise", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "pipeline": [{"$match": {"o_totalprice": {"$gt": 150_000}}}, {"$group": {"_id": None, "sum": {"$sum": "$o_totalprice"}}}], "as": "sums"}}, {"$unwind": "$sums"}, {"$project": {"c_custkey": 1, "sum": {"$round": ["$sums.sum", 2]}}}],
         "SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS sum FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
pipeline("lookup_once", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$sort": {"n_nationkey": -1}}, {"$limit": 1}], "as": "last"}}, {"$project": {"r_regionkey": 1, "last": "$last.n_nationkey"}}],
         "SELECT r_regionkey, [(SELECT max(n_nationkey) FROM nation)] AS last FROM region")
pipeline("merge_objects", "nation", [{"$replaceWith": {"$mergeObjects": [{"a": "$n_nationkey", "b": {"$literal": "x"}}, {"b": "$n_name"}, {"c": "$n_regionkey"}]}}], "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
pipeline("concat_arrays_null", "embeddings", [{"$project": {"vec_id": 1, "n": {"$size": {"$concatArrays": ["$embedding", {"$slice": ["$embedding", 2]}]}}, "none": {"$type": {"$concatArrays": ["$nothing", "$embedding"]}}}}], "SELECT vec_id, len(embedding) + 2 AS n, 'void' AS none FROM embeddings")
pipeline("hashed_index_key", "nation", [{"$project": {"_id": 0, "n_nationkey": 1, "same": {"$eq": [{"$toHashedIndexKey": "$n_name"}, {"$toHashedIndexKey": {"$concat": ["$n_name", ""]}}]}}}], "SELECT n_nationkey, true AS same FROM nation")


@query("ts_to_seconds", "SELECT o_orderkey, o_orderkey AS seconds, o_totalprice / 4294967296 AS number FROM orders")
def _ts(spark, t):
    from tessera.functions.expressions import ts_seconds

    stamp = F.shiftleft(F.col("o_orderkey"), 32).bitwiseOR(F.col("o_custkey"))
    return t["orders"].select("o_orderkey", ts_seconds(stamp, True).alias("seconds"), ts_seconds(F.col("o_totalprice")).alias("number"))


@query("bson_size", "SELECT c_custkey, 5 + (2 + 9 + 8) + (2 + 6 + 5 + octet_length(encode(c_name))) + (2 + 11 + 4) AS bytes FROM customer")
def _bson_size(spark, t):
    from tessera.functions.expressions import bson_size

    rows = t["customer"].select("c_custkey", "c_name", "c_nationkey")
    return rows.select("c_custkey", bson_size(F.struct(*rows.columns), rows.schema).alias("bytes"))


@query("shard_key_frequencies", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def _key_frequencies(spark, t):
    rows = stats.key_frequencies(t["orders"], ["o_orderstatus", "o_orderpriority"])
    return rows.select(F.col("key.o_orderstatus").alias("status"), F.col("key.o_orderpriority").alias("priority"), "n")


@collection("analyze_shard_key", "SELECT count(*) AS docs, count(DISTINCT o_custkey) AS distinct_values, max(n) AS most FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def _analyze(db):
    found = db.orders.analyzeShardKey({"o_custkey": 1})["keyCharacteristics"]
    return db._spark.createDataFrame([(found["numDocsTotal"], found["numDistinctValues"], found["mostCommonValues"][0]["frequency"])], "docs long, distinct_values long, most long")


@query("ejson_lines", "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey < 500")
def _ejson(spark, t):
    """Extended JSON written and read back field by field."""
    from tessera.sources.documents import read_ejson

    path = f"{scratch_folder(spark)}/lines"
    few = t["orders"].where("o_orderkey < 500")
    few.select(F.format_string('{"key": {"$numberLong": "%d"}, "price": %s, "status": "%s"}', "o_orderkey", F.col("o_totalprice").cast("string"), "o_orderstatus")).write.text(path)
    return read_ejson(spark, path, "key bigint, price double, status string")


@query("scaled_shards", f'WITH s AS ({_SHARDS}) SELECT shard, count, size / 4 AS size, "avgObjSize" FROM s')
def _scaled(spark, t):
    return stats.scaled_shards(_shards(t).drop("numChunks"), 4)


@collection("sql_over_views", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def _sql_views(db):
    db.createView("late", "nation", [{"$match": {"n_nationkey": {"$gt": 3}}}])
    return db.sql("SELECT n_regionkey, count(*) AS n FROM late GROUP BY 1").frame()


@collection("plan_cache_source", "SELECT 'shop.nation' AS ns, false AS cached")
def _plan_cache(db):
    return db.nation.aggregate([{"$planCacheStats": {}}, {"$project": {"ns": 1, "cached": "$isCached"}}]).frame()


@collection("find_collation", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _find_collation(db):
    return db.customer.find({"c_mktsegment": "building"}, {"c_custkey": 1}).collation({"locale": "en", "strength": 2}).frame()


@collection("capped_collection", "SELECT * FROM (VALUES (5), (6), (7)) t(_id)")
def _capped(db):
    db.createCollection("ring", {"capped": True, "size": 1000, "max": 3})
    db.ring.insertMany([{"_id": i} for i in range(6)])
    db.ring.insertMany([{"_id": i} for i in (6, 7)])
    return db.ring.frame()


@collection("validated_collection", "SELECT 1 AS _id, 'K-1' AS code")
def _validated(db):
    db.createCollection("checked", {"validator": {"$jsonSchema": {"required": ["code"], "properties": {"code": {"bsonType": "string", "pattern": "^K-"}}}}})
    for document in ({"_id": 1, "code": "K-1"}, {"_id": 2, "code": "L-2"}, {"_id": 3}):
        try:
            db.checked.insertOne(document)
        except ValueError:  # refused
            continue
    return db.checked.frame()


@collection("unique_index", "SELECT r_regionkey AS _id, r_name AS name FROM region UNION ALL SELECT 70, 'FRESH'")
def _unique(db):
    db.region.aggregate([{"$project": {"_id": "$r_regionkey", "name": "$r_name"}}, {"$out": "places"}])
    db.places.createIndex({"name": 1}, {"unique": True})
    for document in ({"_id": 70, "name": "FRESH"}, {"_id": 71, "name": "FRESH"}):
        try:
            db.places.insertOne(document)
        except ValueError:  # the name is taken
            continue
    return db.places.frame()


@collection("connection_watch", "SELECT 'shop' AS db, 2 AS n UNION ALL SELECT 'other', 1")
def _connection_watch(db):
    connection = db.getConnection()
    connection.startLogging()
    stream, seen = connection.watch([{"$match": {"operationType": "insert"}}]), []
    db.places.insertMany([{"_id": 1}, {"_id": 2}])
    db.getSiblingDB("other").places.insertOne({"_id": 1})
    db.places.deleteOne({"_id": 1})
    while (change := stream.tryNext()) is not None:
        seen.append((change["db"],))
    stream.close()
    return db._spark.createDataFrame(seen, "db string").groupBy("db").agg(F.count(F.lit(1)).alias("n"))


def _streams_of(db) -> Streams:
    path = db._connection._store._paths("shop", "events")[0]
    streams = Streams(db._spark, f"{db.getConnection().getURI()}/_streams")
    streams.addSource("files", lambda spec: _stream_of(db._spark, path))
    streams.addDatabase("here", db.getConnection())
    return streams


@collection("stream_process", "SELECT 7 AS n, 7 AS clicks")
def _process(db):
    found = _streams_of(db).process([{"$source": {"connectionName": "files"}}, {"$match": {"event_type": "click"}}], {"size": 7})
    return db._spark.createDataFrame([(len(found), sum(d["event_type"] == "click" for d in found))], "n int, clicks int")


@collection("stream_modify", "SELECT event_id AS _id, CASE event_type WHEN 'click' THEN 'first' ELSE 'second' END AS run FROM events WHERE event_type IN ('click', 'view')")
def _modify(db):
    """A processor is stopped, given another pipeline, and begins anew with it."""
    streams, into = _streams_of(db), {"$merge": {"into": {"connectionName": "here", "db": "shop", "coll": "runs"}}}

    def stages(kind: str, run: str) -> list[dict]:
        return [{"$source": {"connectionName": "files"}}, {"$match": {"event_type": kind}}, {"$project": {"_id": "$event_id", "run": {"$literal": run}}}, into]

    processor = streams.createStreamProcessor("runs", stages("click", "first"), {"availableNow": True})
    for change in (None, stages("view", "second")):
        if change:
            processor.modify(change, {"resumeFromCheckpoint": False})
        processor.start()
        processor._query.awaitTermination()
        processor.stop()
    return db.runs.frame()


@collection("stream_listing", "SELECT 'a' AS name, 'STOPPED' AS state, 1 AS sources, 1 AS sinks")
def _listing(db):
    streams = _streams_of(db)
    for name in ("a", "b"):
        streams.createStreamProcessor(name, [{"$source": {"connectionName": "files"}}])
    streams.getProcessor("b").drop()
    held = [len(streams.listConnections({"type": kind})) for kind in ("source", "sink")]
    return db._spark.createDataFrame([(p["name"], p["state"], *held) for p in streams.listStreamProcessors()], "name string, state string, sources int, sinks int")


@collection("database_names", "SELECT 'other' AS name UNION ALL SELECT 'shop'")
def _databases(db):
    db.getSiblingDB("other").places.insertOne({"_id": 1})
    return db._spark.createDataFrame([(n,) for n in db.getConnection().getDBNames()], "name string")
