"""Scenarios of reading and writing collections."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from tessera.functions.scope import Unsupported
from tessera.functions.values import ObjectId, Regex
from tessera.plans.api import Connection, find_and_modify_options, remove_options


@pytest.fixture()
def db(spark, tmp_path):
    return Connection(spark, str(tmp_path / "data")).getDB("test")


def ids(cursor):
    return [d["_id"] for d in cursor]


@pytest.fixture()
def coll(db):
    db.coll.insertMany([{"_id": 1, "name": "willow", "a": 1}, {"_id": 2, "name": "oak", "a": 2}, {"_id": 3, "name": "birch", "a": 3}])
    return db.coll


def test_find(coll):
    assert ids(coll.find().sort({"name": 1})) == [3, 2, 1] and ids(coll.find().sort({"name": -1}).limit(2)) == [1, 2]
    assert ids(coll.find().sort({"_id": 1}).limit(1).skip(1)) == [2]  # skip comes before limit
    assert ids(coll.find().max({"_id": 2}).hint({"_id": 1})) == [1] and ids(coll.find().min({"_id": 2}).sort({"_id": 1})) == [2, 3]
    assert coll.find({}, {"_id": 0, "name": 1}).sort({"_id": 1}).toArray()[0] == {"name": "willow"}
    assert coll.find().limit(1).count() == 1 and coll.count({"a": {"$gt": 1}}) == 2 and coll.countDocuments({}, {"skip": 1}) == 2
    assert coll.findOne({"name": Regex("^OA", "i")})["_id"] == 2 and coll.findOne({"a": 9}) is None
    assert coll.estimatedDocumentCount() == 3 and coll.find().itcount() == 3 and coll.find().size() == 3
    with pytest.raises(ValueError):
        coll.count({}, {"unknownOption": 1})
    with pytest.raises(Unsupported):
        coll.find().addOption(4)


def test_cursor_iteration(coll):
    cursor = coll.find().sort({"_id": 1}).map(lambda d: d["a"])
    assert cursor.hasNext() and cursor.next() == 1 and cursor.objsLeftInBatch() == 0 and cursor.tryNext() == 2 and cursor.toArray() == [3]
    assert cursor.tryNext() is None and cursor.isExhausted() and not cursor.isClosed()
    seen = []
    coll.find().sort({"_id": 1}).forEach(lambda d: seen.append(d["_id"]) or (False if d["_id"] == 2 else None))
    assert seen == [1, 2]
    page = coll.find().batchSize(2).it()
    assert len(page.documents) == 2 and page.cursorHasMore
    stored = ids(coll.find().sort({"$natural": 1}))
    assert sorted(stored) == [1, 2, 3] and ids(coll.find().sort({"$natural": -1})) == stored[::-1] and "$recordId" in coll.find().showRecordId().next()
    assert coll.find().sort({"_id": 1}).returnKey().hint({"_id": 1}).next() == {"_id": 1}


def test_aggregate(db):
    rows = [("open", 5, "bay 9"), ("open", 7, "bay 9"), ("open", 4, "bay 30"), ("shut", 8, "bay 30")]
    db.coll.insertMany([{"status": status, "amount": amount, "group": group} for status, amount, group in rows])
    stages = [{"$match": {"status": "open"}}, {"$group": {"_id": "$group", "total": {"$sum": "$amount"}}}, {"$sort": {"_id": 1}}]
    assert db.coll.aggregate(stages).toArray() == [{"_id": "bay 30", "total": 4}, {"_id": "bay 9", "total": 12}]
    assert db.coll.aggregate(*stages).itcount() == 2
    assert ids(db.coll.aggregate(stages, {"collation": {"locale": "en", "numericOrdering": True}})) == ["bay 9", "bay 30"]
    assert db.coll.aggregate([{"$match": {"status": "lost"}}, {"$count": "n"}]).toArray() == []
    assert db.coll.aggregate([{"$count": "n"}]).toArray() == [{"n": 4}]
    db.coll.aggregate([*stages, {"$out": "sums"}])
    assert db.sums.countDocuments() == 2
    db.coll.aggregate([{"$group": {"_id": "$group", "n": {"$sum": 1}}}, {"$merge": {"into": "sums", "on": "_id"}}])
    assert db.sums.findOne({"_id": "bay 30"}) == {"_id": "bay 30", "total": 4, "n": 2}
    assert "queryPlanner" in db.coll.aggregate(stages, {"explain": True}) and db.coll.explain("executionStats").find({"status": "open"}).finish()["executionStats"]["nReturned"] == 3
    assert db.aggregate([{"$documents": [{"x": [1, 2, 3]}]}, {"$unwind": "$x"}, {"$limit": 2}]).itcount() == 2
    assert db.sql("SELECT count(*) AS n FROM coll").toArray() == [{"n": 4}]
    with pytest.raises(Unsupported):
        db.coll.aggregate([{"$noSuchStage": {}}])
    with pytest.raises(ValueError):
        db.coll.aggregate([{"$out": "x"}, {"$match": {}}])


def test_distinct(db):
    db.coll.insertMany([
        {"n": 4, "word": "sand", "any": 10, "place": "Málaga", "tags": ["q", "r"]},
        {"n": 5, "word": "clay", "any": "ten", "place": "Malaga", "tags": ["r"]},
        {"n": 6, "word": "sand", "any": 20, "place": "MALAGA", "extra": 8},
    ])
    assert db.coll.distinct("n") == [4, 5, 6] and db.coll.distinct("word") == ["clay", "sand"] and db.coll.distinct("extra") == [8]
    assert db.coll.distinct("any") == [10, 20, "ten"] and db.coll.distinct("word", {"n": 4}) == ["sand"] and db.coll.distinct("tags") == ["q", "r"]
    assert len(db.coll.distinct("place", {}, {"collation": {"locale": "es", "strength": 1}})) == 1
    assert db.coll.countDocuments({"any": {"$gte": 20}}) == 1 and db.coll.countDocuments({"any": "ten"}) == 1 and db.coll.countDocuments({"any": {"$type": "string"}}) == 1
    assert [d["n"] for d in db.coll.find().sort({"any": 1})] == [4, 6, 5]
    assert len(db.coll.aggregate([{"$group": {"_id": "$any", "n": {"$sum": 1}}}]).toArray()) == 3


def test_insert(db):
    found = db.coll.insertOne({"a": 1})
    assert found.acknowledged and isinstance(found.insertedId, ObjectId)
    assert db.coll.insertMany([{"_id": "x", "b": [1]}, {"_id": "y", "c": {"d": dt.datetime(2020, 1, 1)}}]).insertedIds == ["x", "y"]
    assert db.coll.findOne({"_id": "y"}) == {"_id": "y", "c": {"d": dt.datetime(2020, 1, 1)}} and db.coll.find({"c.d": {"$lt": dt.datetime(2021, 1, 1)}}).itcount() == 1
    with pytest.raises(ValueError):
        db.coll.insertOne({"_id": "x"})
    with pytest.raises(ValueError):
        db.getCollection("a$b")


def test_update(coll):
    result = coll.updateOne({"a": {"$gte": 2}}, {"$set": {"name": "new", "x": 5}, "$inc": {"a": 10}}, {"sort": {"a": -1}})
    assert (result.matchedCount, result.modifiedCount, result.upsertedCount) == (1, 1, 0) and coll.findOne({"_id": 3}) == {"_id": 3, "name": "new", "a": 13, "x": 5}
    assert coll.updateMany({}, {"$inc": {"y": 1}}).modifiedCount == 3 and coll.updateMany({}, {"$set": {"y": 1}}).modifiedCount == 0
    assert coll.updateMany({"_id": {"$lt": 3}}, {"$unset": {"y": ""}}).matchedCount == 2 and coll.count({"y": {"$exists": True}}) == 1
    coll.updateMany({"_id": 1}, [{"$set": {"z": {"$add": ["$a", 100]}}}, {"$unset": ["name"]}])
    assert coll.findOne({"_id": 1})["z"] == 101 and "name" not in coll.findOne({"_id": 1})
    up = coll.updateOne({"_id": 9, "name": "u"}, {"$set": {"a": 1}}, {"upsert": True})
    assert up.upsertedCount == 1 and up.insertedId == 9 and coll.findOne({"_id": 9}) == {"_id": 9, "name": "u", "a": 1}
    assert coll.replaceOne({"_id": 9}, {"q": 1}).modifiedCount == 1 and coll.findOne({"_id": 9}) == {"_id": 9, "q": 1}
    for bad in (lambda: coll.updateOne({}, {"a": 1}), lambda: coll.replaceOne({}, {"$set": {"a": 1}}), lambda: coll.updateOne({}, {"$inc": {"$x.y": 1}})):
        with pytest.raises(ValueError):
            bad()


def test_array_filters_and_nested_fields(db):
    db.coll.insertMany([{"_id": 1, "grades": [1, 6, 9], "items": [{"q": 1, "p": 2}, {"q": 5, "p": 3}], "sub": {"x": 1}}])
    db.coll.updateMany({}, {"$set": {"grades.$[g]": 0, "items.$[i].p": 99, "sub.x": 7}}, {"arrayFilters": [{"g": {"$gte": 6}}, {"i.q": {"$gt": 3}}]})
    assert db.coll.findOne() == {"_id": 1, "grades": [1, 0, 0], "items": [{"q": 1, "p": 2}, {"q": 5, "p": 99}], "sub": {"x": 7}}
    db.coll.updateMany({}, {"$inc": {"grades.$[]": 1}, "$set": {"sub.y": "new"}, "$currentDate": {"at": True}})
    found = db.coll.findOne()
    assert found["grades"] == [2, 1, 1] and found["sub"] == {"x": 7, "y": "new"} and isinstance(found["at"], dt.datetime)


def test_delete(coll):
    assert coll.deleteOne({"a": 1}).deletedCount == 1 and coll.deleteMany({"a": {"$gt": 2}}).deletedCount == 1 and coll.remove({}, True).deletedCount == 1
    assert coll.deleteMany({}).deletedCount == 0 and coll.count() == 0


def test_find_and_modify(coll):
    assert coll.findOneAndUpdate({"_id": 1}, {"$inc": {"a": 5}})["a"] == 1 and coll.findOneAndUpdate({"_id": 1}, {"$inc": {"a": 5}}, {"returnDocument": "after"})["a"] == 11
    assert coll.findOneAndReplace({"_id": 2}, {"b": 1}, {"returnNewDocument": True}) == {"_id": 2, "b": 1}
    assert coll.findOneAndDelete({}, {"sort": {"_id": -1}, "projection": {"name": 1, "_id": 0}}) == {"name": "birch"} and coll.count() == 2
    assert coll.findAndModify({"query": {"_id": 7}, "update": {"$set": {"a": 1}}, "upsert": True, "new": True}) == {"_id": 7, "a": 1}
    assert coll.findAndModify({"query": {"_id": 7}, "remove": True})["_id"] == 7
    assert find_and_modify_options({}) == {"returnDocument": "before"} and find_and_modify_options({"new": True}) == {"returnDocument": "after"}
    assert find_and_modify_options({"returnOriginal": False, "returnNewDocument": False}) == {"returnDocument": "after"}
    assert remove_options(True) == {"justOne": True} and remove_options({}) == {"justOne": False}


def test_bulk(db):
    db.coll.insertMany([{"_id": i, "v": v} for i, v in enumerate(["a", "b", "c", "d"])])
    bulk = db.coll.initializeOrderedBulkOp()
    bulk.insert({"_id": 10, "v": "x"})
    bulk.find({"v": "a"}).update({"$set": {"v": "aa"}})
    bulk.find({"v": "b"}).deleteOne()
    bulk.find({"_id": 11}).upsert().replaceOne({"v": "up"})
    bulk.find({}).updateOne({"$set": {"v": "first"}})
    assert len(bulk.getOperations()) == 5
    result = bulk.execute()
    assert (result.insertedCount, result.deletedCount, result.upsertedCount, result.matchedCount) == (1, 1, 1, 2) and db.coll.count() == 5
    with pytest.raises(RuntimeError):
        bulk.execute()
    assert db.getConnection().bulkWrite([{"namespace": "test.other", "name": "insertOne", "document": {"_id": 1}}]).insertedCount == 1


def test_views_and_collections(db):
    db.survey.insertMany([{"_id": 1, "site": "north", "depth": {"spring": 12, "autumn": 7}, "crew": "X"}, {"_id": 2, "site": "south", "depth": {"spring": 9, "autumn": 8}, "crew": "Y"}])
    db.createView("springs", "survey", [{"$project": {"spring": "$depth.spring", "crew": 1}}])
    assert db.springs.find().sort({"_id": 1}).toArray() == [{"_id": 1, "spring": 12, "crew": "X"}, {"_id": 2, "spring": 9, "crew": "Y"}]
    assert db.getCollectionNames() == ["springs", "survey"] and [i["name"] for i in db.getCollectionInfos({"type": "view"})] == ["springs"]
    assert db.survey.find({}, {"depth.spring": 1}).sort({"_id": 1}).toArray()[0] == {"_id": 1, "depth": {"spring": 12}}
    assert db.survey.find({}, {"depth.spring": 0, "_id": 0}).sort({"crew": 1}).toArray()[0] == {"site": "north", "depth": {"autumn": 7}, "crew": "X"}
    db.survey.renameCollection("renamed")
    assert db.renamed.count() == 2 and db.survey.count() == 0 and db.renamed.drop() and db.springs.drop() and db.getCollectionNames() == []
    db.createCollection("ring", {"capped": True, "size": 1000, "max": 2})
    db.ring.insertMany([{"_id": i} for i in range(5)])
    assert db.ring.isCapped() and sorted(ids(db.ring.find())) == [3, 4]
    db.createCollection("checked", {"validator": {"$and": [{"size": {"$type": "string"}}, {"code": Regex("^K-")}]}})
    with pytest.raises(ValueError):
        db.checked.insertOne({"size": "1", "code": "L-7"})
    db.checked.insertOne({"size": "1", "code": "K-7"})
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)  # noqa: UP017
    db.createCollection("series", {"timeseries": {"timeField": "at", "metaField": "m"}, "expireAfterSeconds": 3600})
    db.series.insertMany([{"at": now, "m": 1}, {"at": now - dt.timedelta(days=1), "m": 2}])
    assert db.series.countDocuments() == 1
    assert db.dropDatabase()["ok"] == 1


def test_indexes_stats_and_commands(coll, db):
    assert coll.createIndex({"a": 1}, {"unique": True}) == "a_1" and coll.getIndexKeys() == [{"_id": 1}, {"a": 1}]
    with pytest.raises(ValueError):
        coll.insertOne({"a": 1})
    coll.hideIndex("a_1")
    assert coll.getIndexes()[1]["hidden"] and coll.dropIndex("a_1")["ok"] == 1
    stats = coll.stats({"scale": 2})
    assert stats["count"] == 3 and stats["size"] * 2 == coll.dataSize() and db.stats()["objects"] == 3 and coll.validate()["valid"]
    assert sum(r["docs"] for r in coll.getShardDistribution()) == 3
    assert coll.aggregate([{"$collStats": {"storageStats": {}}}, {"$project": {"n": "$storageStats.count"}}]).toArray() == [{"n": 3}]
    assert db.runCommand({"count": "coll", "query": {"a": 1}})["n"] == 1 and db.runCommand("ping") == {"ok": 1}
    assert db.adminCommand({"listDatabases": 1})["databases"] == [{"name": "test"}]
    assert db.getConnection().convertShardKeyToHashed({"a": 1}) == db.getConnection().convertShardKeyToHashed({"a": 1})
    for call in (lambda: db.createUser({}), lambda: db.runCommand({"noSuch": 1}), lambda: coll.getShardVersion()):
        with pytest.raises(Unsupported):
            call()


def test_lookup_and_union(db):
    db.coll1.insertMany([{"_id": 1, "phone": "1", "key": "a"}, {"_id": 2, "phone": "2", "key": "b"}])
    db.coll2.insertMany([{"_id": 1, "phone": "1", "key": "x"}, {"_id": 2, "phone": "1", "key": "y"}])
    found = db.coll1.aggregate([{"$lookup": {"from": "coll2", "localField": "phone", "foreignField": "phone", "as": "docs"}}, {"$sort": {"_id": 1}}]).toArray()
    assert [len(d["docs"]) for d in found] == [2, 0] and {d["key"] for d in found[0]["docs"]} == {"x", "y"}
    assert db.coll1.aggregate([{"$unionWith": "coll2"}]).itcount() == 4


def test_map_reduce(db):
    db.orders.insertMany([{"_id": 1, "cust": "ada", "price": 4}, {"_id": 2, "cust": "ada", "price": 6}, {"_id": 3, "cust": "ben", "price": 9}])
    pairs = lambda d: [(d["cust"], d["price"])]
    total = lambda k, vs: sum(vs)
    assert db.orders.mapReduce(pairs, total, {"out": {"inline": 1}}) == [{"_id": "ada", "value": 10}, {"_id": "ben", "value": 9}]
    assert db.orders.mapReduce(pairs, total, {"out": "sums", "query": {"cust": "ada"}}).value["result"] == "sums"
    assert db.sums.find().toArray() == [{"_id": "ada", "value": 10}]
    db.orders.mapReduce(pairs, total, {"out": {"reduce": "sums"}, "finalize": lambda k, v: v + 1})
    assert db.sums.find().sort({"_id": 1}).toArray() == [{"_id": "ada", "value": 21}, {"_id": "ben", "value": 10}]
    db.orders.mapReduce(pairs, total, {"out": {"merge": "sums"}, "query": {"cust": "ben"}})
    assert db.sums.find().sort({"_id": 1}).toArray() == [{"_id": "ada", "value": 21}, {"_id": "ben", "value": 9}]
    documents = db.orders.mapReduce(lambda d: [(d["cust"], {"n": 1, "most": d["price"]})], lambda k, vs: {"n": sum(v["n"] for v in vs), "most": max(v["most"] for v in vs)}, "docs")
    assert documents.value["ok"] == 1 and db.docs.findOne({"_id": "ada"}) == {"_id": "ada", "value": {"most": 6, "n": 2}}


def test_reduce_in_parts(spark):
    from tessera.plans.api import reduced_pairs

    pairs = spark.createDataFrame([("1", str(i)) for i in range(100)] + [("2", "7"), ('"x"', "1"), ('"x"', "2")], "k string, v string")
    out = reduced_pairs(pairs, lambda k, vs: sum(vs) if len(vs) <= 10 else 1 / 0, most=10)
    assert sorted(map(tuple, out.collect())) == [('"x"', "3"), ("1", "4950"), ("2", "7")]
    assert reduced_pairs(pairs.limit(0), max).count() == 0


def test_readers_keep_their_version(coll):
    frame, cursor = coll.find().frame(), coll.find().sort({"_id": 1})
    assert cursor.next()["_id"] == 1
    coll.insertOne({"_id": 4, "name": "elm", "a": 4})
    coll.updateMany({}, {"$inc": {"a": 100}})
    coll.deleteMany({"_id": {"$gt": 1}})
    assert sorted(r["_id"] for r in frame.collect()) == [1, 2, 3] and [d["_id"] for d in cursor] == [2, 3]
    assert coll.find().toArray() == [{"_id": 1, "name": "willow", "a": 101}]
    coll._store.vacuum("test", "coll", 0)
    assert coll.find().toArray() == [{"_id": 1, "name": "willow", "a": 101}] and len(coll._store._list(coll._store._folder("test", "coll"))) == 2


def test_inserts_append(db, monkeypatch):
    from tessera.sources import store

    for i in range(5):
        db.log.insertOne({"_id": i, "x": i})
    assert len(db.log._store._paths("test", "log")) == 5
    assert ids(db.log.find().sort({"$natural": -1}).limit(3)) == [4, 3, 2] and ids(db.log.aggregate([{"$sort": {"$natural": 1}}, {"$limit": 2}])) == [0, 1]
    monkeypatch.setattr(store, "MOST_VERSIONS", 5)
    db.log.insertOne({"_id": 5, "x": 5})
    assert len(db.log._store._paths("test", "log")) == 1 and db.log.count() == 6
    db.log.insertOne({"_id": 6, "y": "new field"})
    assert db.log.findOne({"_id": 6}) == {"_id": 6, "y": "new field"} and db.log.count() == 7


def test_two_writers(db):
    store = db.getConnection()._store
    db.log.insertOne({"_id": 1})
    original, folder = store._manifest, store._folder("test", "log")
    store._manifest = lambda f: (0, []) if f == folder else original(f)
    with pytest.raises(RuntimeError):
        db.log._store.write("test", "log", db.log._db._spark.range(1))
    del store._manifest
    assert db.log.count() == 1


def test_kill_one_operation(db, spark):
    assert db.killOp(10**8)["ok"] == 1  # no such job: nothing else is touched
    assert spark.range(3).count() == 3


def test_documents_merge_and_arrays_join(db):
    db.coll.insertMany([{"_id": 1, "a": {"x": 1, "y": 2}, "b": {"y": 3, "z": 4}, "l": [1]}])
    out = db.coll.aggregate([{"$project": {"m": {"$mergeObjects": ["$a", "$b", {"w": "$_id"}]}, "n": {"$ifNull": [{"$concatArrays": ["$l", "$none"]}, "nothing"]}, "o": {"$concatArrays": ["$l", [2, 3]]}}}]).toArray()
    assert out == [{"_id": 1, "m": {"x": 1, "y": 3, "z": 4, "w": 1}, "n": "nothing", "o": [1, 2, 3]}]


def test_replacements_keep_ids(db):
    db.coll.insertMany([{"_id": i, "v": "old"} for i in range(4)])
    db.coll.update({"_id": {"$lt": 3}}, {"v": 1, "d": {"e": [1, 2]}}, {"multi": True})
    assert db.coll.find().sort({"_id": 1}).toArray() == [*({"_id": i, "v": 1, "d": {"e": [1, 2]}} for i in range(3)), {"_id": 3, "v": "old"}]


def test_lookup_gathers_what_is_used(db):
    db.coll.insertMany([{"_id": i, "k": i % 2} for i in range(4)])
    db.other.insertMany([{"_id": i, "k": i % 2, "x": i, "y": {"z": i}} for i in range(6)])
    join = {"$lookup": {"from": "other", "localField": "k", "foreignField": "k", "as": "o"}}

    def gathered(*stages):
        plan = db.coll.aggregate([join, *stages]).frame()._jdf.queryExecution().optimizedPlan().toString()
        return re.search(r"collect_list\(struct\((.*?)\)", plan)[1]

    assert "y#" not in gathered({"$project": {"n": {"$size": "$o"}, "x": "$o.x"}}) and "x#" not in gathered({"$project": {"n": {"$size": "$o"}}})
    assert "x#" in gathered({"$match": {"o.x": {"$gt": 1}}}, {"$project": {"k": 1}}) and "y#" in gathered({"$project": {"k": 1, "o": 1}}) and "y#" in gathered()
    assert "y#" in gathered({"$addFields": {"w": "$o"}}, {"$project": {"w": 1}}) and "y#" in gathered({"$project": {"r": "$$ROOT"}})
    out = db.coll.aggregate([join, {"$unwind": "$o"}, {"$match": {"o.x": {"$gte": 4}}}, {"$sort": {"_id": 1, "o.x": 1}}, {"$project": {"x": "$o.x", "z": "$o.y.z"}}]).toArray()
    assert out == [{"_id": 0, "x": 4, "z": 4}, {"_id": 1, "x": 5, "z": 5}, {"_id": 2, "x": 4, "z": 4}, {"_id": 3, "x": 5, "z": 5}]
    (whole,) = db.coll.aggregate([join, {"$project": {"o": {"x": 1}}}, {"$match": {"_id": 0}}]).toArray()
    assert sorted(d["x"] for d in whole["o"]) == [0, 2, 4]


def test_lookup_without_an_equality(db):
    db.coll.insertMany([{"_id": 1}])
    with pytest.raises(Unsupported):
        db.coll.aggregate([{"$lookup": {"from": "coll", "let": {"x": "$_id"}, "pipeline": [{"$match": {"$expr": {"$gt": ["$_id", "$$x"]}}}], "as": "y"}}])
    with pytest.raises(Unsupported):
        db.coll.aggregate([{"$lookup": {"from": "coll", "pipeline": [], "as": "y"}}])
