from __future__ import annotations

import pytest

from tessera.functions.scope import Unsupported
from tessera.plans.api import Connection
from tessera.streaming.streams import Streams


def test_change_stream(spark, tmp_path):
    connection = Connection(spark, str(tmp_path / "data"))
    db = connection.getDB("test")
    with pytest.raises(Unsupported):
        db.coll.watch()
    connection.startLogging()
    with_match = db.coll.watch([{"$match": {"operationType": "insert"}}])
    db.coll.insertMany([{"_id": 1, "a": 5}])
    db.other.insertOne({"_id": 7})
    first = with_match.next()
    assert first["operationType"] == "insert" and first["fullDocument"] == {"_id": 1, "a": 5} and with_match.tryNext() is None
    token = with_match.getResumeToken()
    with_match.close()
    db.coll.deleteOne({"_id": 1})
    resumed = db.watch([], {"resumeAfter": token})
    assert [resumed.next()["operationType"] for _ in range(2)] == ["insert", "delete"] and resumed.tryNext() is None
    with pytest.raises(Unsupported):
        resumed.toArray()
    resumed.close()


def test_stream_processor(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    connection = Connection(spark, str(tmp_path / "data"))
    streams = Streams(spark, str(tmp_path / "state"))
    streams.addParquetSource("in", source, schema)
    streams.addDatabase("db", connection)
    merge = {"$merge": {"into": {"connectionName": "db", "db": "test", "coll": "out"}, "on": "k"}}
    processor = streams.createStreamProcessor("p", [{"$source": {"connectionName": "in"}}, {"$addFields": {"w": "$v"}}, merge])
    processor.start()
    processor.awaitBatch()
    out = connection.getDB("test").out
    assert out.count() == 2 and processor.stats()["state"] == "STARTED"
    processor.stop()
    processor.modify([{"$source": {"connectionName": "in"}}, {"$match": {"k": {"$gt": 1}}}, {"$addFields": {"new": 9}}, merge], {"resumeFromCheckpoint": False})
    processor.start()
    processor.awaitBatch()
    processor.stop()
    assert out.count({"new": 9}) == 1 and out.count() == 2
    assert len(processor.sample()) == 1 and len(streams.process([{"$source": {"connectionName": "in"}}])) == 2
    assert streams.listStreamProcessors() == [{"name": "p", "state": "STOPPED"}] and len(streams.listConnections()) == 2
    processor.drop()
    assert streams.listStreamProcessors() == []
    for bad in (("", []), ("x", {})):
        with pytest.raises(ValueError):
            streams.createStreamProcessor(*bad)
