"""Change streams and named stream processors on Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scope import Unsupported
from tessera.functions.values import parse
from tessera.plans.cursor import BaseCursor
from tessera.plans.pipeline import Context, run_stages, split_sink
from tessera.sources.documents import document_of

CHANGE_SCHEMA = "_id string, operationType string, db string, coll string, clusterTime timestamp_ntz, document string"


class ChangeStreamCursor(BaseCursor):
    """Changes of a collection, a database or everything, from the change log by a streaming query into memory.

    The resume token is the time and id of the last change that was read; ``resumeAfter`` and ``startAfter`` go on behind it, and
    ``startAtOperationTime`` begins at a time. Without them a stream begins with the changes after its opening.
    """

    def __init__(self, database: Any, collection: str | None, pipeline: list[dict], options: dict, everything: bool = False):
        super().__init__()
        connection = database._connection
        if not connection._logging:
            raise Unsupported("no change log is kept; call startLogging on the connection first")
        spark: SparkSession = connection._spark
        spark.createDataFrame([], CHANGE_SCHEMA).write.mode("append").parquet(connection._log_folder)
        log = spark.readStream.schema(CHANGE_SCHEMA).parquet(connection._log_folder)
        if not everything:
            log = log.where(F.col("db") == database._name)
        if collection is not None:
            log = log.where(F.col("coll") == collection)
        if token := options.get("resumeAfter") or options.get("startAfter"):
            log = log.where(F.struct("clusterTime", "_id") > F.struct(F.lit(token["time"]).cast("timestamp_ntz"), F.lit(token["id"])))
        elif at := options.get("startAtOperationTime"):
            log = log.where(F.col("clusterTime") >= F.lit(str(at)).cast("timestamp_ntz"))
        else:
            now = spark.range(1).select(F.localtimestamp()).first()[0]
            log = log.where(F.col("clusterTime") >= F.lit(str(now)).cast("timestamp_ntz"))
        if pipeline:
            log = run_stages(log, pipeline, Context(spark, database._frame))
        self._table = f"changes_{uuid.uuid4().hex}"
        self._spark, self._token, self._read = spark, None, 0
        self._query = log.writeStream.format("memory").queryName(self._table).outputMode("append").start()

    def _poll(self) -> None:
        if self._closed or self._ahead:
            return
        self._query.processAllAvailable()
        rows = self._spark.table(self._table)
        order = [c for c in ("clusterTime", "_id") if c in rows.columns]
        found = (rows.orderBy(*order) if order else rows).offset(self._read).collect()
        self._read += len(found)
        for row in found:
            document = document_of(row)
            if isinstance(document.get("document"), str):
                document["fullDocument"] = parse(document.pop("document"))
            self._ahead.append(document)

    def tryNext(self) -> Any:
        """The next change if there is one now."""
        self._poll()
        if not self._ahead:
            return None
        document = self._ahead.pop(0)
        self._token = {"time": str(document.get("clusterTime")), "id": document.get("_id")}
        for f in self._maps:
            document = f(document)
        return document

    def hasNext(self) -> bool:
        self._poll()
        return bool(self._ahead)

    def next(self) -> Any:
        """The next change; waits for one."""
        while not self._closed:
            document = self.tryNext()
            if document is not None:
                return document
            time.sleep(0.2)
        raise StopIteration("the stream is closed")

    def getResumeToken(self) -> dict | None:
        return self._token

    def close(self) -> None:
        super().close()
        self._query.stop()
        self._spark.catalog.dropTempView(self._table)

    def _none(self, *_: Any) -> None:
        raise Unsupported("a change stream has no end and no batches")

    toArray = batchSize = objsLeftInBatch = maxTimeMS = isExhausted = _none


class StreamProcessor:
    """A named pipeline from a source connection to a sink connection, run as a streaming query."""

    def __init__(self, streams: Streams, name: str, pipeline: list[dict], options: dict):
        self.name, self.pipeline, self.options, self._streams = name, pipeline, options, streams
        self._query = None
        self._generation = 0

    def _checkpoint(self) -> str:
        return f"{self._streams._folder}/{self.name}/{self._generation}"

    def _build(self) -> tuple[DataFrame, Any]:
        stages, sink = split_sink(self.pipeline)
        return self._streams._compile(stages), sink

    def start(self, options: dict | None = None) -> None:
        if self._query is not None and self._query.isActive:
            raise RuntimeError(f"{self.name} is running")
        df, sink = self._build()
        writer = df.writeStream.queryName(self.name).option("checkpointLocation", self._checkpoint())
        if self.options.get("availableNow") or (options or {}).get("availableNow"):
            writer = writer.trigger(availableNow=True)
        if sink is None:
            raise ValueError("a processor ends with $merge or $out")
        into = sink[1]["into"]
        target = self._streams._connections[into["connectionName"]]
        self._query = writer.foreachBatch(lambda rows, n: target(rows, into, sink[1])).start()

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def drop(self) -> None:
        self.stop()
        self._streams._processors.pop(self.name, None)

    def stats(self) -> dict:
        progress = self._query.lastProgress if self._query is not None else None
        return {"name": self.name, "state": "STARTED" if self._query is not None and self._query.isActive else "STOPPED", "lastProgress": progress}

    def awaitBatch(self) -> None:
        """Wait until everything that is there now is processed."""
        if self._query is not None:
            self._query.processAllAvailable()

    def modify(self, pipeline: list[dict] | dict | None = None, options: dict | None = None) -> None:
        """Replace the pipeline of a stopped processor. Without ``resumeFromCheckpoint`` it begins anew; the old checkpoint stays."""
        if isinstance(pipeline, dict):
            pipeline, options = None, pipeline
        if self._query is not None and self._query.isActive:
            raise RuntimeError("stop the processor first")
        if pipeline is not None:
            self.pipeline = pipeline
        if (options or {}).get("resumeFromCheckpoint", True) is False:
            self._generation += 1

    def sample(self, size: int = 10) -> list[dict]:
        """Some of the documents that pass the processor's stages."""
        df, _ = self._build()
        return self._streams._preview(df, size)


class Streams:
    """Connections and processors by name. A source connection makes a streaming frame, a sink takes each micro-batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._sources: dict[str, Callable[[dict], DataFrame]] = {}
        self._connections: dict[str, Callable[[DataFrame, dict, dict], None]] = {}
        self._processors: dict[str, StreamProcessor] = {}

    def addSource(self, name: str, make: Callable[[dict], DataFrame]) -> None:
        self._sources[name] = make

    def addParquetSource(self, name: str, path: str, schema: Any, options: dict | None = None) -> None:
        self._sources[name] = lambda spec: self._spark.readStream.schema(schema).options(**(options or {})).parquet(path)

    def addDatabase(self, name: str, connection: Any) -> None:
        """A connection whose collections ``$merge`` writes to."""

        def write(rows: DataFrame, into: dict, spec: dict) -> None:
            connection.getDB(into["db"])._merge(rows, {**spec, "into": into["coll"]})

        self._connections[name] = write

    def _compile(self, stages: list[dict]) -> DataFrame:
        if not stages or "$source" not in stages[0]:
            raise ValueError("a processor begins with $source")
        source = stages[0]["$source"]
        if "documents" in source:
            raise Unsupported("inline documents as a stream")
        df = self._sources[source["connectionName"]](source)

        def none(name: str) -> DataFrame:
            raise Unsupported("a processor reads its source only")

        return run_stages(df, stages[1:], Context(self._spark, none))

    def _preview(self, df: DataFrame, size: int) -> list[dict]:
        table = f"sample_{uuid.uuid4().hex}"
        query = df.limit(size).writeStream.format("memory").queryName(table).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        out = [document_of(r) for r in self._spark.table(table).collect()]
        self._spark.catalog.dropTempView(table)
        return out

    def process(self, pipeline: list[dict], options: dict | None = None) -> list[dict]:
        """Run stages over what the source holds now and return some of the documents; nothing stays behind."""
        stages, _ = split_sink(pipeline)
        return self._preview(self._compile(stages), (options or {}).get("size", 10))

    def createStreamProcessor(self, name: str, pipeline: list[dict], options: dict | None = None) -> StreamProcessor:
        if not isinstance(name, str) or not name.strip():
            raise ValueError("a processor needs a name")
        if not isinstance(pipeline, list):
            raise ValueError("a pipeline is a list of stages")
        self._processors[name] = StreamProcessor(self, name, pipeline, options or {})
        return self._processors[name]

    def getProcessor(self, name: str) -> StreamProcessor:
        return self._processors[name]

    def __getitem__(self, name: str) -> StreamProcessor:
        return self._processors[name]

    def listStreamProcessors(self, query: dict | None = None) -> list[dict]:
        rows = [{"name": p.name, **{"state": p.stats()["state"]}} for p in self._processors.values()]
        return [r for r in rows if all(r.get(k) == v for k, v in (query or {}).items())]

    def listConnections(self, query: dict | None = None) -> list[dict]:
        rows = [{"name": n, "type": "source"} for n in self._sources] + [{"name": n, "type": "sink"} for n in self._connections]
        return [r for r in rows if all(r.get(k) == v for k, v in (query or {}).items())]

    def listWorkspaceDefaults(self) -> dict:
        return {"checkpointFolder": self._folder}
