"""Connections, databases, collections and bulk writes over Spark. Method names are those of document shells."""

from __future__ import annotations

import copy
import datetime as dt
import math
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scope import Scope, Unsupported, literal, quoted
from tessera.functions.values import DBRef, parse, plain
from tessera.operators.collation import Collation
from tessera.operators.predicates import Compiler, sure
from tessera.operators.stages import project
from tessera.operators.updates import apply_update, is_replacement, sure_match, upserted
from tessera.plans import stats
from tessera.plans.cursor import Cursor, FrameCursor, explained
from tessera.plans.pipeline import Context, normalized, run_stages, split_sink
from tessera.plans.results import BulkWriteResult, CommandResult, DeleteResult, InsertManyResult, InsertOneResult, UpdateResult
from tessera.sources.documents import document_of, frame_of, kind_of, settled, with_ids
from tessera.sources.store import Store


def find_and_modify_options(options: dict | None) -> dict:
    """Options with ``returnDocument`` as before or after, whichever way it was asked for; before by default."""
    out = dict(options or {})
    given = [k for k in ("returnDocument", "returnOriginal", "returnNewDocument", "new") if k in out]
    values = {k: out.pop(k) for k in given}
    first = given[0] if given else None
    if first == "returnDocument":
        if values[first] not in ("before", "after"):
            raise ValueError("returnDocument needs to be either 'before' or 'after'")
        out["returnDocument"] = values[first]
    elif first == "returnOriginal":
        out["returnDocument"] = "before" if values[first] else "after"
    else:
        out["returnDocument"] = "after" if first and values[first] else "before"
    return out


def remove_options(options: bool | dict | None) -> dict:
    return {"justOne": options} if isinstance(options, bool) else {"justOne": False, **(options or {})}


def _checked(options: dict | None, known: str) -> dict:
    """Options, if all are known. Those that only concern servers are accepted and have no effect."""
    common = "writeConcern readConcern readPreference session maxTimeMS comment hint let bypassDocumentValidation"
    if unknown := set(options or {}) - set(known.split()) - set(common.split()):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return dict(options or {})


class Collection:
    """A named collection. Reads are lazy; inserts add a version with their rows, other writes replace all rows by a new one."""

    def __init__(self, database: Database, name: str):
        if not name or "$" in name or "\0" in name:
            raise ValueError(f"invalid collection name {name!r}")
        self._db, self._name = database, name
        self._store = database._connection._store

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._db.getCollection(f"{self._name}.{name}")

    # names
    def getName(self) -> str:
        return self._name

    def getFullName(self) -> str:
        return f"{self._db._name}.{self._name}"

    def getDB(self) -> Database:
        return self._db

    def getConnection(self) -> Connection:
        return self._db._connection

    def exists(self) -> dict | None:
        return next((x for x in self._db.getCollectionInfos({"name": self._name})), None)

    # reading
    def frame(self) -> DataFrame:
        return self._db._frame(self._name)

    def _text_fields(self) -> tuple[str, ...] | None:
        fields = [k for i in self._indexes() for k, v in i["key"].items() if v == "text"]
        return tuple(fields) or None

    def find(self, query: dict | None = None, projection: dict | None = None, options: dict | None = None) -> Cursor:
        out = Cursor(self.frame(), query, projection, self._text_fields(), self.getFullName())
        known = "allowDiskUse allowPartialResults batchSize collation limit max min noCursorTimeout oplogReplay projection returnKey showRecordId skip sort tailable explain"
        out.options |= {k: v for k, v in _checked(options, known).items() if v is not None}
        return out

    def findOne(self, query: dict | None = None, projection: dict | None = None, options: dict | None = None) -> dict | None:
        return self.find(query, projection, options).limit(1).tryNext()

    def aggregate(self, *args: Any) -> FrameCursor | dict:
        options = {}
        if len(args) == 2 and isinstance(args[0], list):
            args, options = args[:1], args[1] or {}
        return self._db._aggregate(self._name, normalized(args), options)

    def count(self, query: dict | None = None, options: dict | None = None) -> int:
        options = _checked(options, "limit skip collation")
        return self.find(query, None, options).count()

    def countDocuments(self, query: dict | None = None, options: dict | None = None) -> int:
        return self.count(query, options)

    def estimatedDocumentCount(self, options: dict | None = None) -> int:
        """Counted from Parquet footers: no column is read."""
        _checked(options, "")
        return self.frame().count()

    def distinct(self, field: str, query: dict | None = None, options: dict | None = None) -> list:
        return [document_of(r[0]) for r in self._distinct(field, query, options).collect()]

    def _distinct(self, field: str, query: dict | None = None, options: dict | None = None) -> DataFrame:
        from pyspark.sql import types as T

        from tessera.operators.stages import variant_key

        collation = Collation.of(_checked(options, "collation").get("collation"))
        df = self.find(query, None, {"collation": (options or {}).get("collation")})._filtered()
        column, kind = Scope(df.schema).path(field)
        if isinstance(kind, T.ArrayType):
            df, kind = df.select(F.explode(column).alias("value")), kind.elementType
        else:
            df = df.select(column.alias("value"))
        df = df.where("value is not null")
        if isinstance(kind, T.VariantType):
            return df.groupBy(variant_key(F.col("value")).alias("k")).agg(F.first("value").alias("value")).orderBy("k").select("value")
        if collation and isinstance(kind, T.StringType):
            return df.groupBy(collation.key(F.col("value")).alias("k")).agg(F.first("value").alias("value")).orderBy("k").select("value")
        out = df.distinct()
        return out if isinstance(kind, T.StructType) else out.orderBy("value")

    def mapReduce(self, map_: Callable, reduce_: Callable, options: dict | str) -> list[dict] | CommandResult:
        """``map_`` yields ``(key, value)`` of a document, ``reduce_`` turns a key and its values into one value.

        Keys and values travel as JSON text. A reduce function may be applied to its own results, so every batch of documents is reduced
        before the shuffle, and what is put into a collection is reduced with what it holds by a union. Only ``inline``, whose rows are the result, collects.
        """
        options = {"out": options} if isinstance(options, str) else options
        df = self.find(options.get("query"), None, {k: options[k] for k in ("sort", "limit") if k in options}).frame()
        out = options.get("out", {"inline": 1})
        target = None if isinstance(out, dict) and "inline" in out else out if isinstance(out, str) else out.get("replace") or out.get("merge") or out.get("reduce")
        pairs = map_reduced(df, map_, reduce_)
        held = self._db.getCollection(target) if target else None
        if isinstance(out, dict) and "reduce" in out and held.exists():
            pairs = reduced_pairs(pairs.unionByName(_json_pairs(held.frame())), reduce_)
        found = finalized(pairs, options.get("finalize"))
        if target is None:
            return [{"_id": parse(r["k"]), "value": parse(r["v"])} for r in found.orderBy("k").collect()]
        rows = _typed_pairs(found)
        if isinstance(out, dict) and ("merge" in out or "reduce" in out) and held.exists():
            self._db._merge(rows, {"into": target, "whenMatched": "replace"})
        else:
            self._store.write(self._db._name, target, rows)
        return CommandResult("MapReduceResult", {"result": target, "ok": 1})

    def explain(self, verbosity: str = "queryPlanner") -> Explainable:
        return Explainable(self, verbosity)

    # writing
    def _write(self, df: DataFrame) -> None:
        self._validate(df)
        options = self._store.options.get((self._db._name, self._name), {})
        if options.get("capped") and options.get("max"):
            df = df.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.desc("_at")).limit(options["max"]).orderBy("_at").drop("_at")
        for index in self._unique():
            if not df.groupBy(*index["key"]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                raise ValueError(f"duplicate key for index {index['name']}")
        self._store.write(self._db._name, self._name, df)

    def _unique(self) -> list[dict]:
        return [i for i in self._indexes() if i.get("unique")]

    def _validate(self, df: DataFrame) -> None:
        options = self._store.options.get((self._db._name, self._name), {})
        if options.get("validator") and options.get("validationAction", "error") == "error" and options.get("validationLevel") != "off":
            if not df.where(~sure(Compiler(Scope(df.schema)).query(options["validator"]))).isEmpty():
                raise ValueError("document failed validation")

    def _add(self, held: DataFrame, new: DataFrame) -> None:
        """Append rows that fit the collection's columns; else, and where the collection is capped, all rows are written again."""
        whole = widened_union(held, new)
        kinds = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
        if kinds(whole) != kinds(held) or self.isCapped():
            self._write(whole)
            return
        rows = widened_union(held.limit(0), new)
        self._validate(rows)
        for index in self._unique():
            keys = list(index["key"])
            again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if not again.isEmpty() or not held.join(rows.select(*keys), keys, "left_semi").isEmpty():
                raise ValueError(f"duplicate key for index {index['name']}")
        self._store.append(self._db._name, self._name, rows)

    def insertMany(self, documents: list[dict], options: dict | None = None) -> InsertManyResult:
        _checked(options, "ordered")
        rows = with_ids(documents)
        if not rows:
            raise ValueError("there is nothing to insert")
        ids = [d["_id"] for d in rows]
        new = frame_of(self._db._spark, rows)
        if len({repr(plain(i)) for i in ids}) < len(ids):
            raise ValueError("duplicate key for index _id_")
        if self._store.current(self._db._name, self._name):
            held = self.frame()
            if "_id" in held.columns and held.schema["_id"].dataType == new.schema["_id"].dataType and not held.join(new.select("_id"), "_id", "left_semi").isEmpty():
                raise ValueError("duplicate key for index _id_")
            self._add(held, new)
        else:
            self._write(new)
        self._db._log("insert", rows, self._name)
        return InsertManyResult(True, ids)

    def insertOne(self, document: dict, options: dict | None = None) -> InsertOneResult:
        return InsertOneResult(True, self.insertMany([document]).insertedIds[0])

    def insert(self, documents: dict | list[dict], options: dict | None = None) -> InsertManyResult:
        return self.insertMany(documents if isinstance(documents, list) else [documents], options)

    def _one(self, df: DataFrame, query: dict, options: dict) -> Column | None:
        """The row that an operation on one document is for: the first that matches, in the asked order."""
        found = Cursor(df, query, None, self._text_fields())
        found.options |= {k: options[k] for k in ("sort", "collation") if options.get(k)}
        row = found.limit(1).frame().select("_id").first()
        return None if row is None else F.col("_id").eqNullSafe(F.lit(row[0]))

    def _update(self, query: dict, update: Any, many: bool, options: dict | None) -> UpdateResult:
        options = _checked(options, "upsert collation arrayFilters sort")
        df = self.frame()
        matched = sure_match(df, query, Collation.of(options.get("collation"))) if many else self._one(df, query, options)
        count = 0 if matched is None else df.where(matched).count() if many else 1
        if not count:
            if not options.get("upsert"):
                return UpdateResult(True, None, 0, 0, 0)
            new = self.insertOne(upserted(query, update)).insertedId
            return UpdateResult(True, new, 0, 0, 1)
        if not isinstance(update, list) and is_replacement(update):
            changed = replaced(df, matched, update)
        else:
            changed = apply_update(df, matched, update, options.get("arrayFilters"))
        modified = self._differing(df.where(matched), changed, count)
        self._write(changed)
        self._db._log("update", [{"query": query, "update": update}], self._name)
        return UpdateResult(True, None, count, modified, 0)

    def _differing(self, before: DataFrame, after: DataFrame, count: int) -> int:
        key = lambda df: df.select("_id", F.to_json(F.struct(*(F.col(quoted(c)) for c in sorted(df.columns)))).alias("_text"))
        same = key(before).join(key(after), ["_id", "_text"], "left_semi").count()
        return count - same

    def updateOne(self, query: dict, update: Any, options: dict | None = None) -> UpdateResult:
        return self._update(query, self._operators(update), False, options)

    def updateMany(self, query: dict, update: Any, options: dict | None = None) -> UpdateResult:
        return self._update(query, self._operators(update), True, options)

    def update(self, query: dict, update: Any, options: dict | None = None) -> UpdateResult:
        rest = dict(options or {})
        return self._update(query, update, bool(rest.pop("multi", False)), rest)

    def replaceOne(self, query: dict, replacement: dict, options: dict | None = None) -> UpdateResult:
        if not is_replacement(replacement):
            raise ValueError("a replacement has no operators")
        return self._update(query, replacement, False, options)

    @staticmethod
    def _operators(update: Any) -> Any:
        if is_replacement(update):
            raise ValueError("an update has operators")
        return update

    def _delete(self, query: dict, many: bool, options: dict | None) -> DeleteResult:
        options = _checked(options, "collation")
        df = self.frame()
        matched = sure_match(df, query, Collation.of(options.get("collation"))) if many else self._one(df, query, options)
        count = 0 if matched is None else df.where(matched).count() if many else 1
        if count:
            self._write(df.where(~matched))
            self._db._log("delete", [{"query": query}], self._name)
        return DeleteResult(True, count)

    def deleteOne(self, query: dict, options: dict | None = None) -> DeleteResult:
        return self._delete(query, False, options)

    def deleteMany(self, query: dict, options: dict | None = None) -> DeleteResult:
        return self._delete(query, True, options)

    def remove(self, query: dict, options: bool | dict | None = None) -> DeleteResult:
        rest = remove_options(options)
        return self._delete(query, not rest.pop("justOne"), rest)

    def _find_and(self, query: dict, change: Callable[[dict], Any], options: dict) -> dict | None:
        options = find_and_modify_options(options)
        before = self.find(query, None, {k: options[k] for k in ("sort", "collation") if k in options}).limit(1).tryNext()
        if before is None and not options.get("upsert"):
            return None
        result = change(query if before is None else {"_id": before["_id"]})
        if options["returnDocument"] == "before":
            out = before
        else:
            out = self.findOne({"_id": before["_id"] if before else result.insertedId})
        if out is not None and options.get("projection"):
            out = document_of(project(frame_of(self._db._spark, [out]), options["projection"], Context(self._db._spark, self._db._frame)).first())
        return out

    def findOneAndDelete(self, query: dict, options: dict | None = None) -> dict | None:
        return self._find_and(query, self.deleteOne, {**(options or {}), "returnDocument": "before"})

    def findOneAndReplace(self, query: dict, replacement: dict, options: dict | None = None) -> dict | None:
        up = {"upsert": bool((options or {}).get("upsert"))}
        return self._find_and(query, lambda q: self.replaceOne(q, replacement, up), options or {})

    def findOneAndUpdate(self, query: dict, update: Any, options: dict | None = None) -> dict | None:
        up = {k: (options or {})[k] for k in ("upsert", "arrayFilters") if k in (options or {})}
        return self._find_and(query, lambda q: self.updateOne(q, update, up), options or {})

    def findAndModify(self, options: dict) -> dict | None:
        rest = {("projection" if k == "fields" else k): v for k, v in options.items() if k not in ("query", "update", "remove")}
        query = options.get("query", {})
        if options.get("remove"):
            return self.findOneAndDelete(query, rest)
        if "update" not in options:
            raise ValueError("findAndModify needs an update or remove")
        change = self.findOneAndReplace if is_replacement(options["update"]) else self.findOneAndUpdate
        return change(query, options["update"], rest)

    def bulkWrite(self, operations: list[dict], options: dict | None = None) -> BulkWriteResult:
        _checked(options, "ordered")
        out, ordered = BulkWriteResult(), (options or {}).get("ordered", True)
        errors = []
        for i, operation in enumerate(operations):
            (name, spec), = operation.items()
            try:
                if name == "insertOne":
                    out.insertedIds[i] = self.insertOne(spec.get("document", spec)).insertedId
                    out.insertedCount += 1
                elif name in ("updateOne", "updateMany", "replaceOne"):
                    up = {k: v for k, v in spec.items() if k not in ("filter", "update", "replacement")}
                    done = getattr(self, name)(spec["filter"], spec.get("update", spec.get("replacement")), up)
                    out.matchedCount += done.matchedCount
                    out.modifiedCount += done.modifiedCount
                    out.upsertedCount += done.upsertedCount
                    if done.upsertedCount:
                        out.upsertedIds[i] = done.insertedId
                elif name in ("deleteOne", "deleteMany"):
                    out.deletedCount += getattr(self, name)(spec["filter"], {k: v for k, v in spec.items() if k != "filter"}).deletedCount
                else:
                    raise Unsupported(f"bulk operation {name}")
            except ValueError as e:
                if ordered:
                    raise
                errors.append((i, e))
        if errors:
            raise ValueError(f"bulk write failed at {[i for i, _ in errors]}: {errors[0][1]}")
        return out

    def initializeOrderedBulkOp(self) -> Bulk:
        return Bulk(self, True)

    def initializeUnorderedBulkOp(self) -> Bulk:
        return Bulk(self, False)

    # collections and indexes
    def drop(self, options: dict | None = None) -> bool:
        return self._store.drop(self._db._name, self._name)

    def renameCollection(self, name: str, dropTarget: bool = False) -> dict:
        if not isinstance(name, str):
            raise TypeError("the new name is text")
        self._store.rename(self._db._name, self._name, name, dropTarget)
        return {"ok": 1}

    def isCapped(self) -> bool:
        return bool(self._store.options.get((self._db._name, self._name), {}).get("capped"))

    def convertToCapped(self, size: int) -> dict:
        self._store.options.setdefault((self._db._name, self._name), {}).update(capped=True, size=size)
        return {"ok": 1}

    def _indexes(self) -> list[dict]:
        return self._store.indexes.setdefault((self._db._name, self._name), [])

    def createIndexes(self, keys: list[dict], options: dict | None = None, quorum: Any = None) -> list[str]:
        known = "unique name partialFilterExpression sparse expireAfterSeconds hidden collation background weights default_language language_override storageEngine textIndexVersion 2dsphereIndexVersion bits min max bucketSize wildcardProjection clustered"
        options, names = _checked(options, known), []
        for key in keys:
            name = options.get("name") or "_".join(f"{k}_{v}" for k, v in key.items())
            if name not in [i["name"] for i in self._indexes()]:
                self._indexes().append({"v": 2, "key": dict(key), **options, "name": name})
            names.append(name)
        return names

    def createIndex(self, key: dict, options: dict | None = None, quorum: Any = None) -> str:
        return self.createIndexes([key], options)[0]

    def ensureIndex(self, key: dict, options: dict | None = None, quorum: Any = None) -> list[str]:
        return self.createIndexes([key], options)

    def getIndexes(self) -> list[dict]:
        return [{"v": 2, "key": {"_id": 1}, "name": "_id_"}, *copy.deepcopy(self._indexes())]

    getIndexSpecs = getIndices = getIndexes

    def getIndexKeys(self) -> list[dict]:
        return [i["key"] for i in self.getIndexes()]

    def dropIndexes(self, names: Any = "*") -> dict:
        if names == "*":
            self._indexes().clear()
            return {"ok": 1}
        wanted = names if isinstance(names, list) else [names]
        held = [i for i in self._indexes() if i["name"] not in wanted and i["key"] not in wanted]
        if len(held) == len(self._indexes()):
            raise ValueError(f"index not found: {names}")
        self._indexes()[:] = held
        return {"ok": 1}

    def dropIndex(self, name: Any) -> dict:
        if name == "*" or isinstance(name, list):
            raise ValueError("one index at a time; dropIndexes takes several")
        return self.dropIndexes(name)

    def reIndex(self) -> dict:
        return {"ok": 1}

    def _hide(self, name: Any, on: bool) -> dict:
        for index in self._indexes():
            if name in (index["name"], index["key"]):
                index["hidden"] = on
                return {"ok": 1}
        raise ValueError(f"index not found: {name}")

    def hideIndex(self, name: Any) -> dict:
        return self._hide(name, True)

    def unhideIndex(self, name: Any) -> dict:
        return self._hide(name, False)

    def _search(self) -> list[dict]:
        return self._store.options.setdefault((self._db._name, self._name), {}).setdefault("searchIndexes", [])

    def createSearchIndex(self, name: Any = "default", definition: dict | None = None, *_: Any) -> str:
        if isinstance(name, dict):
            name, definition = name.get("name", "default"), name.get("definition", name)
        self._search().append({"name": name, "definition": definition or {}})
        return name

    def createSearchIndexes(self, specs: list[dict]) -> list[str]:
        return [self.createSearchIndex(s) for s in specs]

    def getSearchIndexes(self, name: str | None = None, options: dict | None = None) -> list[dict]:
        return [i for i in self._search() if name in (None, i["name"])]

    def dropSearchIndex(self, name: str) -> None:
        self._search()[:] = [i for i in self._search() if i["name"] != name]

    def updateSearchIndex(self, name: str, definition: dict) -> None:
        for i in self._search():
            i["definition"] = definition if i["name"] == name else i["definition"]

    # statistics
    def stats(self, options: Any = None) -> dict:
        scale = options if isinstance(options, int | float) else (options or {}).get("scale", 1)
        return stats.collection_stats(self._store, self._db._name, self._name, scale)

    def dataSize(self) -> float:
        return self.stats()["size"]

    def storageSize(self) -> float:
        return self.stats()["storageSize"]

    def totalIndexSize(self, *_: Any) -> float:
        return self.stats()["totalIndexSize"]

    def totalSize(self) -> float:
        return self.stats()["totalSize"]

    def latencyStats(self, options: dict | None = None) -> list[dict]:
        return [{"ns": self.getFullName(), "latencyStats": {}}]

    def validate(self, options: Any = None) -> dict:
        df = self.frame()
        repeated = 0 if "_id" not in df.columns else df.groupBy("_id").count().where("count > 1").count()
        return {"ns": self.getFullName(), "nrecords": df.count(), "valid": not repeated, "errors": ["duplicate _id"] * bool(repeated), "ok": 1}

    def getShardDistribution(self) -> list[dict]:
        """Rows and bytes by Spark partition, which stand in for shards."""
        df = self.frame()
        size = self._store.size(self._db._name, self._name)[0]
        parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("count")).withColumn("shard", F.concat(F.lit("partition"), F.col("p").cast("string")))
        n = df.count()
        rows = parts.select("shard", "count", (F.col("count") * (size / max(1, n))).alias("size"), F.lit(1).alias("numChunks"), F.lit(size / max(1, n)).alias("avgObjSize"))
        return [r.asDict() for r in stats.shard_distribution(rows).orderBy("shard").collect()]

    def getShardLocation(self) -> dict:
        return {"shards": [r["shard"] for r in self.getShardDistribution()], "sharded": False}

    def analyzeShardKey(self, key: dict, options: dict | None = None) -> dict:
        """How well a key would spread the rows: distinct values, whether it is unique, and the five most common ones."""
        rows = stats.key_frequencies(self.frame(), list(key))
        whole = rows.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        common = [{"value": document_of(r["key"]), "frequency": r["n"]} for r in rows.orderBy(F.desc("n"), "key").limit(5).collect()]
        return {"keyCharacteristics": {"numDocsTotal": whole["n"], "numDocsSampled": whole["n"], "isUnique": whole["n"] == whole["distinct"], "numDistinctValues": whole["distinct"], "mostCommonValues": common}, "ok": 1}

    def getPlanCache(self) -> PlanCache:
        return PlanCache(self)

    def runCommand(self, name: Any, options: dict | None = None) -> dict:
        return self._db.runCommand({name: self._name, **(options or {})} if isinstance(name, str) else name)

    def watch(self, pipeline: list[dict] | None = None, options: dict | None = None):
        from tessera.streaming.streams import ChangeStreamCursor

        return ChangeStreamCursor(self._db, self._name, pipeline or [], options or {})

    def resolve(self, refs: DataFrame, field: str = "ref") -> DataFrame:
        """References ``struct(ref, id)`` to this collection as its documents: an equi-join."""
        mine = self.frame()
        here = refs.where(F.col(f"{field}.$ref") == self._name)
        whole = F.struct(*(mine[c] for c in mine.columns)).alias("document")
        return here.join(mine, here[field]["$id"] == mine["_id"], "left").select(*(here[c] for c in here.columns), whole)


def replaced(df: DataFrame, matched: Column, document: dict) -> DataFrame:
    """The frame with the rows where ``matched`` holds replaced by a document; each keeps its own ``_id``."""
    def constant(value: Any) -> Column:
        kind = settled(kind_of(plain(value)))
        return literal(value) if isinstance(value, dict | list) else literal(value).cast(kind)

    fields = [constant(v).alias(k) for k, v in document.items() if k != "_id"]
    new = df.where(matched).select("_id", *fields)
    return widened_union(df.where(~matched), new)


def widened_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a field that both have in different types takes the type that holds both."""
    from pyspark.sql import types as T

    from tessera.sources.documents import merged

    def as_kind(df: DataFrame, name: str, kind: T.DataType) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        column, own = F.col(quoted(name)), df.schema[name].dataType
        if own == kind:
            return column
        if isinstance(kind, T.VariantType):
            return F.when(column.isNotNull(), _as_variant(column, own)).alias(name)
        if isinstance(kind, T.StructType) and isinstance(own, T.StructType):
            fields = [as_kind_of(column, own, f).alias(f.name) for f in kind.fields]
            return F.when(column.isNotNull(), F.struct(*fields)).alias(name)
        return column.cast(kind).alias(name)

    def as_kind_of(column: Column, own: T.StructType, field: T.StructField) -> Column:
        return column.getField(field.name).cast(field.dataType) if field.name in own.names else F.lit(None).cast(field.dataType)

    names = [*a.columns, *(c for c in b.columns if c not in a.columns)]
    none = T.NullType()
    kinds = {n: merged(a.schema[n].dataType if n in a.columns else none, b.schema[n].dataType if n in b.columns else none) for n in names}
    return a.select(*(as_kind(a, n, k) for n, k in kinds.items())).union(b.select(*(as_kind(b, n, k) for n, k in kinds.items())))


def _as_variant(column: Column, kind: Any) -> Column:
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType | T.ArrayType):
        return F.to_variant_object(column)
    return column.cast("variant")


def _json(value: Any) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def map_reduced(df: DataFrame, map_: Callable, reduce_: Callable) -> DataFrame:
    """Rows ``(k, v)`` of JSON text: what the map function yields for each document, reduced by key."""
    import json

    def emit(batches):
        import pandas as pd

        for pdf in batches:
            held: dict[str, list] = {}
            for document in pdf.to_dict("records"):
                for k, v in map_(document):
                    held.setdefault(_json(k), []).append(v)
            rows = [(k, _json(vs[0] if len(vs) == 1 else reduce_(json.loads(k), vs))) for k, vs in held.items()]
            yield pd.DataFrame(rows, columns=["k", "v"])

    return reduced_pairs(df.mapInPandas(emit, "k string, v string"), reduce_)


def reduced_pairs(pairs: DataFrame, reduce_: Callable, most: int = 1000) -> DataFrame:
    """One row for each key; its values, one for each batch at most, are reduced ``most`` at a time as they come sorted by key."""
    import json

    def fold(batches):
        import pandas as pd

        key, values = None, []

        def reduced():
            return values[0] if len(values) == 1 else reduce_(json.loads(key), values)

        for pdf in batches:
            out = []
            for k, v in zip(pdf["k"], pdf["v"], strict=True):
                if k != key and key is not None:
                    out.append((key, _json(reduced())))
                    values = []
                elif len(values) >= most:
                    values = [reduced()]
                key = k
                values.append(json.loads(v))
            yield pd.DataFrame(out, columns=["k", "v"])
        if key is not None:
            yield pd.DataFrame([(key, _json(reduced()))], columns=["k", "v"])

    return pairs.repartition("k").sortWithinPartitions("k").mapInPandas(fold, "k string, v string")


def finalized(pairs: DataFrame, finalize: Callable | None) -> DataFrame:
    import json

    if finalize is None:
        return pairs

    def end(batches):
        for pdf in batches:
            pdf["v"] = [_json(finalize(json.loads(k), json.loads(v))) for k, v in zip(pdf["k"], pdf["v"], strict=True)]
            yield pdf

    return pairs.mapInPandas(end, "k string, v string")


def _json_pairs(df: DataFrame) -> DataFrame:
    text = lambda c: F.to_json(F.col(c) if df.schema[c].dataType.simpleString() == "variant" else _as_variant(F.col(c), df.schema[c].dataType))
    return df.select(text("_id").alias("k"), text("value").alias("v"))


def _typed_pairs(pairs: DataFrame) -> DataFrame:
    """``_id`` and ``value`` in the types that all rows share; variants where they share none."""
    import re

    rows = pairs.select(F.parse_json("k").alias("_id"), F.parse_json("v").alias("value"))
    shape = rows.agg(*(F.schema_of_variant_agg(c).alias(c) for c in ("_id", "value"))).first()

    def kind(text: str | None) -> str:
        text = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", text or "VARIANT")
        return "VARIANT" if "VARIANT" in text or "VOID" in text else text.replace("OBJECT<", "STRUCT<")

    kinds = {c: kind(shape[c]) for c in ("_id", "value")}
    return rows.select(*(F.col(c) if kinds[c] == "VARIANT" else F.variant_get(c, "$", kinds[c]).alias(c) for c in kinds))


class Bulk:
    """Operations that are collected and then written in order."""

    def __init__(self, collection: Collection, ordered: bool):
        self._collection, self._ordered, self._operations, self._done = collection, ordered, [], False

    def insert(self, document: dict) -> Bulk:
        self._operations.append({"insertOne": {"document": document}})
        return self

    def find(self, query: dict) -> BulkFindOp:
        return BulkFindOp(self, query)

    def getOperations(self) -> list[dict]:
        return copy.deepcopy(self._operations)

    def execute(self, *_: Any) -> BulkWriteResult:
        if self._done:
            raise RuntimeError("the batch was already written")
        if not self._operations:
            raise ValueError("the batch is empty")
        self._done = True
        return self._collection.bulkWrite(self._operations, {"ordered": self._ordered})


class BulkFindOp:
    """The documents that an operation of a batch is for."""

    def __init__(self, bulk: Bulk, query: dict):
        self._bulk, self._spec = bulk, {"filter": query}

    def _option(self, name: str, value: Any) -> BulkFindOp:
        self._spec[name] = value
        return self

    def collation(self, spec: dict) -> BulkFindOp:
        return self._option("collation", spec)

    def arrayFilters(self, filters: list[dict]) -> BulkFindOp:
        return self._option("arrayFilters", filters)

    def hint(self, spec: Any) -> BulkFindOp:
        return self._option("hint", spec)

    def upsert(self) -> BulkFindOp:
        return self._option("upsert", True)

    def _add(self, name: str, **more: Any) -> Bulk:
        self._bulk._operations.append({name: {**self._spec, **more}})
        return self._bulk

    def update(self, update: Any) -> Bulk:
        return self._add("updateMany", update=Collection._operators(update))

    def updateOne(self, update: Any) -> Bulk:
        return self._add("updateOne", update=Collection._operators(update))

    def replaceOne(self, document: dict) -> Bulk:
        return self._add("replaceOne", replacement=document)

    def delete(self) -> Bulk:
        return self._add("deleteMany")

    def deleteOne(self) -> Bulk:
        return self._add("deleteOne")

    remove, removeOne = delete, deleteOne


class Explainable:
    """The same calls as a collection; each returns its plan."""

    def __init__(self, collection: Collection, verbosity: str):
        self._collection, self._verbosity = collection, verbosity

    def getCollection(self) -> Collection:
        return self._collection

    def getVerbosity(self) -> str:
        return self._verbosity

    def setVerbosity(self, verbosity: str) -> None:
        self._verbosity = verbosity

    def find(self, *args: Any) -> ExplainableCursor:
        return ExplainableCursor(self._collection.find(*args), self._verbosity)

    def aggregate(self, *args: Any) -> dict:
        stages, _ = split_sink(normalized(args[:1] if args and isinstance(args[0], list) else args))
        return explained(self._collection._db._run(self._collection._name, stages, {}), self._verbosity)

    def count(self, query: dict | None = None, options: dict | None = None) -> dict:
        return explained(self._collection.find(query, None, options)._filtered().groupBy().count(), self._verbosity)

    def distinct(self, field: str, query: dict | None = None, options: dict | None = None) -> dict:
        return explained(self._collection._distinct(field, query, options), self._verbosity)

    def _matching(self, query: dict, *_: Any) -> dict:
        """The plan that finds what a write would change; nothing is written."""
        return explained(self._collection.find(query).frame(), self._verbosity)

    update = remove = findOneAndDelete = findOneAndReplace = findOneAndUpdate = _matching

    def findAndModify(self, options: dict) -> dict:
        return self._matching(options.get("query", {}))

    def mapReduce(self, map_: Callable, reduce_: Callable, options: dict) -> dict:
        return self._matching(options.get("query", {}))


class ExplainableCursor:
    def __init__(self, cursor: Cursor, verbosity: str):
        self._cursor, self._verbosity = cursor, verbosity

    def __getattr__(self, name: str) -> Callable:
        def call(*args: Any) -> ExplainableCursor:
            getattr(self._cursor, name)(*args)
            return self

        return call

    def finish(self) -> dict:
        return self._cursor.explain(self._verbosity)


class PlanCache:
    """Spark keeps plans in the frames themselves: this lists which collections are cached."""

    def __init__(self, collection: Collection):
        self._collection = collection

    def clear(self) -> dict:
        self._collection._db._spark.catalog.clearCache()
        return {"ok": 1}

    def list(self, pipeline: list[dict] | None = None) -> list[dict]:
        rows = [{"ns": self._collection.getFullName(), "isCached": self._collection.frame().is_cached}]
        return [document_of(r) for r in run_stages(frame_of(self._collection._db._spark, rows), pipeline or [], self._collection._db._context({})).collect()]

    def clearPlansByQuery(self, *_: Any) -> dict:
        return self.clear()

    def listQueryShapes(self) -> None:
        raise Unsupported("query shapes")

    def getPlansByQuery(self, *_: Any) -> None:
        raise Unsupported("plans by query")


class Session:
    """A session. Each write is atomic by itself; several are not rolled back together, so a transaction cannot be aborted."""

    def __init__(self, connection: Connection, options: dict | None = None):
        self.id, self._connection, self._options, self._ended = uuid.uuid4(), connection, options or {}, False
        self._open = False
        connection._sessions.append(self)

    def getDatabase(self, name: str) -> Database:
        return Database(self._connection, name, self)

    def getOptions(self) -> dict:
        return self._options

    def getClusterTime(self) -> dt.datetime:
        return dt.datetime.now(dt.timezone.utc)  # noqa: UP017

    getOperationTime = getClusterTime

    def advanceOperationTime(self, *_: Any) -> None:
        pass

    def advanceClusterTime(self, *_: Any) -> None:
        pass

    def hasEnded(self) -> bool:
        return self._ended

    def endSession(self) -> None:
        self._ended = True
        if self in self._connection._sessions:
            self._connection._sessions.remove(self)

    def startTransaction(self, options: dict | None = None) -> None:
        if self._open:
            raise RuntimeError("a transaction is in progress")
        self._open = True

    def commitTransaction(self) -> None:
        if not self._open:
            raise RuntimeError("no transaction is in progress")
        self._open = False

    def abortTransaction(self) -> None:
        raise Unsupported("writes are put in place one by one and are not rolled back")

    def bulkWrite(self, models: list[dict], options: dict | None = None) -> BulkWriteResult:
        return self._connection.bulkWrite(models, options)


class Database:
    """A namespace of collections: ``db.name`` is a collection unless it is a method."""

    def __init__(self, connection: Connection, name: str, session: Session | None = None):
        if not name or any(c in name for c in '/\\. "\0'):
            raise ValueError(f"invalid database name {name!r}")
        self._connection, self._name, self._session = connection, name, session
        self._spark = connection._spark
        self._changes: dict[str, str] = {}

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return Collection(self, name)

    __getitem__ = __getattr__

    def getCollection(self, name: str) -> Collection:
        return Collection(self, name)

    def getName(self) -> str:
        return self._name

    def getConnection(self) -> Connection:
        return self._connection

    def getSiblingDB(self, name: str) -> Database:
        return self._connection.getDB(name)

    def getCollectionNames(self) -> list[str]:
        return self._connection._store.collections(self._name)

    def getCollectionInfos(self, query: dict | None = None, options: dict | None = None) -> list[dict]:
        store = self._connection._store
        rows = []
        for name in store.collections(self._name):
            own = store.options.get((self._name, name), {})
            kind = "view" if (self._name, name) in store.views else "timeseries" if "timeseries" in own else "collection"
            rows.append({"name": name, "type": kind, "readOnly": kind == "view" or (self._name, name) in store.mounts})
        if not rows:
            return []
        df = frame_of(self._spark, rows)
        found = df.where(sure_match(df, query or {})).orderBy("name").collect()
        return [{**document_of(r), "options": store.options.get((self._name, r["name"]), {})} for r in found]

    def createCollection(self, name: str, options: dict | None = None) -> dict:
        known = "capped size max timeseries expireAfterSeconds autoIndexId storageEngine validator validationLevel validationAction indexOptionDefaults collation viewOn pipeline clusteredIndex changeStreamPreAndPostImages"
        options = _checked(options, known)
        if name in self.getCollectionNames():
            raise ValueError(f"{name} exists")
        if "viewOn" in options:
            return self.createView(name, options["viewOn"], options.get("pipeline", []), {"collation": options.get("collation")})
        self._connection._store.options[self._name, name] = options
        return {"ok": 1}

    def createView(self, name: str, source: str, pipeline: list[dict], options: dict | None = None) -> dict:
        self._connection._store.views[self._name, name] = (source, pipeline if isinstance(pipeline, list) else [pipeline], (options or {}).get("collation"))
        return {"ok": 1}

    def dropDatabase(self, *_: Any) -> dict:
        self._connection._store.drop(self._name)
        return {"ok": 1, "dropped": self._name}

    def _frame(self, name: str) -> DataFrame:
        store = self._connection._store
        if (self._name, name) in store.views:
            source, pipeline, collation = store.views[self._name, name]
            return self._run(source, pipeline, {"collation": collation})
        df = store.read(self._name, name)
        options = store.options.get((self._name, name), {})
        seconds, field = options.get("expireAfterSeconds"), options.get("timeseries", {}).get("timeField")
        if seconds is not None and field in df.columns:
            df = df.where(F.col(quoted(field)) >= F.localtimestamp() - F.make_dt_interval(secs=F.lit(float(seconds))))
        return df

    def _context(self, options: dict, name: str | None = None) -> Context:
        store = self._connection._store
        sources: dict[str, Callable[[Any], DataFrame]] = {
            "$collStats": lambda spec: frame_of(self._spark, [{"ns": f"{self._name}.{name}", "storageStats": stats.collection_stats(store, self._name, name)}]),
            "$planCacheStats": lambda spec: frame_of(self._spark, [{"ns": f"{self._name}.{name}", "isCached": self._frame(name).is_cached}]),
            "$indexStats": lambda spec: frame_of(self._spark, [{"name": i["name"], "ns": f"{self._name}.{name}"} for i in Collection(self, name).getIndexes()]),
            "$currentOp": lambda spec: self._operations(),
            "$listLocalSessions": lambda spec: frame_of(self._spark, [{"_id": str(s.id)} for s in self._connection._sessions] or [{"_id": None}]).where("_id is not null"),
            "$listClusterCatalog": lambda spec: self._catalog(),
            "$shardedDataDistribution": lambda spec: frame_of(self._spark, [{"ns": f"{self._name}.{c}", **r} for c in store.collections(self._name) if (self._name, c) not in store.views for r in Collection(self, c).getShardDistribution()]),
        }
        return Context(self._spark, self._frame, Collation.of(options.get("collation")), Collection(self, name)._text_fields() if name else None, sources)

    def _operations(self) -> DataFrame:
        tracker = self._spark.sparkContext.statusTracker()
        rows = [{"opid": j, "status": tracker.getJobInfo(j).status} for j in tracker.getActiveJobsIds()]
        return frame_of(self._spark, rows or [{"opid": -1, "status": ""}]).where("opid >= 0")

    def _catalog(self) -> DataFrame:
        store = self._connection._store
        rows = [{"db": d, "ns": f"{d}.{c}", "type": "view" if (d, c) in store.views else "collection", "sharded": False} for d in store.databases() for c in store.collections(d)]
        return frame_of(self._spark, rows or [{"db": "", "ns": "", "type": "", "sharded": False}]).where("ns <> ''")

    def _run(self, name: str | None, pipeline: list[dict], options: dict) -> DataFrame:
        ctx = self._context(options, name)
        first = next(iter(pipeline[0])) if pipeline else ""
        df = None if name is None or first in ctx.sources or first in ("$documents", "$sql") else self._frame(name)
        return run_stages(df, pipeline, ctx)

    def _aggregate(self, name: str | None, pipeline: list[dict], options: dict) -> FrameCursor | dict:
        options = _checked(options, "collation allowDiskUse batchSize cursor explain")
        stages, sink = split_sink(pipeline)
        if stages and next(iter(stages[0])) == "$changeStream":
            from tessera.streaming.streams import ChangeStreamCursor

            return ChangeStreamCursor(self, name, stages[1:], stages[0]["$changeStream"] or {})
        df = self._run(name, stages, options)
        if options.get("explain"):
            return explained(df, options["explain"] if isinstance(options["explain"], str) else "queryPlanner")
        if sink:  # sinks run at once
            kind, spec = sink
            if kind == "$out":
                target = spec if isinstance(spec, str) else spec["coll"]
                db = self if isinstance(spec, str) else self.getSiblingDB(spec.get("db", self._name))
                db._connection._store.write(db._name, target, df)
            else:
                self._merge(df, spec)
            return FrameCursor(df.limit(0))
        out = FrameCursor(df)
        return out.batchSize(options["batchSize"]) if options.get("batchSize") else out

    def _merge(self, df: DataFrame, spec: Any) -> None:
        """Upsert rows into a collection by the keys ``on``: an anti-join for what stays and a join for what is merged."""
        options = {"into": spec} if isinstance(spec, str) else spec
        into = options["into"] if isinstance(options["into"], str) else options["into"]["coll"]
        db = self if isinstance(options["into"], str) else self.getSiblingDB(options["into"].get("db", self._name))
        on = options.get("on", "_id")
        on = on if isinstance(on, list) else [on]
        matched, missing = options.get("whenMatched", "merge"), options.get("whenNotMatched", "insert")
        store = db._connection._store
        if not store.current(db._name, into):
            store.write(db._name, into, df if missing == "insert" else df.limit(0))
            return
        store.write(db._name, into, merged_rows(store.read(db._name, into), df, on, matched, missing))

    def aggregate(self, *args: Any) -> FrameCursor | dict:
        options = {}
        if len(args) == 2 and isinstance(args[0], list):
            args, options = args[:1], args[1] or {}
        return self._aggregate(None, normalized(args), options)

    def sql(self, statement: str, options: dict | None = None) -> FrameCursor:
        """A Spark SQL query in which this database's collections are views."""
        for name in self.getCollectionNames():
            self._frame(name).createOrReplaceTempView(name)
        return FrameCursor(self._spark.sql(statement))

    def watch(self, pipeline: list[dict] | None = None, options: dict | None = None):
        from tessera.streaming.streams import ChangeStreamCursor

        return ChangeStreamCursor(self, None, pipeline or [], options or {})

    def _log(self, kind: str, documents: list[dict], name: str) -> None:
        """Append changes to the change log, an append-only folder, where somebody watches."""
        if self._connection._logging:
            from tessera.functions.values import stringify

            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)  # noqa: UP017
            rows = [{"_id": uuid.uuid4().hex, "operationType": kind, "db": self._name, "coll": name, "clusterTime": now, "document": stringify(plain(d))} for d in documents]
            frame_of(self._spark, rows).coalesce(1).write.mode("append").parquet(self._connection._log_folder)

    def stats(self, scale: Any = 1) -> dict:
        scale = scale if isinstance(scale, int | float) else scale.get("scale", 1)
        names = [n for n in self.getCollectionNames() if (self._name, n) not in self._connection._store.views]
        each = [stats.collection_stats(self._connection._store, self._name, n, scale) for n in names]
        return {"db": self._name, "collections": len(names), "objects": sum(e["count"] for e in each), "dataSize": sum(e["size"] for e in each), "storageSize": sum(e["storageSize"] for e in each), "indexes": sum(e["nindexes"] for e in each), "scaleFactor": scale, "ok": 1}

    def printCollectionStats(self, scale: float = 1) -> dict:
        return {n: Collection(self, n).stats(scale) for n in self.getCollectionNames() if (self._name, n) not in self._connection._store.views}

    def currentOp(self, query: dict | bool | None = None) -> dict:
        df = self._operations()
        df = df.where(sure_match(df, query)) if isinstance(query, dict) else df
        return {"inprog": [document_of(r) for r in df.collect()], "ok": 1}

    def killOp(self, opid: int) -> dict:
        """Cancel the Spark job of that number, and no other."""
        self._spark.sparkContext._jsc.sc().cancelJob(int(opid))
        return {"info": f"attempting to kill op {opid}", "ok": 1}

    def getReplicationInfo(self) -> dict:
        """Size and times of the change log: its first and last entry and the hours between them."""
        if not self._connection._logging:
            raise Unsupported("no change log is kept; call startLogging on the connection first")
        log = self._spark.read.parquet(self._connection._log_folder)
        files, at = self._connection._store._fs(self._connection._log_folder)
        row = stats.first_last_difference(log, "clusterTime").first()
        used = files.getContentSummary(at).getLength()
        hours = row["hours"] or 0.0
        return {"logSizeMB": None, "usedMB": math.ceil(used / 1024**2 * 100) / 100, "timeDiff": row["seconds"] or 0, "timeDiffHours": hours, "tFirst": str(row["first"]), "tLast": str(row["last"]), "now": str(dt.datetime.now(dt.timezone.utc))}  # noqa: UP017

    def version(self) -> str:
        return self._spark.version

    def hello(self) -> dict:
        return {"isWritablePrimary": True, "ok": 1}

    isMaster = hello

    def serverBits(self) -> int:
        return 64

    def serverBuildInfo(self) -> dict:
        return {"version": self._spark.version, "bits": 64, "ok": 1}

    def serverStatus(self, options: dict | None = None) -> dict:
        sc = self._spark.sparkContext
        return {"host": sc.master, "version": sc.version, "uptimeMillis": int(time.time() * 1000) - sc.startTime, "ok": 1}

    def hostInfo(self) -> dict:
        return {"system": {"numCores": self._spark.sparkContext.defaultParallelism}, "ok": 1}

    def listCommands(self) -> list[str]:
        return sorted(_COMMANDS)

    def commandHelp(self, name: str) -> str:
        return _COMMANDS[name].__doc__ or name

    def runCommand(self, command: dict | str, options: dict | None = None) -> dict:
        command = {command: 1, **(options or {})} if isinstance(command, str) else command
        name = next(iter(command))
        if name not in _COMMANDS:
            raise Unsupported(f"command {name}")
        return _COMMANDS[name](self, command)

    def adminCommand(self, command: dict | str) -> dict:
        return self.getSiblingDB("admin").runCommand(command)


def merged_rows(held: DataFrame, new: DataFrame, on: list[str], matched: str = "merge", missing: str = "insert") -> DataFrame:
    """``held`` with the rows of ``new`` put in by key: matched rows are merged, replaced or kept, others inserted or dropped."""
    if matched == "fail" and not held.join(new.select(*on), on, "left_semi").isEmpty():
        raise ValueError("a row matches")
    inserted = new.join(held.select(*on), on, "left_anti") if missing == "insert" else new.limit(0)
    if matched == "keepExisting":
        return held.unionByName(inserted, allowMissingColumns=True)
    if matched == "replace":
        replaced = new.join(held.select(*on), on, "left_semi")
        return held.join(new.select(*on), on, "left_anti").unionByName(replaced, allowMissingColumns=True).unionByName(inserted, allowMissingColumns=True)
    a, b = held.alias("a"), new.withColumn("_here", F.lit(True)).alias("b")
    condition = [F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in on]
    out = []
    for c in [*held.columns, *(c for c in new.columns if c not in held.columns)]:
        if c in held.columns and c in new.columns and c not in on:
            out.append(F.when(F.col("b._here"), F.col(f"b.{quoted(c)}")).otherwise(F.col(f"a.{quoted(c)}")).alias(c))
        else:
            out.append(F.col(f"{'a' if c in held.columns else 'b'}.{quoted(c)}").alias(c))
    return a.join(b, condition, "left").select(*out).unionByName(inserted, allowMissingColumns=True)


_COMMANDS: dict[str, Callable[[Database, dict], dict]] = {
    "ping": lambda db, c: {"ok": 1},
    "hello": lambda db, c: db.hello(),
    "buildInfo": lambda db, c: db.serverBuildInfo(),
    "count": lambda db, c: {"n": db[c["count"]].count(c.get("query"), {k: c[k] for k in ("limit", "skip") if k in c}), "ok": 1},
    "distinct": lambda db, c: {"values": db[c["distinct"]].distinct(c["key"], c.get("query")), "ok": 1},
    "find": lambda db, c: {"cursor": {"firstBatch": db[c["find"]].find(c.get("filter"), c.get("projection"), {k: c[k] for k in ("sort", "skip", "limit") if k in c}).toArray()}, "ok": 1},
    "aggregate": lambda db, c: {"cursor": {"firstBatch": db._aggregate(c["aggregate"] if isinstance(c["aggregate"], str) else None, c["pipeline"], {}).toArray()}, "ok": 1},
    "insert": lambda db, c: {"n": len(db[c["insert"]].insertMany(c["documents"]).insertedIds), "ok": 1},
    "delete": lambda db, c: {"n": sum(db[c["delete"]]._delete(d["q"], d.get("limit", 0) == 0, None).deletedCount for d in c["deletes"]), "ok": 1},
    "update": lambda db, c: {"n": sum(db[c["update"]]._update(u["q"], u["u"], u.get("multi", False), {"upsert": u.get("upsert", False)}).matchedCount for u in c["updates"]), "ok": 1},
    "create": lambda db, c: db.createCollection(c["create"], {k: v for k, v in c.items() if k != "create"}),
    "drop": lambda db, c: {"ok": int(db[c["drop"]].drop())},
    "dropDatabase": lambda db, c: db.dropDatabase(),
    "listCollections": lambda db, c: {"cursor": {"firstBatch": db.getCollectionInfos(c.get("filter"))}, "ok": 1},
    "listDatabases": lambda db, c: {"databases": [{"name": n} for n in db._connection.getDBNames()], "ok": 1},
    "collStats": lambda db, c: db[c["collStats"]].stats(c.get("scale", 1)),
    "dbStats": lambda db, c: db.stats(c.get("scale", 1)),
    "createIndexes": lambda db, c: {"createdIndexes": [db[c["createIndexes"]].createIndex(i["key"], {k: v for k, v in i.items() if k != "key"}) for i in c["indexes"]], "ok": 1},
    "listIndexes": lambda db, c: {"cursor": {"firstBatch": db[c["listIndexes"]].getIndexes()}, "ok": 1},
    "dropIndexes": lambda db, c: db[c["dropIndexes"]].dropIndexes(c.get("index", "*")),
    "validate": lambda db, c: db[c["validate"]].validate(),
    "findAndModify": lambda db, c: {"value": db[c["findAndModify"]].findAndModify(c), "ok": 1},
    "explain": lambda db, c: explained(db[c["explain"]["find"]].find(c["explain"].get("filter")).frame(), c.get("verbosity", "queryPlanner")),
}


class Connection:
    """Databases over one session and one folder; ``mount`` adds tables that are read in place."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._store = spark, Store(spark, root)
        self._sessions: list[Session] = []
        self._logging, self._log_folder = False, f"{root.rstrip('/')}/_changes"
        self._settings: dict[str, Any] = {"readPref": {"mode": "primary"}, "readConcern": None, "writeConcern": None, "causal": False}

    def mount(self, db: str, tables: dict[str, str]) -> Database:
        for name, path in tables.items():
            self._store.mount(db, name, path)
        return self.getDB(db)

    def getDB(self, name: str) -> Database:
        return Database(self, name)

    use = getDB

    def __getitem__(self, name: str) -> Database:
        return self.getDB(name)

    def getCollection(self, namespace: str) -> Collection:
        db, _, name = namespace.partition(".")
        return self.getDB(db).getCollection(name)

    def getDBNames(self) -> list[str]:
        return [n for n in self._store.databases() if not n.startswith("_")]

    def getDBs(self) -> dict:
        return {"databases": [{"name": n} for n in self.getDBNames()], "ok": 1}

    def show(self, what: str) -> Any:
        if what in ("dbs", "databases"):
            return self.getDBNames()
        raise Unsupported(f"show {what}")

    def getURI(self) -> str:
        return self._store.root

    def startSession(self, options: dict | None = None) -> Session:
        return Session(self, options)

    def close(self) -> None:
        for session in list(self._sessions):
            session.endSession()

    def bulkWrite(self, models: list[dict], options: dict | None = None) -> BulkWriteResult:
        """Operations on several collections, each with its ``namespace``, in order."""
        out = BulkWriteResult()
        for model in models:
            spec = dict(model)
            namespace, kind = spec.pop("namespace"), spec.pop("name")
            done = self.getCollection(namespace).bulkWrite([{kind: spec}], options)
            for f in ("insertedCount", "matchedCount", "modifiedCount", "deletedCount", "upsertedCount"):
                setattr(out, f, getattr(out, f) + getattr(done, f))
        return out

    def watch(self, pipeline: list[dict] | None = None, options: dict | None = None):
        from tessera.streaming.streams import ChangeStreamCursor

        return ChangeStreamCursor(self.getDB("admin"), None, pipeline or [], options or {}, everything=True)

    def startLogging(self) -> None:
        """Keep a change log from now on, which watching needs."""
        self._logging = True

    def resolve(self, ref: DBRef, db: str) -> dict | None:
        return self.getDB(ref.db or db).getCollection(ref.ref).findOne({"_id": ref.id})

    def setReadPref(self, mode: str, tags: Any = None, *_: Any) -> None:
        self._settings["readPref"] = {"mode": mode, "tagSet": tags}

    def getReadPref(self) -> dict:
        return self._settings["readPref"]

    def getReadPrefMode(self) -> str:
        return self._settings["readPref"]["mode"]

    def getReadPrefTagSet(self) -> Any:
        return self._settings["readPref"].get("tagSet")

    def setReadConcern(self, level: str) -> None:
        self._settings["readConcern"] = level

    def getReadConcern(self) -> Any:
        return self._settings["readConcern"]

    def setWriteConcern(self, concern: Any, *_: Any) -> None:
        self._settings["writeConcern"] = concern

    def getWriteConcern(self) -> Any:
        return self._settings["writeConcern"]

    def setCausalConsistency(self, on: bool = True) -> None:
        self._settings["causal"] = on

    def isCausalConsistency(self) -> bool:
        return self._settings["causal"]

    def convertShardKeyToHashed(self, value: Any) -> int:
        from tessera.functions.expressions import compile_expression
        from tessera.functions.scope import literal

        column = compile_expression({"$toHashedIndexKey": literal(value)}, Scope(self._spark.range(1).schema))
        return self._spark.range(1).select(column).first()[0]


def _unsupported(owner: type, names: str, why: str) -> None:
    for name in names.split():
        def call(self, *args: Any, _name: str = name, **kwargs: Any):
            raise Unsupported(f"{_name}: {why}")

        call.__name__ = name
        setattr(owner, name, call)


# Calls that concern servers, users and shards only.
_unsupported(
    Database,
    "createUser updateUser changeUserPassword logout dropUser dropAllUsers auth grantRolesToUser revokeRolesFromUser getUser getUsers "
    "createEncryptedCollection createRole updateRole dropRole dropAllRoles grantRolesToRole revokeRolesFromRole grantPrivilegesToRole "
    "revokePrivilegesFromRole getRole getRoles shutdownServer fsyncLock fsyncUnlock serverCmdLineOpts rotateCertificates getProfilingStatus "
    "setProfilingLevel setLogLevel getLogComponents cloneDatabase cloneCollection copyDatabase getLastErrorObj getLastError printShardingStatus "
    "printSecondaryReplicationInfo printReplicationInfo printSlaveReplicationInfo setSecondaryOk checkMetadataConsistency",
    "there is no server, user, shard or replica set here",
)
_unsupported(Collection, "compactStructuredEncryptionData getShardVersion configureQueryAnalyzer checkMetadataConsistency", "there are no shards or encrypted fields here")
_unsupported(Connection, "connect getClientEncryption getKeyVault setSlaveOk setSecondaryOk", "there is no server here")
