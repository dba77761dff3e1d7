"""Cursors: lazy, chainable, read once, over a DataFrame that is planned when the first document is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scope import Scope, Unsupported
from tessera.operators.collation import Collation
from tessera.operators.predicates import Compiler
from tessera.operators.stages import near_order, project, sort
from tessera.plans.results import CursorIterationResult
from tessera.sources.documents import document_of


class BaseCursor:
    """Iteration shared by all cursors."""

    page = 20

    def __init__(self) -> None:
        self._rows: Iterator | None = None
        self._ahead: list = []
        self._maps: list[Callable] = []
        self._closed = self._done = False

    def frame(self) -> DataFrame:
        """The rows as a DataFrame, to go on with in Spark."""
        raise NotImplementedError

    def _fetch(self) -> Any:
        if self._rows is None:
            self._rows = self.frame().toLocalIterator(prefetchPartitions=True)
        document = document_of(next(self._rows))
        for f in self._maps:
            document = f(document)
        return document

    def hasNext(self) -> bool:
        if self._closed:
            return False
        if not self._ahead and not self._done:
            try:
                self._ahead.append(self._fetch())
            except StopIteration:
                self._done = True
        return bool(self._ahead)

    def next(self) -> Any:
        if not self.hasNext():
            raise StopIteration("no more documents")
        return self._ahead.pop()

    def tryNext(self) -> Any:
        return self.next() if self.hasNext() else None

    def __iter__(self) -> Iterator:
        while self.hasNext():
            yield self.next()

    def toArray(self) -> list:
        return list(self)

    def forEach(self, f: Callable[[Any], Any]) -> None:
        """Call f with each document until it returns False."""
        for document in self:
            if f(document) is False:
                break

    def map(self, f: Callable[[Any], Any]) -> BaseCursor:
        self._maps.append(f)
        return self

    def itcount(self) -> int:
        if self._rows is None and not self._maps and not self._closed:
            self._done = True
            return self.frame().count()
        return sum(1 for _ in self)

    def close(self) -> None:
        self._closed, self._ahead = True, []

    def isClosed(self) -> bool:
        return self._closed

    def isExhausted(self) -> bool:
        return (self._closed or self._done) and not self._ahead

    def objsLeftInBatch(self) -> int:
        return len(self._ahead)

    def pretty(self) -> BaseCursor:
        return self

    def disableBlockWarnings(self) -> BaseCursor:
        return self

    def it(self) -> CursorIterationResult:
        """The next page."""
        documents = []
        while len(documents) < self.page and self.hasNext():
            documents.append(self.next())
        return CursorIterationResult(documents, self.hasNext())

    def batchSize(self, n: int) -> BaseCursor:
        self.page = n
        return self

    def maxTimeMS(self, ms: int) -> BaseCursor:
        return self


class FrameCursor(BaseCursor):
    """A cursor of an aggregation or a command; sorting and the like add stages."""

    def __init__(self, df: DataFrame):
        super().__init__()
        self._df = df

    def frame(self) -> DataFrame:
        return self._df

    def projection(self, spec: dict) -> FrameCursor:
        self._df = project(self._df, spec, _Options())
        return self

    def sort(self, spec: dict) -> FrameCursor:
        self._df = sort(self._df, spec, _Options())
        return self

    def skip(self, n: int) -> FrameCursor:
        self._df = self._df.offset(n)
        return self

    def explain(self, verbosity: str = "queryPlanner") -> dict:
        return explained(self._df, verbosity)


@dataclass(frozen=True)
class _Options:
    """What stages ask of their context, where there is no collection around."""

    collation: Collation | None = None
    text_fields: tuple[str, ...] | None = None


class Cursor(BaseCursor):
    """A find. However its options are given, the filter comes first, then order, skip, limit and projection."""

    # Numbers of flags.
    FLAGS = {2: "tailable", 8: "oplogReplay", 16: "noCursorTimeout", 32: "awaitData", 64: "exhaust", 128: "partial"}

    def __init__(self, source: DataFrame, query: dict | None = None, projection: dict | None = None, text_fields: tuple[str, ...] | None = None, name: str = ""):
        super().__init__()
        self.source, self.query, self.name = source, query or {}, name
        self.options: dict[str, Any] = {"projection": projection} if projection else {}
        self._text_fields = text_fields

    def _set(self, name: str, value: Any) -> Cursor:
        if self._rows is not None:
            raise RuntimeError("the cursor is being read")
        self.options[name] = value
        return self

    def sort(self, spec: dict) -> Cursor:
        return self._set("sort", spec)

    def skip(self, n: int) -> Cursor:
        return self._set("skip", n)

    def limit(self, n: int) -> Cursor:
        return self._set("limit", n)

    def projection(self, spec: dict) -> Cursor:
        return self._set("projection", spec)

    def collation(self, spec: dict) -> Cursor:
        return self._set("collation", spec)

    def hint(self, spec: Any) -> Cursor:
        return self._set("hint", spec)

    def min(self, bounds: dict) -> Cursor:
        return self._set("min", bounds)

    def max(self, bounds: dict) -> Cursor:
        return self._set("max", bounds)

    def comment(self, text: str) -> Cursor:
        self.source.sparkSession.sparkContext.setJobDescription(text)
        return self._set("comment", text)

    def returnKey(self, on: bool = True) -> Cursor:
        return self._set("returnKey", on)

    def showRecordId(self, on: bool = True) -> Cursor:
        return self._set("showRecordId", on)

    def allowDiskUse(self, on: bool = True) -> Cursor:
        return self._set("allowDiskUse", on)

    def allowPartialResults(self) -> Cursor:
        return self._set("allowPartialResults", True)

    def maxAwaitTimeMS(self, ms: int) -> Cursor:
        return self._set("maxAwaitTimeMS", ms)

    def noCursorTimeout(self) -> Cursor:
        return self._set("noCursorTimeout", True)

    def oplogReplay(self) -> Cursor:
        return self._set("oplogReplay", True)

    def readPref(self, mode: str, *_: Any) -> Cursor:
        return self._set("readPref", mode)

    def readConcern(self, level: str) -> Cursor:
        return self._set("readConcern", level)

    def tailable(self, options: dict | None = None) -> Cursor:
        return self._set("tailable", options or {})

    def maxScan(self, *_: Any) -> Cursor:
        raise Unsupported("maxScan")

    def addOption(self, flag: int) -> Cursor:
        if flag == 4 or flag not in self.FLAGS:
            raise Unsupported(f"cursor flag {flag}")
        return self._set(self.FLAGS[flag], True)

    def _bound(self, bounds: dict, below: bool) -> Any:
        """Rows whose key lies below the bounds, as lexicographic order says: half open."""
        scope, out = Scope(self.source.schema), F.lit(False)
        for path, value in reversed(bounds.items()):
            column = scope.path(path)[0]
            out = (column < value) | ((column == value) & out)
        return out if below else ~out

    def _filtered(self) -> DataFrame:
        compiler = Compiler(Scope(self.source.schema), Collation.of(self.options.get("collation")), self._text_fields)
        df = self.source
        if self.options.get("showRecordId"):
            df = df.withColumn("$recordId", F.monotonically_increasing_id())
        if "$natural" in (self.options.get("sort") or {}):
            df = df.withColumn("$natural", natural_place(df))
        df = df.where(compiler.query(self.query))
        if "min" in self.options:
            df = df.where(self._bound(self.options["min"], False))
        if "max" in self.options:
            df = df.where(self._bound(self.options["max"], True))
        return df.orderBy(*near_order(df, compiler.order)) if compiler.order else df

    def frame(self) -> DataFrame:
        df, o = self._filtered(), self.options
        if o.get("sort"):
            if "$natural" in o["sort"]:
                way = o["sort"]["$natural"]
                df = df.orderBy(F.col("`$natural`").asc() if way > 0 else F.col("`$natural`").desc())
            else:
                df = sort(df, o["sort"], _Options(Collation.of(o.get("collation"))))
        df = self._cut(df)
        df = df.drop("$natural")
        if o.get("returnKey") and isinstance(o.get("hint"), dict):
            return df.select(*o["hint"])
        return project(df, o["projection"], _Options()) if o.get("projection") else df

    def _cut(self, df: DataFrame) -> DataFrame:
        df = df.offset(self.options["skip"]) if self.options.get("skip") else df
        return df.limit(abs(self.options["limit"])) if self.options.get("limit") else df

    def count(self) -> int:
        """The number of documents, after skip and limit."""
        return self._cut(self._filtered()).count()

    def size(self) -> int:
        return self.count()

    def explain(self, verbosity: str = "queryPlanner") -> dict:
        return explained(self.frame(), verbosity)


def natural_place(df: DataFrame) -> Column:
    """Where a row is stored: by version, file and place in the file, which is the order of insertion until an update rewrites the collection. Rows
    that are computed have no such place; theirs is that of their partitions."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        df.select(place)  # only analysed
    except AnalysisException:
        return F.monotonically_increasing_id()
    return place


def explained(df: DataFrame, verbosity: str = "queryPlanner") -> dict:
    """The plans of a frame; executionStats also runs it and counts."""
    plans = df._jdf.queryExecution()
    out = {"queryPlanner": {"parsedQuery": plans.logical().toString(), "winningPlan": plans.executedPlan().toString(), "optimizedPlan": plans.optimizedPlan().toString()}, "ok": 1}
    if verbosity in ("executionStats", "allPlansExecution"):
        out["executionStats"] = {"nReturned": df.count(), "executionSuccess": True}
    return out
