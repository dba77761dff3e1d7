"""The calls of a document shell that are not of a database: what is in use, paging, printing, settings."""

from __future__ import annotations

import time
from typing import Any

from tessera.functions.scope import Unsupported
from tessera.functions.values import stringify
from tessera.plans.api import Connection, Database
from tessera.plans.cursor import BaseCursor
from tessera.plans.results import CursorIterationResult


class ShellConfig:
    """Settings by name; an unknown name is an error."""

    # Defaults of settings that matter here.
    DEFAULTS = {"displayBatchSize": 20, "maxTimeMS": None, "inspectDepth": 6, "enableTelemetry": False}

    def __init__(self) -> None:
        self._values = dict(self.DEFAULTS)

    def get(self, name: str) -> Any:
        return self._values[name]

    def set(self, name: str, value: Any) -> str:
        if name not in self.DEFAULTS:
            raise KeyError(name)
        if name == "displayBatchSize" and not (isinstance(value, int) and value > 0):
            raise ValueError("displayBatchSize is a positive number")
        self._values[name] = value
        return f'Setting "{name}" has been changed'

    def reset(self, name: str) -> str:
        self._values[name] = self.DEFAULTS[name]
        return f'Setting "{name}" has been reset to its default value'


class Shell:
    """A connection, the database in use and the cursor that ``it`` goes on with."""

    def __init__(self, connection: Connection, database: str = "test"):
        self.connection, self.db = connection, connection.getDB(database)
        self.config, self._cursor = ShellConfig(), None

    def use(self, name: str) -> Database:
        self.db = self.connection.getDB(name)
        return self.db

    def show(self, what: str) -> list[str]:
        if what in ("dbs", "databases"):
            return self.connection.getDBNames()
        if what in ("collections", "tables"):
            return self.db.getCollectionNames()
        raise Unsupported(f"show {what}")

    def page(self, cursor: BaseCursor) -> CursorIterationResult:
        """The first page of a cursor, which becomes the one that ``it`` continues."""
        self._cursor = cursor.batchSize(self.config.get("displayBatchSize"))
        return self.it()

    def it(self) -> CursorIterationResult:
        return CursorIterationResult([], False) if self._cursor is None else self._cursor.it()

    def print(self, *values: Any) -> None:
        print(*(v if isinstance(v, str) else stringify(v) for v in values))

    printjson = print

    def sleep(self, ms: float) -> None:
        time.sleep(ms / 1000)

    def version(self) -> str:
        return self.db.version()

    def isInteractive(self) -> bool:
        return False

    def convertShardKeyToHashed(self, value: Any) -> int:
        return self.connection.convertShardKeyToHashed(value)

    def load(self, path: str) -> None:
        raise Unsupported("scripts are Python modules; import them")
