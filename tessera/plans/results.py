"""What calls return."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class InsertOneResult:
    acknowledged: bool
    insertedId: Any


@dataclass(frozen=True)
class InsertManyResult:
    acknowledged: bool
    insertedIds: list


@dataclass(frozen=True)
class UpdateResult:
    acknowledged: bool
    insertedId: Any
    matchedCount: int
    modifiedCount: int
    upsertedCount: int


@dataclass(frozen=True)
class DeleteResult:
    acknowledged: bool
    deletedCount: int


@dataclass
class BulkWriteResult:
    acknowledged: bool = True
    insertedCount: int = 0
    matchedCount: int = 0
    modifiedCount: int = 0
    deletedCount: int = 0
    upsertedCount: int = 0
    insertedIds: dict = field(default_factory=dict)
    upsertedIds: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CursorIterationResult:
    documents: list
    cursorHasMore: bool


@dataclass(frozen=True)
class CommandResult:
    type: str
    value: dict
