"""The values that callers and operators exchange."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Generic, Literal, TypeVar

from pyspark.sql import DataFrame

V = TypeVar("V")

ROW_ID = "_row_id"
ValueType = Literal["text", "integer", "decimal", "date", "boolean", "empty", "mixed"]
COMPARABLE = ("integer", "decimal", "mixed")
RefusalCode = Literal["belowK", "budgetExhausted", "tooManyConditions", "unknownColumn", "unknownFormat", "noDataset"]

# The journal's event kinds and the findings' codes.
EVENTS = (
    "datasetLoaded", "datasetCleared", "toolCalled", "answerSuppressed", "budgetExhausted", "transformProposed", "transformApplied",
    "transformUndone", "revealRequested", "revealGranted", "revealRefused", "questionAsked", "reportSubmitted",
)
ISSUE_CODES = (
    "mixedFormat", "leadingWhitespace", "trailingWhitespace", "inconsistentCase", "impossibleDate", "futureDate", "outOfRange",
    "nonNumericInNumericColumn", "placeholderValue", "duplicateKey", "inconsistentLength",
)


@dataclass(frozen=True)
class ColumnInfo:
    id: str
    index: int
    type: ValueType


@dataclass(frozen=True)
class Dataset:
    """One table of strings: ``_row_id`` (0, 1, ... in file order) and its columns."""

    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    source_name: str
    row_count: int

    def column(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.id == name), None)

    @property
    def names(self) -> list[str]:
        return [c.id for c in self.columns]


@dataclass(frozen=True)
class Condition:
    kind: Literal["isEmpty", "equals", "matchesFormat", "compare", "lengthBetween"]
    column: str
    value: Any = None
    format: str | None = None
    op: str | None = None
    min: int | None = None
    max: int | None = None


@dataclass(frozen=True)
class Query:
    conditions: tuple[Condition, ...]
    join: Literal["all", "any"] = "all"

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c.column for c in self.conditions))


@dataclass(frozen=True)
class Answered(Generic[V]):
    value: V
    remaining: int
    status: str = "answered"


@dataclass(frozen=True)
class Refused:
    code: RefusalCode
    reason: str
    remaining: int = 0
    status: str = "refused"


@dataclass(frozen=True)
class TransformSpec:
    """One of the ten transforms; ``kind`` says which of the other fields count."""

    kind: str
    column: str
    to: str | None = None
    length: int | None = None
    fill: str = "0"
    keep: str | None = None
    country_code: str | None = None

    @property
    def destructive(self) -> bool:
        return self.kind in ("dropColumn", "maskColumn")


@dataclass(frozen=True)
class TransformReport:
    spec: TransformSpec
    unchanged: int
    changed: int
    failed: int
    failed_row_ids: tuple[int, ...]
    examples: tuple[tuple[str, str], ...]
    destructive: bool


@dataclass
class Applied:
    id: str
    spec: TransformSpec
    applied_at: float
    changed: int
    previous: DataFrame | None = field(repr=False, default=None)
