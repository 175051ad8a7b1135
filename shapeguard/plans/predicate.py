"""Small structured predicates: parsing what a caller sent, and compiling it.

Parsing rebuilds a query field by field, so anything a caller adds (a pattern, a
nested condition) is never carried along. Nothing a caller sends is evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeguard.functions.formats import KNOWN, matches, numeric
from shapeguard.functions.text import is_blank
from shapeguard.sources.table import quoted
from shapeguard.types import COMPARABLE, ROW_ID, ColumnInfo, Condition, Query, Refused

MAX_CONDITIONS = 3
CONDITION_KINDS = ("isEmpty", "equals", "matchesFormat", "compare", "lengthBetween")
OPERATORS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def malformed(reason: str) -> Refused:
    return Refused("tooManyConditions", reason)


def unknown(name: Any, columns: Iterable[ColumnInfo]) -> Refused:
    return Refused("unknownColumn", f"there is no column {name!r}; the columns are {', '.join(c.id for c in columns)}")


def whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def parse_query(raw: Any, columns: Iterable[ColumnInfo]) -> Query | Refused:
    """A checked query, or why it isn't one. Costs nothing and runs nothing."""
    columns = tuple(columns)
    if not isinstance(raw, Mapping):
        return malformed("a query is an object with conditions and a join")
    conditions = raw.get("conditions")
    if not isinstance(conditions, (list, tuple)):
        return malformed("conditions must be a list of one to three objects")
    if not 1 <= len(conditions) <= MAX_CONDITIONS:
        return malformed(f"a query has one to {MAX_CONDITIONS} conditions, this one has {len(conditions)}")
    if raw.get("join") not in ("all", "any"):
        return malformed("join must be all or any; there is no negation")
    parsed = []
    for one in conditions:
        found = parse_condition(one, columns)
        if isinstance(found, Refused):
            return found
        parsed.append(found)
    return Query(tuple(parsed), raw["join"])


def parse_condition(raw: Any, columns: tuple[ColumnInfo, ...]) -> Condition | Refused:
    if not isinstance(raw, Mapping):
        return malformed("a condition is an object")
    kind = raw.get("kind")
    if kind not in CONDITION_KINDS:
        return Refused("unknownFormat", f"a condition's kind is one of {', '.join(CONDITION_KINDS)}")
    column = next((c for c in columns if c.id == raw.get("column")), None)
    if column is None:
        return unknown(raw.get("column"), columns)
    if kind == "isEmpty":
        return Condition("isEmpty", column.id)
    if kind == "equals":
        value = raw.get("value")
        return Condition("equals", column.id, value=value) if isinstance(value, str) else malformed("equals compares with a string, as cells are strings")
    if kind == "matchesFormat":
        name = raw.get("format")
        if isinstance(name, str) and name in KNOWN:
            return Condition("matchesFormat", column.id, format=name)
        return Refused("unknownFormat", f"formats are named, never patterns: {', '.join(KNOWN)}")
    if kind == "compare":
        value, op = raw.get("value"), raw.get("op")
        if column.type not in COMPARABLE:
            return Refused("unknownColumn", f"{column.id} holds {column.type} values, and comparing needs numbers")
        if op not in OPERATORS:
            return malformed(f"compare uses one of {', '.join(OPERATORS)}")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            return malformed("compare needs a finite number")
        return Condition("compare", column.id, value=float(value), op=op)
    low, high = raw.get("min"), raw.get("max")
    if not (whole(low) and whole(high) and 0 <= low <= high):
        return malformed("lengthBetween needs whole numbers with 0 <= min <= max")
    return Condition("lengthBetween", column.id, min=low, max=high)


def compile_condition(condition: Condition) -> Column:
    c = quoted(condition.column)
    match condition.kind:
        case "isEmpty":
            return is_blank(c)
        case "equals":
            return c == F.lit(condition.value)
        case "matchesFormat":
            return matches(c, condition.format)
        case "compare":
            return F.coalesce(OPERATORS[condition.op](numeric(c), F.lit(condition.value)), F.lit(False))
        case "lengthBetween":
            return F.length(c).between(condition.min, condition.max)
    raise ValueError(condition.kind)


def compile_query(query: Query) -> Column:
    parts = [compile_condition(c) for c in query.conditions]
    return reduce(Column.__and__ if query.join == "all" else Column.__or__, parts)


def matching_rows(df: DataFrame, query: Query) -> DataFrame:
    return df.where(compile_query(query)).select(ROW_ID)
