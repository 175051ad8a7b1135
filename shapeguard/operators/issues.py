"""Quality findings: eleven codes, each told by row ids and a count.

Two passes. The first gathers a column's own statistics (format and length
majorities, numeric share, distinctness, quartiles), all of them bounded; the
second tests every cell against them in one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeguard.functions.formats import classify, date_parts, day_number, is_placeholder, is_real_date, numeric
from shapeguard.functions.text import WS, is_blank, let, trimmed
from shapeguard.operators.profile import DISTINCT_CAP, first_rows, long_form
from shapeguard.sources.shared import settled
from shapeguard.types import ROW_ID

MAX_ROWS = 100
NUMERIC_SHARE, LENGTH_SHARE, KEY_SHARE, FENCE, LEAST_NUMBERS = 0.95, 0.9, 0.9, 3, 20


@dataclass(frozen=True)
class ColumnStats:
    """What the second pass needs to know about a column."""

    filled: int = 0
    numbers: int = 0
    leading_zeros: int = 0
    top_format: str | None = None
    formats: int = 0
    top_length: int | None = None
    top_length_count: int = 0
    lengths: int = 0
    low: float | None = None
    high: float | None = None
    repeated: tuple[str, ...] = field(default=())
    conflicted: tuple[str, ...] = field(default=())


def quartile_places(n: int) -> list[float]:
    return [(n - 1) * f for f in (0.25, 0.75)]


def ranked(counts: DataFrame, wanted: dict[str, set[int]]) -> dict[str, dict[int, float]]:
    """Per column the values at the wanted places of its sorted numbers; ``counts``: column, x, n.

    Values are counted before they are sorted, so a frequent one is a single row. Rows
    are range-partitioned; a total for each column and partition tells which partitions
    hold a wanted place, and only their rows are summed up one by one."""
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = settled(counts.repartitionByRange(parts, "column", "x").withColumn("p", F.spark_partition_id()))
    sums = placed.groupBy("column", "p").agg(F.sum("n").alias("n")).collect()  # columns + partitions rows, as each holds a range
    before, start, holds = {}, {}, []
    for r in sorted(sums, key=lambda r: (r["column"], r["p"])):
        c, at = r["column"], before.get(r["column"], 0)
        before[c] = at + r["n"]
        if any(at <= w < at + r["n"] for w in wanted[c]):
            start[c, r["p"]] = at
            holds.append((F.col("column") == c) & (F.col("p") == r["p"]))
    if not holds:
        return {}
    upto = F.sum("n").over(Window.partitionBy("column", "p").orderBy("x"))
    own = placed.where(reduce(Column.__or__, holds)).withColumn("upto", upto)
    offset = reduce(lambda acc, k: acc.when((F.col("column") == k[0]) & (F.col("p") == k[1]), start[k]), start, F.when(F.lit(False), 0))
    last = (offset + F.col("upto")).cast("long")
    hit = reduce(Column.__or__, [(F.col("column") == c) & (last - F.col("n") <= w) & (w < last) for c, places in wanted.items() for w in places])
    rows = own.where(hit).select("column", "x", (last - F.col("n")).alias("first"), last.alias("last")).collect()  # four a column at most
    return {c: {w: r["x"] for r in rows if r["column"] == c for w in wanted[c] if r["first"] <= w < r["last"]} for c in wanted}


def fences(values: DataFrame, counts: dict[str, int], k: int) -> dict[str, tuple[float, float]]:
    """Outer fences per column by linearly interpolated quartiles of (column, x); columns
    of which they say nothing are left out."""
    counts = {c: n for c, n in counts.items() if n >= max(LEAST_NUMBERS, k)}
    if not counts:
        return {}
    wanted = {c: {i for p in quartile_places(n) for i in (math.floor(p), math.ceil(p))} for c, n in counts.items()}
    each = values.where(F.col("column").isin(*counts)).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    found = ranked(each, wanted)
    out = {}
    for c, n in counts.items():
        low, high = (
            (a := found[c][math.floor(p)]) + (found[c][math.ceil(p)] - a) * (p - math.floor(p)) for p in quartile_places(n)
        )
        if high > low:
            out[c] = low - FENCE * (high - low), high + FENCE * (high - low)
    return out


def majorities(cells: DataFrame, kind: str) -> dict[str, tuple[object, int, int]]:
    """Per column: the most frequent kind (first seen of equals), its count, and how many kinds there are."""
    counts = cells.groupBy("column", kind).agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("seen"))
    best = counts.groupBy("column").agg(F.max_by(kind, F.struct("n", -F.col("seen"))).alias("kind"), F.max("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    return {r["column"]: (r["kind"], r["n"], r["kinds"]) for r in best.collect()}


def few(groups: DataFrame, value: str, hit: Column, at_least: dict[str, float]) -> dict[str, tuple[str, ...]]:
    """Per column of at most 1,000 different values, and as many as asked: the values that hit."""
    kinds = {r["column"]: r["n"] for r in groups.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [c for c, n in kinds.items() if n <= DISTINCT_CAP and n >= at_least.get(c, 0)]
    if not columns:
        return {}
    out: dict[str, list[str]] = {}
    for r in groups.where(F.col("column").isin(*columns) & hit).select("column", value).collect():  # 1,000 a column at most
        out.setdefault(r["column"], []).append(r[value])
    return {c: tuple(v) for c, v in out.items()}


def prepared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, _row_id, cell, fmt, x of every non-blank cell."""
    cells = long_form(df, columns).where(~is_blank(F.col("cell")))
    return cells.withColumns({"fmt": classify(F.col("cell")), "x": numeric(F.col("cell"))})


def column_stats(cells: DataFrame, columns: Sequence[str], k: int, codes: Sequence[str] | None = None) -> dict[str, ColumnStats]:
    """Statistics of prepared cells for the wanted codes (all of them, if not told), all columns in each pass."""
    want = lambda name: codes is None or name in codes
    c = F.col("cell")
    digits = F.regexp_replace(trimmed(c), r"\A-", "")
    zero = let(digits, lambda d: (F.length(d) > 1) & d.startswith("0") & ~d.startswith("0.")) & F.col("x").isNotNull()
    sums = cells.groupBy("column").agg(F.count(F.lit(1)).alias("filled"), F.count("x").alias("numbers"), F.count_if(zero).alias("zeros")).collect()
    filled, numbers = {r["column"]: r["filled"] for r in sums}, {r["column"]: r["numbers"] for r in sums}
    formats = majorities(cells, "fmt") if want("mixedFormat") else {}
    lengths = majorities(cells.withColumn("length", F.length(c)), "length") if want("inconsistentLength") else {}
    ranges = fences(cells.where("x IS NOT NULL").select("column", "x"), numbers, k) if want("outOfRange") else {}
    repeated = conflicted = {}
    if want("duplicateKey"):
        # Every value once can't repeat, so only the share from below is asked of the number of values.
        repeated = few(cells.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n")), "cell", F.col("n") > 1, {c: KEY_SHARE * n for c, n in filled.items()})
    if want("inconsistentCase"):
        folded = cells.groupBy("column", F.lower(trimmed(c)).alias("f")).agg((F.min(c) != F.max(c)).alias("several"))
        conflicted = few(folded, "f", F.col("several"), {})
    out = {name: ColumnStats() for name in columns}
    for r in sums:
        name = r["column"]
        top_format, _, n_formats = formats.get(name, (None, 0, 0))
        top_length, n_top, n_lengths = lengths.get(name, (None, 0, 0))
        low, high = ranges.get(name, (None, None))
        out[name] = ColumnStats(
            filled[name], numbers[name], r["zeros"], top_format, n_formats, top_length, n_top, n_lengths, low, high, repeated.get(name, ()), conflicted.get(name, ())
        )
    return out


def conditions(c: Column, s: ColumnStats, as_of: date | None) -> dict[str, Column]:
    """Which cells each code finds, given the column's statistics and the cells' fmt, x and parts."""
    fmt, parts, x, never = F.col("fmt"), F.col("parts"), F.col("x"), F.lit(False)
    today = F.lit(as_of.year * 10000 + as_of.month * 100 + as_of.day) if as_of else F.date_format(F.current_date(), "yyyyMMdd").cast("int")
    real = is_real_date(parts)
    numeric_column = s.filled > 0 and s.numbers / s.filled >= NUMERIC_SHARE and s.leading_zeros == 0
    steady = s.filled > 0 and s.lengths > 1 and s.top_length_count / s.filled >= LENGTH_SHARE
    return {
        "leadingWhitespace": c.rlike(rf"\A[{WS}]"),
        "trailingWhitespace": c.rlike(rf"[{WS}]\z"),
        "placeholderValue": is_placeholder(c),
        "impossibleDate": parts.isNotNull() & ~real,
        "futureDate": parts.isNotNull() & real & (day_number(parts) > today),
        "mixedFormat": fmt != s.top_format if s.formats > 1 else never,
        "nonNumericInNumericColumn": x.isNull() if numeric_column else never,
        "inconsistentLength": F.length(c) != s.top_length if steady else never,
        "outOfRange": (x < s.low) | (x > s.high) if s.low is not None else never,
        "duplicateKey": c.isin(*s.repeated) if s.repeated else never,
        "inconsistentCase": F.lower(trimmed(c)).isin(*s.conflicted) if s.conflicted else never,
    }


def findings(df: DataFrame, columns: Sequence[str], k: int, as_of: date | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """code, column, _row_id: every cell found, all columns in one pass.

    Cells are classified once and written down; the passes over them read only the
    fields they need, which costs less than running two dozen patterns again in each."""
    cells, hits = settled(prepared(df, columns)), None
    for name, stats in column_stats(cells, columns, k, codes).items():
        tests = [F.when(t, F.lit(n)) for n, t in conditions(F.col("cell"), stats, as_of).items() if codes is None or n in codes]
        own = F.array_compact(F.array(*tests))
        hits = F.when(F.col("column") == name, own) if hits is None else hits.when(F.col("column") == name, own)
    dated = cells.withColumn("parts", date_parts(F.col("cell"), F.col("fmt")))
    return dated.select(F.explode(hits).alias("code"), "column", ROW_ID)


def summary(found: DataFrame) -> DataFrame:
    """code, column, affected_count, truncated."""
    n = found.groupBy("code", "column").agg(F.count(F.lit(1)).alias("affected_count"))
    return n.withColumn("truncated", F.col("affected_count") > MAX_ROWS)


def row_ids(found: DataFrame) -> DataFrame:
    """code, column, rank, _row_id: the first hundred of each finding."""
    keyed = found.withColumn("__key", F.concat_ws("\0", "code", "column"))
    return first_rows(keyed, "__key", MAX_ROWS).select("code", "column", "rank", ROW_ID)
