"""Grouped metrics and cross tables with small groups suppressed or merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeguard.functions.formats import numeric
from shapeguard.functions.text import rounded_metric
from shapeguard.sources.table import quoted

MAX_GROUPS, MAX_AXIS, MAX_CELLS, EXTREME_MULTIPLE = 25, 12, 100, 2
METRICS = ("count", "sum", "mean", "min", "max")


def group_stats(df: DataFrame, by: str, over: str | None = None, where: Column | None = None) -> DataFrame:
    """group_key, n and, over a numeric column, numbers, total, least, most."""
    rows = df if where is None else df.where(where)
    key = quoted(by).alias("group_key")
    if over is None:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Exact sums whatever the order; beyond a decimal's reach, sums of doubles.
    value = rows.select(key, numeric(quoted(over)).alias("x")).withColumn("d", F.col("x").try_cast("decimal(38,9)"))
    return value.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("x").alias("numbers"),
        F.when(F.max(F.abs("x")) < 1e24, F.try_sum("d").cast("double")).otherwise(F.sum("x")).alias("total"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
    )


def metric(fn: str, k: int) -> Column:
    """The metric, or null where too few numbers back it."""
    if fn == "count":
        return F.col("n").cast("double")
    enough, extreme = F.col("numbers") >= k, (F.col("n") >= EXTREME_MULTIPLE * k) & (F.col("numbers") >= EXTREME_MULTIPLE * k)
    value, shown = {
        "sum": (F.col("total"), enough),
        "mean": (F.col("total") / F.col("numbers"), enough),
        "min": (F.col("least"), enough & extreme),
        "max": (F.col("most"), enough & extreme),
    }[fn]
    return F.when(shown, rounded_metric(value))


def aggregate(df: DataFrame, by: str, fn: str, over: str | None, k: int, where: Column | None = None) -> DataFrame:
    """group_key, is_other, row_count, group_count, value, suppressed: the 25 largest
    groups of at least k rows, and one row for all others together."""
    stats = group_stats(df, by, over if fn != "count" else None, where)
    kept = stats.where(F.col("n") >= k).orderBy(F.desc("n"), "group_key").limit(MAX_GROUPS)
    named = kept.select(
        "group_key", F.lit(False).alias("is_other"), F.col("n").alias("row_count"), F.lit(1).cast("long").alias("group_count"),
        metric(fn, k).alias("value"),
    ).withColumn("suppressed", F.col("value").isNull())
    sums = [F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("r")]
    rest = stats.agg(*sums).crossJoin(kept.agg(*[s.alias(f"kept_{a}") for s, a in zip(sums, "gr", strict=True)]))  # one row each
    other = rest.where("g > kept_g").select(
        F.lit(None).cast("string").alias("group_key"), F.lit(True).alias("is_other"), (F.col("r") - F.col("kept_r")).alias("row_count"),
        (F.col("g") - F.col("kept_g")).alias("group_count"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("suppressed"),
    )
    return named.unionByName(other)


def axis(df: DataFrame, column: str, name: str, k: int) -> DataFrame:
    """The 12 largest keys of at least k rows."""
    counts = df.groupBy(quoted(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= k).orderBy(F.desc("n"), name).limit(MAX_AXIS).select(name)


def crosstab(df: DataFrame, rows: str, columns: str, k: int) -> DataFrame:
    """row_key, column_key, count, suppressed for every pair of axis keys (12 x 12 at most)."""
    pairs = axis(df, rows, "row_key", k).crossJoin(F.broadcast(axis(df, columns, "column_key", k)))
    joint = df.groupBy(quoted(rows).alias("row_key"), quoted(columns).alias("column_key")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    hidden = (n > 0) & (n < k)
    return pairs.join(joint, ["row_key", "column_key"], "left").select("row_key", "column_key", F.when(~hidden, n).alias("count"), hidden.alias("suppressed"))


def reported(n: Column, k: int) -> tuple[Column, Column]:
    """(count or null, suppressed): 1 to k-1 rows aren't told."""
    hidden = (n > 0) & (n < k)
    return F.when(~hidden, n), hidden
