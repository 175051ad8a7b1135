"""Describing columns: types, distinct counts, format histograms and samples.

All-column passes unpivot once and group by (column, cell), so they are one
shuffle however many columns there are; counts combine before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeguard.functions.formats import UNRECOGNISED, classify
from shapeguard.functions.mask import mask
from shapeguard.functions.text import is_blank, round3, trimmed
from shapeguard.sources.table import quoted
from shapeguard.types import ROW_ID

DISTINCT_CAP, MAX_BUCKETS, SAMPLE_ROWS, INFER_ROWS = 1000, 8, 16, 500
EXEMPLARS, EXEMPLAR_SCAN = 10, 200
AGREEMENT = 0.95
# Fixed value: words that make a column boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "ya", "tidak", "benar", "salah")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_row_id, column, cell) for the given columns."""
    own = [ROW_ID] if ROW_ID in df.columns else []
    return df.unpivot([quoted(c) for c in own], [quoted(c) for c in columns], "column", "cell")


def reduce_columns(df: DataFrame, parts: Mapping[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row: each named aggregate of its column's cells, all in one pass."""
    return df.agg(*[fold(quoted(column)).alias(name) for name, (column, fold) in parts.items()])


def reduce_rows(df: DataFrame, columns: Sequence[str], fold: Callable[..., Column]) -> DataFrame:
    """One row: an aggregate over rows, told of several columns' cells at once."""
    return df.agg(fold(*map(quoted, columns)))


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value_type from each column's first 500 non-blank cells.

    The row limit per column is taken before the shuffle too (window group limit)."""
    first = F.row_number().over(Window.partitionBy("column").orderBy(ROW_ID))
    cells = long_form(df, columns).where(~is_blank(F.col("cell"))).withColumn("at", first).where(F.col("at") <= INFER_ROWS)
    fmt = classify(F.col("cell"))
    shares = cells.withColumn("fmt", fmt).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.lower(trimmed(F.col("cell"))).isin(*BOOLEAN_WORDS)).alias("booleans"),
        F.count_if(F.col("fmt") == "integerPlain").alias("integers"),
        F.count_if(F.col("fmt").isin("decimalPoint", "decimalComma")).alias("decimals"),
        F.count_if(F.col("fmt").isin("dateIso", "dateDmySlash", "dateMdySlash", "dateDmyDot", "dateTextualMonth", "timestampIso")).alias("dates"),
    )
    need = AGREEMENT * F.col("n")
    rest = F.col("n") - F.col("integers") - F.col("decimals") - F.col("dates")
    label = (
        F.when(F.col("booleans") == F.col("n"), "boolean")
        .when(F.col("integers") >= need, "integer")
        .when((F.col("decimals") > 0) & (F.col("integers") + F.col("decimals") >= need), "decimal")
        .when(F.col("dates") >= need, "date")
        .when(rest >= need, "text")
        .otherwise("mixed")
    )
    named = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, column_index int")
    return named.join(shares.select("column", label.alias("value_type")), "column", "left").select(
        "column", "column_index", F.coalesce("value_type", F.lit("empty")).alias("value_type")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, empty_count, filled_count, distinct_exact over non-blank cells."""
    cells = long_form(df, columns).groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    blank = is_blank(F.col("cell"))
    return cells.groupBy("column").agg(
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("empty_count"),
        F.sum(F.when(blank, 0).otherwise(F.col("n"))).alias("filled_count"),
        F.count_if(~blank).alias("distinct_exact"),
    )


def capped(exact: Column) -> tuple[Column, Column]:
    """(count or null, marker): more than 1,000 different values are only called unique."""
    many = exact > DISTINCT_CAP
    return F.when(~many, exact), many


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: id, index, type, empty and distinct counts."""
    count, marker = capped(F.col("distinct_exact"))
    return (
        infer_types(df, columns)
        .join(distinct_counts(df, columns), "column", "left")
        .select(
            "column", "column_index", "value_type", F.coalesce("empty_count", F.lit(0)).alias("empty_count"),
            F.coalesce(count, F.when(F.col("distinct_exact").isNull(), 0)).alias("distinct_count"),
            F.coalesce(marker, F.lit(False)).alias("is_unique_marker"),
        )
    )


def unique_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose filled cells are all different (and more than one)."""
    found = distinct_counts(df, columns)
    return found.where((F.col("filled_count") > 1) & (F.col("distinct_exact") == F.col("filled_count"))).select("column", "filled_count")


def distinct_at_most(df: DataFrame, column: str, cap: int) -> DataFrame:
    """One row: different trimmed cells, blank included, or null beyond the cap."""
    kinds = df.select(trimmed(quoted(column)).alias("cell")).distinct().limit(cap + 1)
    n = F.count(F.lit(1))
    return kinds.agg(F.when(n <= cap, n).alias("distinct_count"), (n > cap).alias("more"))


def format_counts(df: DataFrame, column: str) -> DataFrame:
    """format, n over non-blank cells: 25 rows at most."""
    return df.where(~is_blank(quoted(column))).groupBy(classify(quoted(column)).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def format_buckets(df: DataFrame, column: str, k: int) -> DataFrame:
    """format, count, share, truncated: small and late buckets are folded into
    ``unrecognised``, and left out if even that stays under k."""
    one = Window.partitionBy(F.lit(1))  # over 25 rows at most
    large = F.count_if(F.col("n") >= k).over(one.orderBy(F.desc("n"), "format").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = format_counts(df, column).withColumn("kept", (F.col("n") >= k) & (large <= MAX_BUCKETS))
    counts = counts.withColumn("all_n", F.sum("n").over(one)).withColumn("truncated", F.count_if(~F.col("kept")).over(one) > 0)
    own = counts.withColumn("name", F.when(F.col("kept"), F.col("format")).otherwise(UNRECOGNISED))
    folded = own.groupBy(F.col("name").alias("format")).agg(
        F.sum("n").alias("count"), F.max("kept").alias("named"), F.max("all_n").alias("all_n"), F.max("truncated").alias("truncated")
    )
    share = round3(F.col("count") / F.col("all_n"))
    return folded.where(F.col("named") | (F.col("count") >= k)).select("format", "count", share.alias("share"), "truncated")


def profile(df: DataFrame, column: str) -> DataFrame:
    """One row: empty count, distinct count, shortest and longest non-blank cell."""
    c, blank = quoted(column), is_blank(quoted(column))
    cells = df.groupBy(c.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    own = is_blank(F.col("cell"))
    length = F.when(~own, F.length("cell"))
    count, marker = capped(F.count_if(~own))
    del blank
    return cells.agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("empty_count"),
        count.alias("distinct_count"),
        marker.alias("is_unique_marker"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
    )


def first_rows(df: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by row id, numbered from 1; limited before the shuffle."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(ROW_ID))
    return df.withColumn("rank", at).where(F.col("rank") <= n)


def format_samples(df: DataFrame, column: str, k: int) -> DataFrame:
    """format (as reported), raw_format, rank, _row_id and cell: the first 16 cells of
    each format whose bucket is reported."""
    cells = df.where(~is_blank(quoted(column))).select(ROW_ID, quoted(column).alias("cell"), classify(quoted(column)).alias("raw_format"))
    buckets = format_buckets(df, column, k).select("format")
    first = first_rows(cells, "raw_format", SAMPLE_ROWS)
    direct = first.join(F.broadcast(buckets), F.col("raw_format") == F.col("format"), "left")  # 9 rows at most
    named = direct.withColumn("format", F.coalesce("format", F.lit(UNRECOGNISED)))
    return named.join(F.broadcast(buckets), "format", "left_semi").select("format", "raw_format", "rank", ROW_ID, "cell")


def exemplars(samples: DataFrame, buckets: DataFrame, limit: int = EXEMPLARS) -> DataFrame:
    """rank, format, masked: distinct shapes, taken from the buckets in turn, in file
    order within a bucket. At most 25 x 16 sampled cells take part."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("count"), "format")
    seat = buckets.withColumn("seat", F.row_number().over(order)).select("format", "seat")
    first_seen = samples.groupBy("format", "raw_format").agg(F.min(ROW_ID).alias("seen"))
    own = Window.partitionBy("format").orderBy(F.desc(F.col("raw_format") == F.col("format")), "seen", "raw_format", ROW_ID)
    turns = samples.join(first_seen, ["format", "raw_format"]).withColumn("turn", F.row_number().over(own)).join(F.broadcast(seat), "format")
    scan = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("turn", "seat"))
    shown = turns.withColumn("scan", scan).where(F.col("scan") <= EXEMPLAR_SCAN).withColumn("masked", mask(F.col("cell")))
    distinct = shown.groupBy("format", "masked").agg(F.min("scan").alias("scan"))
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("scan"))
    return distinct.withColumn("rank", at).where(F.col("rank") <= limit).select("rank", "format", "masked")
