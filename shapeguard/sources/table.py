"""Any DataFrame as a table of strings with dense row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.sources.shared import settled
from shapeguard.types import ROW_ID, ColumnInfo, Dataset


def quoted(name: str) -> Column:
    """A column by its whole name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, order: Sequence[Column], name: str = ROW_ID) -> DataFrame:
    """``df`` with dense numbers 0, 1, ... in ``order``, without a global window.

    Rows are range-partitioned and sorted; a partition's offset is the sum of the
    counts before it, so only one count a partition reaches the driver. Partitions and
    places are written down before they are counted, as their bounds come from a sample
    that a second run would not repeat.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = settled(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    local = F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__p") + 1)
    return placed.withColumn(name, offset + local).drop("__p", "__m")


def number_text(c: Column) -> Column:
    """A double's shortest digits that read back as the same double; plain from 10^-7 to
    below 10^20, with an exponent beyond, NaN and Infinity by name."""
    text, size = c.cast("string"), F.abs(c)

    def plain(fraction: int) -> Column:
        digits = F.regexp_replace(text.cast(f"decimal(38,{fraction})").cast("string"), "0+$", "")
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    large, small = (size >= 1e7) & (size < 1e20), (size < 1e-3) & (size >= 1e-7)
    return F.when(large, plain(17)).when(small, plain(30)).otherwise(text)


def as_text(field: T.StructField) -> Column:
    """A typed column as the text a file would hold; null is empty."""
    c = quoted(field.name)
    text = number_text(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
    return F.coalesce(text, F.lit("")).alias(field.name)


def as_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The chosen (or all atomic) columns as strings, ``_row_id`` kept if there."""
    fields = [f for f in df.schema if f.name != ROW_ID and (f.name in columns if columns else not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)))]
    own = [quoted(ROW_ID)] if ROW_ID in df.columns else []
    return df.select(*own, *map(as_text, fields))


def from_dataframe(df: DataFrame, order: Sequence[str] | None = None, source_name: str = "dataframe", as_row_id: str | None = None) -> Dataset:
    """A dataset from any DataFrame. Rows are numbered in ``order`` (all columns, if
    not given), or ``as_row_id`` names a column that is already dense from 0."""
    from shapeguard.operators.profile import infer_types

    if as_row_id:
        own = df.withColumnRenamed(as_row_id, ROW_ID)
    else:
        own = numbered(df, [quoted(c) for c in order or df.columns])
    text = as_strings(own)
    names = [c for c in text.columns if c != ROW_ID]
    types = {r["column"]: r["value_type"] for r in infer_types(text, names).collect()}
    infos = tuple(ColumnInfo(n, i, types.get(n, "empty")) for i, n in enumerate(names))
    return Dataset(text, infos, source_name, text.count())
