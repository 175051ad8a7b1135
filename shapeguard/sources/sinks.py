"""Sinks for cleaned data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shapeguard.sources.table import quoted
from shapeguard.types import ROW_ID, Dataset


def in_file_order(dataset: Dataset) -> DataFrame:
    return dataset.df.orderBy(ROW_ID).select(*[quoted(c) for c in dataset.names])


def write_csv(dataset: Dataset, path: str, single_file: bool = False) -> None:
    """CSV with a header, in file order; part files sort like rows unless one is asked for."""
    out = in_file_order(dataset)
    out = out.coalesce(1) if single_file else out
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(dataset: Dataset, path: str) -> None:
    dataset.df.write.parquet(path)
