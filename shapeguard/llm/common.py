"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master (tests) may go without the setting; it then gets a
    temporary folder, as everything runs in one process there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shapeguard-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> str:
    """The path of ``df`` as a table in the shared folder."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs
    neither recompute it nor depend on the executors that made it."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def stored(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, for a task that goes through all of them."""
    from pyarrow import fs, parquet

    store, root = fs.FileSystem.from_uri(path)
    for file in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as stream:
                yield from parquet.ParquetFile(stream).iter_batches(batch_size=rows)


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with at least so many rows, and with over a 10,000th of them, is hot: there are fewer than ``MOST_HOT``.
LEAST_HOT, MOST_HOT = 500, 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the further columns of ``table``, which has a row for every ``key``.

    Rows of a hot key would meet in one task. There are at most ``MOST_HOT`` such
    keys, so their rows of ``table`` are broadcast; all other keys are joined by shuffle.
    ``total``: the number of rows; both tables are written ones, as both are read twice.
    """
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(LEAST_HOT, total // MOST_HOT)).select(key)
    hot = F.broadcast(table.join(F.broadcast(often), key, "left_semi"))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


#: Rows that a task holds as Python objects at once.
ROWS_AT_ONCE = 512


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (slices, so nothing is copied)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
