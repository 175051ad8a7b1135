"""Tables that later jobs read instead of computing them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A smaller table is not worth a shuffle.
ROWS_WORTH_IT = 1000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only under a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shapeguard-"))
    return sc.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A table as scanned, dealt out first if its rows lie in fewer partitions than
    there are cores, as those of a file of one row group do.

    Only a scan of few partitions is asked where its rows are (a count without any column);
    a large table has more and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores:
        return df
    filled = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    total, most = sum(r["n"] for r in filled), max((r["n"] for r in filled), default=0)
    return df.repartition(cores) if total >= ROWS_WORTH_IT and most * cores > 2 * total else df


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once. For what may come out differently when computed
    again, such as range partitions, whose bounds come from a new sample each time."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any name survives
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
