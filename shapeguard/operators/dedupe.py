"""Near-duplicate rows by blocking and edit distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeguard.functions.fold import block_keys, fold, similarity
from shapeguard.functions.text import round3
from shapeguard.sources.shared import settled
from shapeguard.sources.table import quoted
from shapeguard.types import ROW_ID

MAX_PAIRS, MAX_BLOCK, MAX_COLUMNS = 50, 500, 4
DEFAULT_THRESHOLD, LEAST_THRESHOLD = 0.85, 0.5


def folded(df: DataFrame, columns: Sequence[str], ascii_only: bool = False) -> DataFrame:
    """_row_id, parts (folded cells), joined; rows that fold to nothing are left out."""
    parts = F.array(*[fold(quoted(c), ascii_only) for c in columns])
    rows = df.select(ROW_ID, parts.alias("parts")).withColumn("joined", F.trim(F.array_join("parts", " ")))
    return rows.where("joined <> ''")


def blocks(rows: DataFrame) -> DataFrame:
    """key, n: block keys and how many rows share them."""
    return rows.select(F.explode(block_keys(F.col("joined"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def skipped_blocks(rows: DataFrame, limit: int = MAX_BLOCK) -> DataFrame:
    """Blocks too large to compare, told only by size."""
    return blocks(rows).where(F.col("n") > limit)


def met(rows: DataFrame, limit: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison, by ``meet``: the blocks' rows, or with ``exact`` also
    those of larger blocks, cut into parts of ``limit`` that meet two by two."""
    own = rows.select(ROW_ID, "joined", F.length("joined").alias("size"), F.explode(block_keys(F.col("joined"))).alias("key"))
    sizes = blocks(rows).where((F.col("n") >= 2) if exact else F.col("n").between(2, limit))
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    keyed = own.join(sizes.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64(ROW_ID), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    name = lambda i, j: F.concat_ws(":", "key", i, j)
    left = keyed.withColumn("other", each).select(name("part", "other").alias("meet"), F.col(ROW_ID).alias("a"), F.col("joined").alias("ja"), F.col("size").alias("na"))
    right = keyed.withColumn("other", each).select(name("other", "part").alias("meet"), F.col(ROW_ID).alias("b"), F.col("joined").alias("jb"), F.col("size").alias("nb"))
    return left, right


def pairs(rows: DataFrame, threshold: float, limit: int = MAX_BLOCK, exact: bool = False) -> DataFrame:
    """a, b, score for all pairs of rows in a common block.

    A block has at most ``limit`` rows, so pairs grow in proportion to rows; larger ones
    are left out and told by ``skipped_blocks``, or compared as well if ``exact``. The
    length gap is tested within the join, the distance is bounded by what the
    threshold allows, and only pairs that pass are made distinct.
    """
    left, right = met(rows, limit, exact)
    longest = F.greatest("na", "nb")
    allowed = F.floor(longest.cast("double") * F.lit(1.0 - threshold)).cast("int")
    near = left.join(right, (left["meet"] == right["meet"]) & (F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= allowed))
    far = near.select("a", "b", longest.alias("longest"), allowed.alias("allowed"), "ja", "jb").withColumn("d", F.expr("levenshtein(ja, jb, allowed)"))
    score = round3(1 - F.col("d").cast("double") / F.col("longest"))
    return far.where("d >= 0").select("a", "b", score.alias("score")).where(F.col("score") >= threshold).groupBy("a", "b").agg(F.first("score").alias("score"))


def matched(found: DataFrame, rows: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """a, b, score, matched_columns of a few pairs."""
    own = rows.select(ROW_ID, "parts")
    a, b = own.toDF("a", "pa"), own.toDF("b", "pb")
    both = a.join(F.broadcast(found.join(F.broadcast(found.select("b").distinct().join(b, "b")), "b")), "a")  # MAX_PAIRS rows at most
    names = []
    for i, c in enumerate(columns):
        x, y = F.col("pa")[i], F.col("pb")[i]
        names.append(F.when(~((x == "") & (y == "")) & (similarity(x, y, threshold) >= threshold), F.lit(c)))
    return both.select("a", "b", "score", F.array_compact(F.array(*names)).alias("matched_columns"))


def find_duplicates(
    df: DataFrame, columns: Sequence[str], threshold: float = DEFAULT_THRESHOLD, ascii_only: bool = False, most: int = MAX_PAIRS, exact: bool = False
) -> DataFrame:
    """The best pairs first; a top-k that is never sorted whole. Rows are folded once."""
    rows = settled(folded(df, columns, ascii_only))
    best = settled(pairs(rows, threshold, exact=exact).orderBy(F.desc("score"), "a", "b").limit(most))
    return matched(best, rows, columns, threshold).orderBy(F.desc("score"), "a", "b")


def clamp(threshold: float | None) -> float:
    value = DEFAULT_THRESHOLD if threshold is None else float(threshold)
    return min(1.0, max(LEAST_THRESHOLD, value))


__all__ = ["blocks", "clamp", "find_duplicates", "folded", "pairs", "skipped_blocks"]
