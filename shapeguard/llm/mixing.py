"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of n rows with target share w gets the rate N * w / n (N: the size of
the mixed corpus). Each document's number of copies inverts the Poisson
distribution of that mean at a uniform number hashed from seed and doc_id, so
the draw is repeatable on any cluster. Rates above ``LARGEST_MEAN`` are split
into equal parts, each inverted at a number of its own: the sum is again Poisson
and no exponential underflows. Copies are then dealt out and ordered by a hash
of (seed, doc_id, copy): one shuffle, whose keys are all different.

Defined cases: a null source is a source of its own; a null doc_id draws as the
empty string; repeated rows draw alike (equal ids, equal draw) and are each
copied; rows that share doc_id and copy number (repeated or null ids) have one
shuffle key and are dealt by their contents, so only rows equal in every column
meet in one task; null, empty and long texts are copied like any other; weights
are rescaled to the sources that occur, sources without a weight get 0; an empty
table gives an empty result; further columns keep their names and values, and
helpers take names that none of them has: if there is a column ``mix``, the added
one is ``mix_``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeguard.llm.common import free

LARGEST_MEAN = 32.0
#: Beyond this many sources the rates are joined by shuffle.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where nothing is left."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: int | None = None) -> DataFrame:
    """A row for each source: source, rate, parts, sums (the inverse's table).

    ``weights`` None: every source the same. ``size`` None: as many rows as now.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]
        given = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
        weighted = counts.withColumn("w", F.when(F.col("source").isNotNull(), given).otherwise(F.lit(0.0)))
    sums = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    total = F.lit(float(size)) if size is not None else F.col("all_n")
    mean = F.when(F.col("all_w") > 0, total * F.col("w") / F.col("all_w") / F.col("n")).otherwise(F.lit(0.0))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    return (
        weighted.crossJoin(F.broadcast(sums))  # one row
        .select("source", mean.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("sums", cdf(F.col("rate") / F.col("parts")))
    )


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, size: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixed corpus in shuffled order: the columns of ``docs`` and last ``mix``, a
    struct of n_copies, copy_no (from 1), rate and shuffle_key."""
    added, found, n, number = free(docs.columns, "mix", "rate_of", "n_drawn", "copy_drawn")
    table = rates(docs, weights, size).select(F.struct("source", "rate", "parts", "sums").alias(found))
    if len(table.select(F.col(found)["source"]).take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rate = F.col(found)
    joined = docs.join(table, docs["source"].eqNullSafe(rate["source"]), "inner")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def draw(acc: Column, part: Column) -> Column:
        u = uniform(F.lit(seed), doc, part.cast("string"))
        return acc + F.size(F.filter(rate["sums"], lambda s: s < u))

    copies = F.when(rate["rate"] > 0, F.aggregate(F.sequence(F.lit(1), rate["parts"]), F.lit(0), draw)).otherwise(F.lit(0))
    drawn = joined.withColumn(n, copies).where(F.col(n) > 0)
    numbered = drawn.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc, F.col(number).cast("string")).cast("binary"))
    mixed = F.struct(
        F.col(n).cast("long").alias("n_copies"), F.col(number).cast("long").alias("copy_no"), rate["rate"].alias("rate"), key.alias("shuffle_key")
    )
    out = numbered.select(*[F.col(f"`{c}`") for c in docs.columns], mixed.alias(added))
    # Equal rows meet at last, equal keys don't: the text's hash deals rows without an id of their own.
    return out.repartition(F.col(added)["shuffle_key"], F.xxhash64("text")).sortWithinPartitions(F.col(added)["shuffle_key"])


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
a AS (SELECT sum(n) AS all_n, CAST(count(*) AS DOUBLE) AS all_w FROM n),
r AS (SELECT source, CAST(all_n AS DOUBLE) * 1.0::DOUBLE / all_w / n AS rate FROM n, a),
q AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 32.0)) AS BIGINT) AS parts FROM r),
t AS (SELECT source, rate, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS below FROM (
        SELECT source, rate, parts, k, CASE WHEN k = 0 THEN exp(-rate / parts)
               ELSE exp(-rate / parts + k * ln(rate / parts) - lgamma(CAST(k + 1 AS DOUBLE))) END AS term
        FROM q, range(0, 150) AS g(k))),
d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS doc, doc_id, source, text FROM documents),
p AS (SELECT r, doc, d.source, unnest(range(1, parts + 1)) AS part FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT r, source, (CAST(('0x' || substr(md5('mix-1|' || doc || '|' || part), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM p),
c AS (SELECT r, count(t.k) AS n_copies FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source AND t.below < u.u GROUP BY r)
SELECT doc_id, source, CAST(n_copies AS BIGINT) AS n_copies, CAST(copy_no AS BIGINT) AS copy_no,
       md5('mix-1|order|' || doc || '|' || copy_no) AS shuffle_key, sha256(text) AS text_sha256
FROM (SELECT d.*, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM c JOIN d USING (r))
"""
