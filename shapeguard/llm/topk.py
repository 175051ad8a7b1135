"""Exact top-k search by columnar branch and bound.

Components become integers, floor(1024 * x), stored in the narrowest type that holds
them all. The rows lie in vertical layout: blocks of rows, in each of them dimension blocks
one after another, those with the most mass first. For a query the inner product is
accumulated dimension block by dimension block; what the remaining dimensions can still
add or take away is bounded by the product of the remaining norms. Rows whose upper
bound falls below the k-th best lower bound are dropped and the survivors compacted.

Nothing is copied per query or per row: vectors and queries are written tables; a task
holds a bounded part of the rows and reads the queries, a bounded chunk at a time. The
k-th best score found so far is carried from one block of rows to the next. Every
query begins with the k-th best score among a few rows (``PILOT``), which no result can
fall below, so that a task returns little more than what belongs to the result.

Defined cases: vectors that are null or hold a null or non-finite component, and
rows without vec_id, take no part; shorter vectors count as padded with zeros, long ones
are taken whole; ties go to the smaller vec_id; a query's own row is the row itself, so
rows that repeat a vec_id are each asked and are candidates for each other; scores beyond
a long saturate; empty tables give an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeguard.llm.common import stored, written

ROW_BLOCK, QUERY_CHUNK, DIMENSIONS = 8192, 1024, 8
#: Rows that the first bound of every query comes from.
PILOT = 4096
#: Bytes of components that a task holds at once.
HELD = 64 << 20
EXACT = float(1 << 53)
OUT = "query bigint, query_id bigint, vec_id bigint, score bigint"
OUT_ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
LOWEST = -(1 << 63)


def quantised(column: Column) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, an array of longs."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & finite
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(x).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Columnar:
    """Rows in vertical layout with the norms of what remains after each dimension block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, step: int = DIMENSIONS):
        own = rows.astype(np.float64)
        self.ids, self.order = ids, np.argsort(-(own**2).sum(axis=0), kind="stable")
        self.cuts = range(0, own.shape[1], step)
        self.parts = [np.ascontiguousarray(own[:, self.order[c : c + step]]) for c in self.cuts]
        mass = np.array([(p * p).sum(axis=1) for p in self.parts]).reshape(len(self.parts), len(ids))
        self.left = np.sqrt(np.vstack([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, len(ids)))]))
        self.step = step

    def best(self, query: np.ndarray, own: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all rows but ``own`` (a place, or -1) that may be among the k best
        and reach ``floor``."""
        q = query[self.order].astype(np.float64)
        q_mass = np.array([(q[c : c + self.step] ** 2).sum() for c in self.cuts])
        q_left = np.sqrt(np.append(np.cumsum(q_mass[::-1])[::-1], 0.0))
        alive = np.arange(len(self.ids)) if own < 0 else np.delete(np.arange(len(self.ids)), own)
        score = np.zeros(len(alive))
        for b, c in enumerate(self.cuts):
            part = self.parts[b] if len(alive) == len(self.ids) else self.parts[b][alive]
            score = score + part @ q[c : c + self.step]
            reach = self.left[b + 1][alive] * (q_left[b + 1] * (1 + 1e-9)) + 1e-3
            least = float(floor)
            if len(alive) > k:
                least = max(least, np.partition(score - reach, len(alive) - k)[len(alive) - k])
            keep = score + reach >= least
            if keep.sum() < 0.9 * len(alive):
                alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
        found = np.rint(score).astype(np.int64)
        return alive[found >= floor], found[found >= floor]


class Plain(Columnar):
    """The same for components whose products no double holds: exact, saturating at a long."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows.astype(object)

    def best(self, query: np.ndarray, own: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        wide = self.rows @ query.astype(object) if self.rows.shape[1] else np.zeros(len(self.ids), object)
        found = np.array([max(LOWEST + 1, min((1 << 63) - 1, x)) for x in wide], np.int64)
        keep = found >= floor
        if own >= 0:
            keep[own] = False
        return np.flatnonzero(keep), found[keep]


class Part:
    """Some rows, a block after another, with their numbers and ids."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool, block: int):
        self.numbers, self.ids, self.rows, self.block = numbers, ids, rows, block
        self.kind = Columnar if exact and rows.shape[1] else Plain
        self.place = {n: i for i, n in enumerate(numbers.tolist())}

    def search(self, chunk: pa.RecordBatch, width: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query of a chunk the ids and scores of its k best rows here that reach its floor."""
        queries = matrix(chunk.column("v"), width)
        floors = chunk.column("floor").to_pylist()
        own = [self.place.get(n, -1) for n in chunk.column("row").to_pylist()]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in floors]
        for at in range(0, len(self.ids), self.block):
            ids = self.ids[at : at + self.block]
            rows = self.kind(ids, self.rows[at : at + self.block])
            for i, query in enumerate(queries):
                here = own[i] - at if at <= own[i] < at + len(ids) else -1
                found, scores = rows.best(query, here, k, floors[i])
                if len(found):
                    best[i] = top(np.r_[best[i][0], ids[found]], np.r_[best[i][1], scores], k)
                    if len(best[i][0]) == k:
                        floors[i] = max(floors[i], int(best[i][1][-1]))  # carried on to the next block
        return best


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _pilot(batches: Iterator[pa.RecordBatch], path: str, width: int, k: int, exact: bool, rows: int, chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    """Each query with the k-th best score that some of the rows give it."""
    few = next((b for b in stored(path, rows) if b.num_rows), None)
    part = None
    for batch in batches:
        if part is None:
            part = Part(few.column("row").to_numpy(), few.column("vec_id").to_numpy(), matrix(few.column("v"), width), exact, block)
        for at in range(0, batch.num_rows, chunk):
            own = batch.slice(at, chunk)
            own = pa.RecordBatch.from_arrays([*own.columns, pa.array([LOWEST] * own.num_rows, pa.int64())], names=[*own.schema.names, "floor"])
            floors = [int(s[-1]) if len(s) == k else LOWEST for _, s in part.search(own, width, k)]
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(floors, pa.int64())], names=own.schema.names)


def _search(batches: Iterator[pa.RecordBatch], path: str, width: int, k: int, exact: bool, held: int, chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    def found(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids = (np.concatenate([b.column(c).to_numpy() for b in own]) for c in ("row", "vec_id"))
        part = Part(numbers, ids, np.concatenate([matrix(b.column("v"), width) for b in own]), exact, block)
        for queries in stored(path, chunk):
            out = []
            asked = zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), part.search(queries, width, k), strict=True)
            for number, query_id, (best, scores) in asked:
                out.append((np.full(len(best), number), np.full(len(best), query_id), best, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=OUT_ARROW)

    own, size = [], 0
    for batch in batches:
        if batch.num_rows:
            own.append(batch)
            size += batch.num_rows * max(1, width) * 8
        if size >= held:
            yield from found(own)
            own, size = [], 0
    if own:
        yield from found(own)


def search(
    vectors: DataFrame, asked: Column, k: int = 10, row_block: int = ROW_BLOCK, query_chunk: int = QUERY_CHUNK, pilot: int = PILOT, held: int = HELD
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (see ``usable``) that are asked."""
    spark = vectors.sparkSession
    largest = F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))
    told = vectors.agg(F.max(F.size("v")).alias("width"), largest.alias("largest")).first()
    width, most = told["width"] or 0, told["largest"] or 0.0
    kind = "short" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    exact = most * most * max(1, width) < EXACT / 4
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"))
    path = written(numbered, "vectors")
    rows = spark.read.schema(numbered.schema).parquet(path)
    shape = {"width": width, "k": k, "exact": exact, "chunk": query_chunk, "block": row_block}
    bounded = rows.where(asked).mapInArrow(partial(_pilot, path=path, rows=pilot, **shape), f"row bigint, vec_id bigint, v array<{kind}>, floor bigint")
    queries = written(bounded, "queries")
    found = rows.mapInArrow(partial(_search, path=queries, held=held, **shape), OUT)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS own FROM v),
s AS (SELECT q.own, q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
      FROM n q JOIN n r ON q.own <> r.own WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 10
"""
