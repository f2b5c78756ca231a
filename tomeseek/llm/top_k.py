"""Exact top-k by inner product, with a table of distances to pivots.

Every vector's Euclidean distances to the same few dozen vectors (pivots) are
computed once and written. For a query, the largest difference between its distance
to a pivot and a candidate's is a lower bound of their distance d, and as
2 q.x = |q|^2 + |x|^2 - d^2 it gives an upper bound of the score. Candidates are
evaluated from the highest bound on, and a query stops when the next bound is below
its k-th score so far: no later one can enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.session import written

PIVOTS = 32
#: Queries held by a task at a time; more are taken in blocks, one job each.
QUERIES = 4096
#: Pairs of a query and a candidate whose bounds are held at a time.
PAIRS = 2_000_000
#: What rounding may take from a bound.
SLACK = 0.05
STEP = 64


@dataclass
class Block:
    """Queries: ids, whole components, squared lengths and distances to the pivots."""

    ids: np.ndarray
    vectors: np.ndarray
    squares: np.ndarray
    distances: np.ndarray


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Without NULL ids and vectors that are NULL or hold a NULL or non-finite component."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pivot_table(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, v, distances of the vectors of ``width`` components; the pivots are PIVOTS of them, by hash of the id."""
    same = vectors.where(F.size("v") == width)
    rows = same.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()
    chosen = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            far = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in chosen], axis=1)
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1], far.ravel())
            yield pa.record_batch([batch.column(0), batch.column(1), rows], ["vec_id", "v", "distances"])

    return written(same.mapInArrow(measure, "vec_id bigint, v array<bigint>, distances array<double>"), "pivot-table")


def _exact(width: int, *parts: np.ndarray):
    """The kind of number in which inner products of these come out exact."""
    most = max(1, width) * max([1, *(int(np.abs(p).max(initial=0)) for p in parts)]) ** 2
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def search(block: Block, ids: np.ndarray, x: np.ndarray, distances: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Bring ``best`` (scores and ids of each query, best first) up to date with the candidates."""
    kind = _exact(x.shape[1], block.vectors, x)
    queries, x = block.vectors.astype(kind), x.astype(kind)
    squares = (x.astype(np.float64) ** 2).sum(1)
    rows = max(STEP, PAIRS // len(block.ids))
    for i in range(0, len(ids), rows):
        near, part = slice(i, i + rows), x[i : i + rows]
        bound = np.zeros((len(block.ids), len(part)), np.float32)
        gap = np.empty_like(bound)
        for p in range(distances.shape[1]):
            np.subtract(block.distances[:, p, None], distances[None, near, p], out=gap, casting="unsafe")
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
        bound = np.maximum(bound - SLACK, 0)
        upper = (block.squares[:, None] + squares[None, near] - bound.astype(np.float64) ** 2) / 2 + SLACK
        for q in range(len(block.ids)):
            scores, found = best[q]
            last = scores[-1] if len(scores) == k else -np.inf
            open_ = np.flatnonzero(upper[q] >= last)
            order, at, step = open_[np.argsort(-upper[q, open_], kind="stable")], 0, STEP
            while at < len(order) and upper[q, order[at]] >= last:
                some = order[at : at + step]
                some = some[ids[near][some] != block.ids[q]]
                got = (part[some] @ queries[q]).astype(object if kind is object else np.int64)
                scores, found = np.concatenate([scores, got]), np.concatenate([found, ids[near][some]])
                top = np.lexsort((found, -scores))[:k]
                scores, found = scores[top], found[top]
                last = scores[-1] if len(scores) == k else -np.inf
                at, step = at + step, step * 2
            best[q] = scores, found


def _top_of_tasks(table: DataFrame, block: Block, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(block.ids)
        for batch in batches:
            search(block, batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width), _matrix(batch.column(2), block.distances.shape[1]), best, k)
        sizes = [len(s) for s, _ in best]
        scores = np.concatenate([np.zeros(0, np.int64), *(np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64) for s, _ in best)])
        yield pa.record_batch([
            pa.array(np.repeat(block.ids, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *(f for _, f in best)])), pa.array(scores),
        ], ["query_id", "vec_id", "score"])

    return table.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the ids divisible by ``every`` (of rows that share an id, the smallest
    vector asks once). Candidates are all rows but those of the query's own id; a
    repeated row stands in the list as often. A query meets vectors of its own number of
    components. Scores beyond 64 bits stop at the largest number.
    """
    whole = written(whole_vectors(vectors, scale), "whole-vectors")
    out = None
    for width in sorted(r[0] for r in whole.select(F.size("v")).distinct().collect()):
        table = pivot_table(whole, width)
        asked = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "distances")).alias("q"))
        n = -(-asked.count() // QUERIES)
        for b in range(n):
            rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).select("vec_id", "q.*").orderBy("vec_id").collect()
            if not rows:
                continue
            v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)
            block = Block(np.array([r["vec_id"] for r in rows], np.int64), v, (v.astype(np.float64) ** 2).sum(1), np.array([r["distances"] for r in rows]))
            found = _first(_top_of_tasks(table, block, width, k), k)
            found = written(found, "top") if n > 1 else found
            out = found if out is None else out.unionByName(found)
    if out is None:
        return whole.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    return out.select("query_id", "rank", "vec_id", "score")
