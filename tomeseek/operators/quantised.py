"""Vector search on codes: each vector is kept as a few bytes, and only the best candidates are read whole.

A vector of unit length is cut into parts. Each part has a codebook, and the vector's
code is the number of the nearest entry in each. A query has a table of the inner products of its
parts with all entries; adding up the entries that a code names gives an estimate of the cosine. All codes
are read, 4 bits a part; the ``candidates`` best of each query are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek.functions import dense
from tomeseek.functions.scoring import best, norm
from tomeseek.plans.joins import is_small
from tomeseek.session import written

# The scoring code travels with its tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(dense)

SCORE_DIGITS = 5
#: Entries of a codebook: a code takes half a byte a part.
ENTRIES = 16
#: Vectors that the codebooks are learned from, by hash of the id; all vectors get a code.
SAMPLE = 20_000
STEPS = 12
#: Queries whose tables a task holds, and estimates that it holds at a time.
BLOCK_QUERIES = 1_024
ESTIMATES = 4_000_000


@dataclass(frozen=True)
class CodeIndex:
    """``codes`` (vec_id, code), ``vectors`` (vec_id, embedding) and ``books`` (part, entries), in ``path``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def books(self) -> np.ndarray:
        """Parts x ENTRIES x width of a part. Bounded: one row a part."""
        return np.array([r["entries"] for r in self.table("books").orderBy("part").collect()])


def learn_books(sample: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Codebooks by k-means of each part of the sampled unit vectors."""
    draw, books = np.random.default_rng(seed), []
    for own in np.split(sample, parts, axis=1):
        centers = own[draw.choice(len(own), ENTRIES, replace=len(own) < ENTRIES)]
        for _ in range(STEPS):
            nearest = _nearest(own, centers)
            held = np.bincount(nearest, minlength=ENTRIES)
            sums = np.stack([np.bincount(nearest, own[:, j], ENTRIES) for j in range(own.shape[1])], axis=1)
            centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
        books.append(centers)
    return np.array(books)


def _nearest(own: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1)[None] - 2 * own @ centers.T).argmin(1)


def encode(units: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (rows x half as many bytes as parts)."""
    codes = np.stack([_nearest(own, book) for own, book in zip(np.split(units, len(books), axis=1), books)], axis=1).astype(np.uint8)
    return codes[:, ::2] | codes[:, 1::2] << 4


def decode(packed: np.ndarray) -> np.ndarray:
    """The entry of each part."""
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def build_code_index(vectors: DataFrame, path: str, parts: int = 32, seed: int = 7) -> CodeIndex:
    """Codes of all ``vectors`` (vec_id, embedding), written to ``path``: parts / 2 bytes a vector.

    NULL ids and vectors that are NULL or hold a NULL or a value that is not finite take no part. All others have one
    width, which ``parts``, an even number, divides. The codebooks come from SAMPLE vectors; they only decide how good estimates are.
    """
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & whole)
    rows.write.parquet(f"{path}/vectors")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = dense.unit(dense.matrix(drawn["embedding"].combine_chunks()))[0] if drawn.num_rows else np.zeros((1, parts))
    books = learn_books(sample, parts, seed)
    shared = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = encode(dense.unit(dense.matrix(batch.column(1)))[0], shared.value)
            yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in packed], pa.binary())], ["vec_id", "code"])

    rows.mapInArrow(codes, "vec_id bigint, code binary").write.parquet(f"{path}/codes")
    entries = [(i, [[float(x) for x in e] for e in book]) for i, book in enumerate(books)]
    spark.createDataFrame(entries, "part int, entries array<array<double>>").coalesce(1).write.parquet(f"{path}/books")
    return CodeIndex(spark, path)


def estimates(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Estimated cosines (queries x vectors). ``tables``: queries x parts x ENTRIES."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for part in range(codes.shape[1]):
        out += tables[:, part][:, codes[:, part]]
    return out


def _candidates(index: CodeIndex, ids: np.ndarray, tables: np.ndarray, n: int) -> DataFrame:
    """query_id, vec_id, score (estimated): the ``n`` best of each task."""
    shared = index.spark.sparkContext.broadcast((ids, tables))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = shared.value
        scores, found = np.zeros((len(ids), 0), np.float32), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            names = batch.column(0).to_numpy()
            codes = decode(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(names), -1))
            step = max(1, ESTIMATES // len(ids))
            for i in range(0, len(names), step):
                scores = np.concatenate([scores, estimates(tables, codes[i : i + step])], axis=1)
                found = np.concatenate([found, np.broadcast_to(names[i : i + step], (len(ids), len(names[i : i + step])))], axis=1)
                if scores.shape[1] > n:
                    # Of equal estimates the smaller id, so that a task that is run again gives the same.
                    top = np.lexsort((found, -scores), axis=1)[:, :n]
                    scores, found = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
        for q in range(0, len(ids), 256):
            some = slice(q, q + 256)
            yield pa.record_batch([
                pa.array(np.repeat(ids[some], found.shape[1])), pa.array(found[some].ravel()), pa.array(scores[some].ravel().astype(np.float64)),
            ], ["query_id", "vec_id", "score"])

    return index.table("codes").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")


def vector_search_quantised(queries: DataFrame, index: CodeIndex, k: int, candidates: int = 100) -> DataFrame:
    """Cosine top-k among the ``candidates`` vectors of the best estimates for each query: approximate.

    query_id, vec_id, score, rank; scores are exact. Queries (query_id, embedding) are taken in blocks of BLOCK_QUERIES.
    """
    books = index.books()
    asked = written(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "asked-vectors")
    n = max(1, -(-asked.count() // BLOCK_QUERIES))
    found = []
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).orderBy("query_id").toArrow()
        if block.num_rows:
            units = dense.unit(dense.matrix(block["embedding"].combine_chunks()))[0]
            tables = np.stack([own @ book.T for own, book in zip(np.split(units, len(books), axis=1), books)], axis=1).astype(np.float32)
            part = best(_candidates(index, block["query_id"].to_numpy(), tables, candidates), candidates, ties=("vec_id",))
            # Written block by block, so that one block's tables are needed at a time.
            found.append(written(part.select("query_id", "vec_id"), "code-candidates"))
    nothing = asked.limit(0).select("query_id", F.col("query_id").alias("vec_id"))
    pairs = reduce(DataFrame.unionByName, found, nothing)
    unit = lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(F.transform(c, lambda y: y.cast("double")))), F.lit(0.0)))
    whole = index.table("vectors").select("vec_id", "embedding")
    near = (F.broadcast(pairs) if is_small(pairs) else pairs).join(whole, "vec_id").select("query_id", "vec_id", unit(F.col("embedding")).alias("x"))
    own = asked.select("query_id", unit(F.col("embedding")).alias("q"))
    scored = near.join(F.broadcast(own) if is_small(own) else own, "query_id")
    dot = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    return best(scored.select("query_id", "vec_id", F.round(dot, SCORE_DIGITS).alias("score")), k, ties=("vec_id",))
