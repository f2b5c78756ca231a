"""Vector search: vectors lie in lists around k-means centres, and queries look into lists.

The exact search uses the distances to the centre, stored with each vector, to
leave out only what the triangle inequality proves to be too far away. Queries
are taken in blocks of bounded size; a block is broadcast and the vectors of
the lists it needs are read once, where they lie. Only ``k`` rows for each
query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek.functions import dense
from tomeseek.functions.scoring import best, norm
from tomeseek.plans.joins import SALTS
from tomeseek.session import written

# The scoring code travels with its tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(dense)

SCORE_DIGITS = 5
SLACK = 1e-6  # rounding errors of distances between unit vectors
ANYWHERE = 4.0  # more than any distance between unit vectors
# A block of queries: bounds its broadcast, and the table of queries by lists on the driver.
BLOCK_QUERIES = 4_096
BLOCK_PROBES = 4_000_000


@dataclass(frozen=True)
class VectorIndex:
    """``vectors`` (vec_id, embedding, list_dist; partitioned by list_id) and ``lists``
    (list_id, center, n, radius; one row for each list)."""

    spark: SparkSession
    path: str

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def build_vector_index(
    vectors: DataFrame, path: str, n_lists: int, seed: int = 7, centers: np.ndarray | None = None
) -> VectorIndex:
    """Vectors in ``n_lists`` lists, written to ``path``.

    The centres are learned from all vectors, or given, one row a list; they only decide how much a search
    can leave out. Every vector gets a list, but those that are NULL or hold a
    NULL or a value that is not finite, which take no part. A list is
    spread over several files, so one that holds much of the data is no
    single task's work.
    """
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    vectors = vectors.select("vec_id", "embedding").where(whole)
    if centers is None:
        centers = _learned(vectors, n_lists, seed)

    shared = spark.sparkContext.broadcast(centers)
    placed = vectors.mapInArrow(
        lambda batches: dense.nearest_centers(batches, shared.value),
        "vec_id bigint, embedding array<float>, list_dist double, list_id int",
    )
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    placed.repartition("list_id", spread).write.partitionBy("list_id").parquet(f"{path}/vectors")
    index = VectorIndex(spark, path)
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list_id int, center array<double>"
    )
    sizes = index.vectors().groupBy("list_id").agg(F.count("*").alias("n"), F.max("list_dist").alias("radius"))
    centers.join(F.broadcast(sizes), "list_id").coalesce(1).write.parquet(f"{path}/lists")
    return index


def _learned(vectors: DataFrame, n_lists: int, seed: int) -> np.ndarray:
    """Centres by k-means of all vectors at unit length."""
    wide = vectors.select(F.col("embedding").cast("array<double>").alias("wide"))
    wide = wide.withColumn("length", norm(F.col("wide")))
    wide = wide.select(array_to_vector(F.when(
        F.col("length") > 0, F.transform("wide", lambda x: x / F.col("length"))
    ).otherwise(F.col("wide"))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=10, initMode="random").fit(wide)
    return np.array(model.clusterCenters())


def vector_search_ivf(queries: DataFrame, index: VectorIndex, k: int, n_probe: int) -> DataFrame:
    """Cosine top-k among the ``n_probe`` lists nearest to each query: approximate."""
    def search(block: "_Block") -> DataFrame:
        return block.scan(index, block.nearest(n_probe), np.full(len(block.ids), ANYWHERE), k)

    return best(_in_blocks(queries, index, search, k), k, ties=("vec_id",))


def vector_search(queries: DataFrame, index: VectorIndex, k: int, first_lists: int = 2) -> DataFrame:
    """Cosine top-k over all vectors: exact.

    The nearest lists give each query k scores. The k-th of them bounds the
    distance of anything better, and a vector x in the list with centre c is
    compared only if ``|d(q, c) - d(x, c)|`` is within the bound.
    """
    def search(block: "_Block") -> DataFrame:
        first = block.scan(index, block.nearest(first_lists), np.full(len(block.ids), ANYWHERE), k)
        last = best(first, k, ties=("vec_id",)).where(F.col("rank") == k).select("query_id", "score").toArrow()
        bound = np.full(len(block.ids), ANYWHERE)
        # The k-th score was rounded; an equal rounded score may be up to one unit lower.
        least = last["score"].to_numpy() - 10.0 ** -SCORE_DIGITS
        bound[np.searchsorted(block.ids, last["query_id"].to_numpy())] = np.sqrt(np.maximum(2 - 2 * least, 0)) + SLACK
        return block.scan(index, block.distance - block.radius[None, :] <= bound[:, None], bound, k)

    return best(_in_blocks(queries, index, search, k), k, ties=("vec_id",))


class _Block:
    """A bounded number of queries, and their distances to the centres of all lists."""

    def __init__(self, queries, lists):
        queries = queries.sort_by("query_id").combine_chunks()
        lists = lists.sort_by("list_id").combine_chunks()
        self.ids = queries["query_id"].to_numpy()
        self.units, _ = dense.unit(dense.matrix(queries["embedding"].combine_chunks()))
        self.lists, self.radius = lists["list_id"].to_numpy(), lists["radius"].to_numpy()
        centers = dense.matrix(lists["center"].combine_chunks())
        self.distance = np.stack([np.linalg.norm(self.units - c, axis=1) for c in centers], axis=1)

    def nearest(self, n: int) -> np.ndarray:
        """Which lists (columns) are the ``n`` nearest of each query (row)."""
        order = np.argsort(self.distance, axis=1, kind="stable")
        chosen = np.zeros(self.distance.shape, dtype=bool)
        np.put_along_axis(chosen, order[:, :n], True, axis=1)
        return chosen

    def scan(self, index: VectorIndex, chosen: np.ndarray, bound: np.ndarray, k: int) -> DataFrame:
        """query_id, vec_id, score: each task's k best, reading only the chosen lists."""
        probes = {}
        for place in np.flatnonzero(chosen.any(axis=0)):
            numbers = np.flatnonzero(chosen[:, place])
            probes[int(self.lists[place])] = (numbers, self.distance[numbers, place], bound[numbers])
        shared = index.spark.sparkContext.broadcast((self.ids, self.units, probes))
        vectors = index.vectors().where(F.col("list_id").isin(list(probes)))
        return vectors.select("vec_id", "embedding", "list_dist", "list_id").mapInArrow(
            lambda batches: dense.nearest_vectors(batches, *shared.value, k, SCORE_DIGITS),
            "query_id bigint, vec_id bigint, score double",
        )


def _in_blocks(queries: DataFrame, index: VectorIndex, search: Callable[[_Block], DataFrame], k: int) -> DataFrame:
    lists = index.lists().select("list_id", "center", "radius").toArrow()
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n_blocks = -(-queries.count() // max(1, min(BLOCK_QUERIES, BLOCK_PROBES // max(1, len(lists)))))
    number = F.pmod(F.xxhash64("query_id"), F.lit(max(n_blocks, 1)))
    found = []
    for i in range(n_blocks):
        block = queries.where(number == i).toArrow()
        if block.num_rows:
            found.append(search(_Block(block, lists)))
            if n_blocks > 1:
                # Block by block: one block's queries and bounds are held at a time.
                found[-1] = written(best(found[-1], k, ties=("vec_id",)).drop("rank"), "block-hits")
    nothing = queries.limit(0).selectExpr("query_id", "query_id AS vec_id", "CAST(0 AS double) AS score")
    return reduce(DataFrame.unionByName, found, nothing)
