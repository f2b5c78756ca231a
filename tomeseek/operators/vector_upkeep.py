"""Keeping a vector index: vectors come and go, and lists that have grown too large are split.

An index of ``operators.vectors`` is the first segment. Each update writes one more segment
with the vectors that came or moved, the ids that are gone, the numbers of lists that were split, and the
table of lists as it is then. A segment is part of the index once its row in ``state`` is
written, which is last; nothing that is published is written again, so searches that hold an
earlier state go on, and an update that is cut off leaves the index as it was.

An update reads the ids of all vectors, to find those that are gone, and the vectors of the lists it changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.functions import dense
from tomeseek.operators.vectors import VectorIndex
from tomeseek.plans.joins import SALTS, is_small
from tomeseek.session import written

#: A list is split when it holds so many times the mean of all lists.
CROWDED = 3.0
#: Vectors of a crowded list from which its two centres are learned; all of its vectors are placed.
SAMPLE = 10_000
STEPS = 10
_VECTORS = "vec_id bigint, embedding array<float>, list_dist double, list_id int"


@dataclass(frozen=True)
class KeptIndex(VectorIndex):
    """The index in ``path`` with its updates 1 to ``last``."""

    last: int = 0

    def _folder(self, n: int) -> str:
        return f"{self.path}/update-{n}" if n else self.path

    def vectors(self) -> DataFrame:
        """Vectors of all segments without those that a later one has removed or placed anew."""
        live = None
        for n in range(self.last + 1):
            rows = self.spark.read.schema(_VECTORS).parquet(f"{self._folder(n)}/vectors").select("vec_id", "embedding", "list_dist", "list_id")
            later = range(n + 1, self.last + 1)
            split = [i for m in later for i in self._split(m)]
            if split:
                rows = rows.where(~F.col("list_id").isin(split))
            if later:
                gone = reduce(DataFrame.unionByName, [self.spark.read.schema("vec_id bigint").parquet(f"{self._folder(m)}/gone") for m in later])
                rows = rows.join(F.broadcast(gone) if is_small(gone) else gone, "vec_id", "left_anti")
            live = rows if live is None else live.unionByName(rows)
        return live

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(self.last)}/lists")

    def _split(self, n: int) -> list[int]:
        """Lists that update ``n`` split: a few rows."""
        return [r["list_id"] for r in self.spark.read.schema("list_id int").parquet(f"{self._folder(n)}/split").collect()]


def open_kept(index: VectorIndex) -> KeptIndex:
    """The newest state of the index in ``index.path``."""
    spark, state = index.spark, f"{index.path}/state"
    try:
        last = spark.read.schema("last int").parquet(state).agg(F.max("last")).first()[0]
    except Exception as missing:  # no update was ever published
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = 0
    return KeptIndex(spark, index.path, last or 0)


def update_vectors(index: VectorIndex, added: DataFrame, removed: DataFrame | None = None, crowded: float = CROWDED) -> KeptIndex:
    """The index with ``added`` (vec_id, embedding) put in and ``removed`` (vec_id) taken out.

    A vector that is added under an id that is there replaces it. NULL ids and vectors that are NULL or hold a
    value that is not finite take no part. Lists that hold more than ``crowded`` times the mean
    are split in two; a list all of whose vectors are alike stays as it is.
    """
    old = open_kept(index)
    spark, n = old.spark, old.last + 1
    folder = f"{old.path}/update-{n}"
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    added = written(added.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
                    .where(F.col("vec_id").isNotNull() & whole), "added-vectors")
    gone = added.select("vec_id") if removed is None else added.select("vec_id").unionByName(removed.select(F.col("vec_id").cast("bigint").alias("vec_id")))
    gone.where("vec_id is not null").distinct().write.mode("overwrite").parquet(f"{folder}/gone")

    lists = {r["list_id"]: r for r in old.lists().collect()}  # one row a list
    centers = {i: np.array(r["center"]) for i, r in lists.items()}
    # Which lists lose vectors: those that hold an id that is gone.
    left = spark.read.schema("vec_id bigint").parquet(f"{folder}/gone")
    had = old.vectors().select("vec_id", "list_id").join(F.broadcast(left) if is_small(left) else left, "vec_id", "left_semi")
    lost = {r["list_id"]: r["n"] for r in had.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    placed = written(_placed(added, centers), "placed-vectors")
    won = {r["list_id"]: r["n"] for r in placed.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    sizes = {i: r["n"] - lost.get(i, 0) + won.get(i, 0) for i, r in lists.items()}
    mean = sum(sizes.values()) / max(1, len(sizes))

    stay = old.vectors().join(F.broadcast(left) if is_small(left) else left, "vec_id", "left_anti")
    split, moved, next_id = [], None, max(centers, default=-1) + 1
    for i in sorted(i for i, size in sizes.items() if size > crowded * mean):
        own = stay.where(F.col("list_id") == i).select("vec_id", "embedding").unionByName(placed.where(F.col("list_id") == i).select("vec_id", "embedding"))
        two = _two_centers(own)
        if two is None:
            continue
        halves = {next_id: two[0], next_id + 1: two[1]}
        rows = _placed(own, halves)
        split, moved, next_id = [*split, i], rows if moved is None else moved.unionByName(rows), next_id + 2
        centers |= halves
    fresh = placed.where(~F.col("list_id").isin(split)) if split else placed
    fresh = fresh if moved is None else fresh.unionByName(moved)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    spark.createDataFrame([(i,) for i in split], "list_id int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/split")
    fresh.repartition("list_id", spread).write.mode("overwrite").partitionBy("list_id").parquet(f"{folder}/vectors")

    # Counts and radii of the lists that changed, from their vectors alone.
    changed = sorted({*lost, *won, *range(max(lists, default=-1) + 1, next_id)} - {*split})
    now = KeptIndex(spark, old.path, n)
    measured = {r["list_id"]: r for r in now.vectors().where(F.col("list_id").isin(changed)).groupBy("list_id").agg(
        F.count("*").alias("n"), F.max("list_dist").alias("radius")).collect()} if changed else {}
    rows = []
    for i, center in sorted(centers.items()):
        if i not in split:
            about = measured.get(i) if i in changed else lists[i]
            rows.append((i, [float(x) for x in center], about["n"] if about else 0, about["radius"] if about else 0.0))
    spark.createDataFrame(rows, "list_id int, center array<double>, n bigint, radius double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")
    spark.createDataFrame([(n,)], "last int").coalesce(1).write.mode("append").parquet(f"{old.path}/state")
    return now


def _placed(vectors: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """Vectors with the nearest of the given centres and their distance to it."""
    numbers = sorted(centers)
    if not numbers:
        raise ValueError("an index without lists takes no vectors: build it from some")
    shared = vectors.sparkSession.sparkContext.broadcast(np.stack([centers[i] for i in numbers]))
    rows = vectors.mapInArrow(lambda batches: dense.nearest_centers(batches, shared.value), "vec_id bigint, embedding array<float>, list_dist double, list_id int")
    return rows.withColumn("list_id", F.get(F.array(*map(F.lit, numbers)), F.col("list_id")).cast("int"))


def _two_centers(own: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres of two halves of a list, learned from SAMPLE of its vectors by hash; None if they are all alike."""
    drawn = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    units = dense.unit(dense.matrix(drawn["embedding"].combine_chunks()))[0]
    # The two that lie furthest from the mean and from each other begin.
    first = units[np.argmax(((units - units.mean(0)) ** 2).sum(1))]
    second = units[np.argmax(((units - first) ** 2).sum(1))]
    if np.allclose(first, second):
        return None
    for _ in range(STEPS):
        near = ((units - first) ** 2).sum(1) <= ((units - second) ** 2).sum(1)
        first, second = units[near].mean(0), units[~near].mean(0) if (~near).any() else second
    return first, second
