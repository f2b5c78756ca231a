"""Fusing rankings, and measuring them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.functions.scoring import best


def rank_fusion(rankings: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: score = sum of 1 / (c + rank) over the rankings."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "chunk", "rank") for r in rankings])
    fused = rows.groupBy("query_id", "doc_id", "chunk").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))), 8).alias("score")
    )
    return best(fused, k)


def _placed(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, doc_id, place of the documents known to be right; the place is NULL where the document was not found.

    A document's rank is the place of its best passage among the documents found.
    """
    ranked = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy("best_rank", "doc_id")
    ranked = ranked.withColumn("place", F.row_number().over(order)).drop("best_rank")
    return truth.select("query_id", "doc_id").distinct().join(ranked, ["query_id", "doc_id"], "left")


def paired_test(a: DataFrame, b: DataFrame, truth: DataFrame, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """One row that compares two rankings by reciprocal rank, query by query: n_queries, mean_a, mean_b, difference, p_value.

    If neither ranking were better, each query's difference could as well have the
    other sign. Each round gives every query a sign, by a hash of seed, round and
    query, and adds the differences up; ``p_value`` is the share of rounds, the real signs
    counted as one, whose sum is as far from 0 as the real one. Differences are whole numbers of 1e-9,
    so sums do not depend on their order. A query that no ranking answers counts as equal.

    All rounds are sums in one pass; what leaves a task is one row a round.
    """
    def gain(hits: DataFrame, name: str) -> DataFrame:
        first = _placed(hits, truth).groupBy("query_id").agg(F.min("place").alias("first"))
        return first.select("query_id", F.coalesce(F.round(F.lit(1e9) / F.col("first")), F.lit(0.0)).cast("bigint").alias(name))

    both = gain(a, "a").join(gain(b, "b"), "query_id").withColumn("d", F.col("a") - F.col("b"))
    drawn = both.select("a", "b", "d", "query_id", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    # Round 0 has the real signs.
    heads = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "round", "query_id")), 1, 1) < "8"
    sums = drawn.groupBy("round").agg(
        F.sum(F.when((F.col("round") == 0) | heads, F.col("d")).otherwise(-F.col("d"))).alias("total"),
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))
    real = F.max(F.when(F.col("round") == 0, F.abs("total")))
    # One row a round: at most ``rounds`` + 1.
    sums = sums.groupBy().agg(
        F.max("n").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"), real.alias("real"), F.collect_list(F.abs("total")).alias("totals"))
    far = F.size(F.filter("totals", lambda t: t >= F.col("real")))
    mean = lambda c: F.round(c / F.col("n") / 1e9, 6)
    return sums.where("n is not null").select(
        F.col("n").alias("n_queries"), mean(F.col("a")).alias("mean_a"), mean(F.col("b")).alias("mean_b"), mean(F.col("a") - F.col("b")).alias("difference"),
        F.round(far / F.lit(float(rounds + 1)), 6).alias("p_value"))


def retrieval_eval(hits: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each k: queries with a known answer, recall, MRR and nDCG at k.

    A document's rank is the place of its best passage among the documents
    found. All sums are over (query_id, doc_id), with a partial sum first.
    """
    placed = _placed(hits, truth)
    cut = placed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.col("place") <= F.col("k")
    gain = F.lit(1.0) / F.log2(F.col("place") + 1.0)
    by_query = cut.groupBy("query_id", "k").agg(
        F.count("*").alias("n_true"),
        F.sum(F.when(inside, 1).otherwise(0)).alias("found"),
        F.min(F.when(inside, F.col("place"))).alias("first_place"),
        F.sum(F.when(inside, gain).otherwise(F.lit(0.0))).alias("dcg"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_true"), F.col("k").cast("bigint")).cast("int")), F.lit(0.0),
        lambda total, i: total + F.lit(1.0) / F.log2(i + 1.0),
    )
    return by_query.groupBy("k").agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.col("found") / F.col("n_true")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_place"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"),
    )
