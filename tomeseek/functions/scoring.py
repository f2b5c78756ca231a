"""Column expressions for scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, length: Column, avg_length: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * length / avg_length))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def best(df: DataFrame, k: int, key: str = "query_id", ties: tuple[str, ...] = ("doc_id", "chunk")) -> DataFrame:
    """The ``k`` highest scores for each key, with rank 1 to k.

    ``row_number() <= k`` lets Spark keep k rows for each key and task before
    the shuffle, so a key with very many candidates stays small.
    """
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
