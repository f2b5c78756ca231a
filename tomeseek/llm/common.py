"""What several operators of the subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def fold_of(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def held_out(doc_id: Column | str) -> Column:
    """Whether the row is kept from learning: fold 2. A NULL id belongs to no fold and is not learned from either."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def text_hash(text: Column | str) -> Column:
    """64 bits of a text, with NULL and the empty text told apart."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text, F.isnull(text))


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """One object for each Python worker and key, kept from task to task (only the newest key's)."""
    store = pyspark.__dict__.setdefault("_tomeseek_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
