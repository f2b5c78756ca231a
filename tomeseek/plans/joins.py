"""Joins of a large table with one whose size has to be looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tomeseek.session import written

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
#: Rows of one key that a task may join on its own.
HOT_ROWS = 20_000
#: Rows of the table that ``thinned`` broadcasts, each with 64 bits.
SLOTS = 1 << 20


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be broadcast, by its real row count and bytes.

    One count over all rows, added up in each task first: best asked of a written table.
    """
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            width = F.octet_length(F.array_join(field.name, " ")) \
                if isinstance(field.dataType.elementType, StringType) else F.size(field.name) * 8
            size = size + F.coalesce(width, F.lit(0))
    rows, total = (
        df.select(size.alias("bytes")).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    )
    return rows <= max_rows and total <= max_bytes


def join_small(
    large: DataFrame, small: DataFrame, on: str, spread: list[str], small_enough: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join on ``on``: a broadcast if ``small`` is small, else a salted shuffle.

    In the shuffle, rows of ``large`` with one key go to ``salts`` tasks by the
    hash of ``spread`` and ``small`` is sent to each, so that a key which holds
    a large share of the rows does not land in one task.
    """
    if is_small(small) if small_enough is None else small_enough:
        return large.join(F.broadcast(small), on)
    salted = large.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("shuffle_merge"), [on, "salt"]).drop("salt")


def join_skewed(large: DataFrame, small: DataFrame, on: str, spread: list[str], most: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``on`` where neither side may be broadcast and ``large``, a written table, has few frequent keys.

    Only keys with over ``most`` rows in ``large`` are joined apart, by a broadcast of their rows of ``small`` or with salts;
    all others by a plain shuffle, without copies of ``small``.
    """
    if is_small(small):
        return large.join(F.broadcast(small), on)
    hot = written(large.groupBy(on).agg(F.count("*").alias("rows")).where(F.col("rows") > most).select(on), "hot-keys")
    if hot.isEmpty():
        return large.join(small.hint("merge"), on)
    split = lambda df, how: df.join(F.broadcast(hot), on, how)
    apart = join_small(split(large, "left_semi"), written(split(small, "left_semi"), "hot-rows"), on, spread)
    return split(large, "left_anti").join(split(small, "left_anti").hint("merge"), on).unionByName(apart)


def thinned(large: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``large`` whose ``on`` may be in ``keys``, before they are shuffled to be joined with them.

    Each key sets two bits of the 64 of a slot by its hash; the slots, of bounded number, are broadcast. No row
    that has a partner is lost, and of the others about (1 - exp(-keys / 2^25))^2 stay: one in a thousand of a million keys.
    """
    def hashed(df: DataFrame) -> DataFrame:
        bit = "shiftleft(1L, cast(pmod(shiftright(own_hash, {}), 64) as int))"
        rows = df.withColumn("own_hash", F.xxhash64(on))
        return rows.withColumns({
            "slot": F.pmod("own_hash", F.lit(SLOTS)), "own_bits": F.expr(f"{bit.format(24)} | {bit.format(40)}")}).drop("own_hash")

    table = hashed(keys.select(on)).groupBy("slot").agg(F.bit_or("own_bits").alias("bits"))
    met = hashed(large).join(F.broadcast(table), "slot")
    return met.where(F.col("bits").bitwiseAND(F.col("own_bits")) == F.col("own_bits")).select(*large.columns)
