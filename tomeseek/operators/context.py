"""From conversations to queries, and from hits to the context of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.functions.text import let
from tomeseek.operators.passages import SIZE, STEP
from tomeseek.plans.joins import is_small
from tomeseek.session import written

TURNS_PER_BLOCK = 64
#: Conversations have ids below 2^32 and turns below 2^31, so that both fit one query id; others raise.
MAX_TURNS = 1 << 31
MAX_CONVERSATIONS = 1 << 32


def conversation_queries(turns: DataFrame, history: int = 3) -> DataFrame:
    """One query for each user turn: its text after those of the ``history`` turn numbers before it.

    ``query_id`` is ``conv_id * 2^31 + turn``; ids it could not tell apart raise. A conversation is handled in
    blocks of turns, each with a copy of the turns just before it, so that one
    very long conversation is spread over many tasks.
    """
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK)
    # Turns near the end of a block also go to the block that may look back at them.
    reach = F.floor((F.col("turn") + history) / TURNS_PER_BLOCK)
    spread = turns.select(
        "conv_id", "turn", "role", "text", F.explode(F.sequence(block, reach)).alias("block"), block.alias("home")
    )
    before = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(-history, -1)
    with_history = spread.withColumn("earlier", F.collect_list("text").over(before))
    asked = with_history.where((F.col("block") == F.col("home")) & (F.col("role") == "user"))
    fits = F.col("turn").between(0, MAX_TURNS - 1) & F.col("conv_id").between(0, MAX_CONVERSATIONS - 1)
    query_id = F.when(~fits, F.raise_error(F.format_string(
        "conversation %s, turn %s: not within 2^32 conversations of 2^31 turns", "conv_id", "turn")).cast("bigint"))
    return asked.select(
        query_id.otherwise(F.col("conv_id") * MAX_TURNS + F.col("turn")).alias("query_id"), "conv_id", "turn",
        F.array_join(F.concat("earlier", F.array("text")), "\n").alias("text"),
    )


def assemble_context(
    queries: DataFrame, hits: DataFrame, passages: DataFrame, budget: int, size: int = SIZE, step: int = STEP
) -> DataFrame:
    """One row for each query: its best passages in rank order while they fit ``budget`` words.

    A passage with the same words as a better one is skipped, and words shared
    with a better neighbour are given and counted once. A query with no hit, or
    none that fits, keeps its row with an empty context. Windows are over the
    hits of one query, which a search has already cut to its k. ``hits`` should
    be a written table: its size is looked at before it is joined.
    """
    few = is_small(hits)
    texts = passages.select("doc_id", "chunk", "tokens")
    found = (F.broadcast(hits) if few else hits).join(texts, ["doc_id", "chunk"])
    copy = Window.partitionBy("query_id", F.md5(F.array_join("tokens", " "))).orderBy("rank")
    found = found.withColumn("copy", F.row_number().over(copy)).where(F.col("copy") == 1)

    document = Window.partitionBy("query_id", "doc_id").orderBy("chunk")

    def better_neighbour(shift: int):
        return (
            (F.lag("chunk", shift).over(document) == F.col("chunk") - shift)
            & (F.lag("rank", shift).over(document) < F.col("rank"))
        )

    begin = F.when(better_neighbour(1), F.lit(size - step)).otherwise(F.lit(0))
    end = F.when(better_neighbour(-1), F.least(F.lit(step), F.size("tokens"))).otherwise(F.size("tokens"))
    found = found.withColumn("begin", begin).withColumn("end", end)
    found = found.withColumn(
        "part", F.slice("tokens", F.col("begin") + 1, F.greatest(F.col("end") - F.col("begin"), F.lit(0)))
    )
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("used", F.sum(F.size("part")).over(so_far)).where(F.col("used") <= budget)
    row = F.struct("rank", "doc_id", "chunk", "part")
    chosen = found.groupBy("query_id").agg(
        F.count("*").alias("n_passages"), F.max("used").alias("n_words"),
        F.array_sort(F.collect_list(row)).alias("rows"),
    )
    chosen = chosen.select(
        "query_id", "n_passages", "n_words",
        F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["doc_id"], r["chunk"])), " ").alias("cited"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r["part"], " ")), "\n").alias("context"),
    )
    kept = queries.select("query_id").join(chosen, "query_id", "left")
    return kept.select(
        "query_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_passages", "n_words")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("cited", "context")],
    )


DIVERSE_DIGITS = 6


def diverse_context(queries: DataFrame, hits: DataFrame, passages: DataFrame, budget: int, weight: float = 0.5) -> DataFrame:
    """One row for each query: passages chosen one by one, each for its score less its likeness to those chosen.

    A passage is worth ``weight`` times its score (over the query's highest) less
    ``1 - weight`` times its greatest likeness to a chosen one: words that both
    have over words that either has. The worthiest that still fits in ``budget`` words comes next, of
    equals the one with the better rank, until none fits. ``cited`` is in that order. A query
    without a hit, or none that fits, keeps its row with an empty context.

    A query's hits are compared with each other, and a search has already cut them to
    its k; nothing else grows with the square. ``hits`` should be a written table.
    """
    texts = passages.select("doc_id", "chunk", "tokens")
    found = (F.broadcast(hits) if is_small(hits) else hits).join(texts, ["doc_id", "chunk"])
    row = F.struct("rank", "doc_id", "chunk", "score", F.size("tokens").cast("bigint").alias("n"), "tokens", F.array_distinct("tokens").alias("kinds"))
    cases = found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def like(a, b):
        return F.round(F.size(F.array_intersect(a["kinds"], b["kinds"])) / F.greatest(F.size(F.array_union(a["kinds"], b["kinds"])), F.lit(1)), DIVERSE_DIGITS)

    # Written: within a step Spark would make the likenesses again each time it names them.
    cases = cases.select(
        "query_id", "rows", F.transform("rows", lambda a: F.transform("rows", lambda b: like(a, b))).alias("alike"),
        F.array_max(F.transform("rows", lambda r: r["score"])).alias("top"))
    cases = written(cases, "alike-passages")
    nothing = F.struct(
        F.transform("rows", lambda r: F.lit(0.0)).alias("nearest"), F.array().cast("array<int>").alias("chosen"), F.lit(0).cast("bigint").alias("used"))

    def step(state, _):
        worth = F.transform("rows", lambda r, i: F.when(
            ~F.array_contains(state["chosen"], i) & (state["used"] + r["n"] <= budget),
            F.struct(F.round(
                weight * F.coalesce(F.try_divide(r["score"], F.col("top")), F.lit(0.0)) - (1 - weight) * F.get(state["nearest"], i), DIVERSE_DIGITS).alias("worth"), (-i).alias("place"))))
        return let(F.array_max(worth), lambda next_: F.when(next_.isNull(), state).otherwise(F.struct(
            F.transform(state["nearest"], lambda near, i: F.greatest(near, F.get(F.get("alike", i), -next_["place"]))).alias("nearest"),
            F.concat(state["chosen"], F.array(-next_["place"])).alias("chosen"),
            (state["used"] + F.get("rows", -next_["place"])["n"]).alias("used"))))

    steps = F.sequence(F.lit(1), F.size("rows"))
    chosen = cases.select("query_id", "rows", F.aggregate(steps, nothing, step).alias("end"))
    of = lambda i: F.get("rows", i)
    chosen = chosen.select(
        "query_id", F.size("end.chosen").cast("bigint").alias("n_passages"), F.col("end.used").alias("n_words"),
        F.array_join(F.transform("end.chosen", lambda i: F.concat_ws(":", of(i)["doc_id"], of(i)["chunk"])), " ").alias("cited"),
        F.array_join(F.transform("end.chosen", lambda i: F.array_join(of(i)["tokens"], " ")), "\n").alias("context"))
    kept = queries.select("query_id").join(chosen, "query_id", "left")
    return kept.select(
        "query_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_passages", "n_words")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("cited", "context")],
    )
