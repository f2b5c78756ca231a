"""Bounded samples of pieces of text, for fitting a model on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range of the hash that decides which pieces are drawn.
STEPS = 1_000_000


def draw(*key: Column | str) -> Column:
    """0 to STEPS - 1, fixed for a key."""
    return F.pmod(F.xxhash64(F.lit(17), *key), F.lit(STEPS))


def shares(counts: dict, wanted: int) -> dict:
    """The share of each class's rows that gives ``wanted`` of them on average."""
    return {c: min(1.0, wanted / n) for c, n in counts.items() if n}


def share_of(group: Column, share: dict) -> Column:
    """Below which ``draw`` a row of the class is drawn; NULL for a class that ``share`` lacks."""
    chosen = F.lit(None).cast("bigint")
    for value, part in share.items():
        chosen = F.when(group == F.lit(value), F.lit(round(part * STEPS))).otherwise(chosen)
    return chosen


def sample_pieces(docs: DataFrame, labels: DataFrame, wanted: int, size: int) -> dict[object, list[bytes]]:
    """About ``wanted`` pieces of ``size`` bytes for each class, out of all pieces of the labelled texts.

    ``labels``: doc_id, group. Which pieces are drawn depends on the id and the
    piece's place alone. The sample is at most twice ``wanted`` for each class; the
    text of no other document leaves its task. A NULL text has no piece.
    """
    docs = docs.where("text is not null")
    sized = docs.select("doc_id", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / size)).alias("n"))
    of = sized.join(labels, "doc_id")
    counts = {r["group"]: r["n"] for r in of.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    share = shares(counts, wanted)
    if not share:
        return {}
    picks = (
        of.select("doc_id", "group", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("piece"))
        .where(draw("doc_id", "piece") < share_of(F.col("group"), share))
        .limit(2 * wanted * len(share))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "group": batch["group"],
                "piece": [t.encode()[i * size : (i + 1) * size] for t, i in zip(batch["text"], batch["piece"])]})

    # ``picks`` is bounded by its limit.
    group = labels.schema["group"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").select("group", "text", "piece").mapInPandas(
        cut, f"group {group}, piece binary")
    out: dict[object, list[bytes]] = {c: [] for c in share}
    for row in sorted(found.collect(), key=lambda r: (str(r["group"]), bytes(r["piece"]))):
        out[row["group"]].append(bytes(row["piece"]))
    return out
