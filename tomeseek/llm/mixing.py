"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source; its leaves are the sources of one language of
one domain. A node's budget goes to its children by weight, none above what it
holds (its tokens, times the epochs allowed). What one cannot take goes to its
siblings, and only what all of them cannot take was never given to the parent: the
capacity of a node is that of its subtree. A leaf takes its budget as full epochs
and a prefix, in tokens, of one more epoch, whose order a seeded hash gives.

The prefix needs no sort of a leaf: tokens are summed by leaf and first digits of
the hash, the running sum of those sums finds the digits at which the prefix ends,
and only the documents that share them are put in order. All of it is DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.llm.common import free_name
from tomeseek.session import written

LEVELS = ("domain", "lang", "source")
NONE = "none"
#: First hexadecimal digits of the hash by which a leaf's tokens are summed: 65,536 parts.
DIGITS = 4
WORD = r"[^ \t\n\r\f\x0B]+"


def domain_of(source: Column | str) -> Column:
    """A domain for sources named by number: the number modulo 4."""
    number = F.expr("try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint)") if isinstance(source, str) else source
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def token_count(text: Column | str) -> Column:
    """Words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _leaf_columns(domain: Column) -> dict[str, Column]:
    return {"domain": F.coalesce(domain, F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)), "source": F.coalesce("source", F.lit(NONE))}


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    """The weight of a node's name on its level; 1 where none is given."""
    out = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def _share_out(nodes: DataFrame, level: str, parents: list[str]) -> DataFrame:
    """Each child's part of its parent's ``budget``: capacities are filled in order of capacity over weight."""
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    order = family.orderBy("fills_at", level)
    nodes = nodes.withColumn("fills_at", F.when(F.col("capacity") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0))
    nodes = nodes.withColumns({
        "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    nodes = nodes.withColumn("full", (F.col("capacity") == 0) | (F.col("before") + F.col("fills_at") * F.col("rest") <= F.col("budget")))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(family)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(family)
    part = F.when(F.col("full"), F.col("capacity")).otherwise((F.col("budget") - taken) / open_weight * F.col("weight"))
    return nodes.withColumn("part", part)


def plan_mixture(leaves: DataFrame, share: float, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """domain, lang, source, tokens, full (epochs) and rest (tokens of the epoch after them) of each leaf.

    ``leaves``: the three names and tokens. The budget is ``share`` of all tokens, at
    most what the tree can give. A node of weight 0 or less takes nothing.
    """
    steps = {level: list(LEVELS[: i + 1]) for i, level in enumerate(LEVELS)}
    weight = {level: _weight(level, weights) for level in LEVELS}
    held = F.when(weight["source"] > 0, F.col("tokens").cast("double") * epochs).otherwise(0.0)
    nodes = {"source": leaves.withColumns({"capacity": held, "weight": weight["source"]})}
    for level, below in (("lang", "source"), ("domain", "lang")):
        nodes[level] = nodes[below].groupBy(*steps[level]).agg(F.sum("capacity").alias("within")).select(
            *steps[level], weight[level].alias("weight"), F.when(weight[level] > 0, F.col("within")).otherwise(0.0).alias("capacity"))
    total = leaves.agg(F.sum("tokens").cast("double").alias("all"))
    able = nodes["domain"].agg(F.sum("capacity").alias("able"))
    # One row each: the totals of the tree.
    budget = total.join(F.broadcast(able), how="inner").select(F.least(F.col("all") * F.lit(share), F.col("able")).alias("budget"))
    parts = _share_out(nodes["domain"].join(F.broadcast(budget), how="inner"), "domain", [])
    for level in ("lang", "source"):
        above = steps[level][:-1]
        parts = _share_out(nodes[level].join(parts.select(*above, F.col("part").alias("budget")), above), level, above)
    whole = F.floor(F.col("part") + 1e-6).cast("bigint")
    full = F.when(F.col("tokens") > 0, F.floor(whole / F.col("tokens"))).otherwise(0).cast("bigint")
    return parts.select(*LEVELS, "tokens", full.alias("full"), (whole - full * F.col("tokens")).alias("rest"))


def place(seed: int, full: Column | str, doc_id: Column | str, text: Column | str) -> Column:
    """The document's place in the epoch after ``full`` ones: 16 hexadecimal digits. A NULL id is replaced by its text's digest."""
    name = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.md5(F.coalesce(text, F.lit(""))))
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(full).cast("string") if isinstance(full, str) else full, name)), 1, 16)


def cut_offs(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``last``: the place at which the leaf's prefix ends ('' if it is empty).

    ``rows``: the three names, n_tokens (above 0) and place. Rows at the same place are
    in the prefix together or not at all; the prefix never goes over ``rest``.
    """
    leaf = list(LEVELS)
    first = F.substring("place", 1, DIGITS).alias("digits")
    sums = rows.groupBy(*leaf, first).agg(F.sum("n_tokens").alias("held"))
    to_here = Window.partitionBy(*leaf).orderBy("digits")
    sums = sums.withColumn("up_to", F.sum("held").over(to_here)).join(plan.select(*leaf, "rest"), leaf)
    # The digits at which the running sum passes what is left of the budget.
    ends = sums.where("up_to > rest and up_to - held <= rest").select(*leaf, "digits", (F.col("rest") - F.col("up_to") + F.col("held")).alias("room"))
    near = rows.withColumn("digits", first).join(ends, [*leaf, "digits"])
    peers = Window.partitionBy(*leaf, "digits").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = near.withColumn("run", F.sum("n_tokens").over(peers)).where("run <= room").groupBy(*leaf).agg(F.max("place").alias("inside"))
    cut = plan.join(ends.select(*leaf, "digits"), leaf, "left").join(inside, leaf, "left")
    # No end: the whole epoch is within the budget. No row inside: the prefix ends before the digits.
    last = F.when(F.col("rest") == 0, "").when(F.col("digits").isNull(), "g").otherwise(F.coalesce("inside", "digits"))
    return cut.select(*leaf, "tokens", "full", "rest", last.alias("last"))


def mixture(
    docs: DataFrame, *, domain: Column, share: float, weights: dict[str, dict[str, float]], epochs: int = 2, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, domain, lang, source, n_tokens, copies), those with a copy only, and the leaves' plan.

    A NULL language or source is a leaf named ``none``. Texts without a word are never
    taken. Rows that repeat count each; as they have the same place they are taken together.
    """
    slim = written(
        docs.withColumns(_leaf_columns(domain)).select(
            "doc_id", *LEVELS, token_count("text").alias("n_tokens"),
            F.when(F.isnull("doc_id"), F.col("text")).alias("text")).where("n_tokens > 0"), "mixture")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = written(plan_mixture(leaves, share, weights, epochs), "plan")
    rows = slim.join(plan.select(*LEVELS, "full"), list(LEVELS)).withColumn("place", place(seed, "full", "doc_id", "text"))
    plan = written(cut_offs(rows, plan), "cut-offs")
    taken = rows.join(plan.select(*LEVELS, "last"), list(LEVELS))
    copies = (F.col("full") + (F.col("place") <= F.col("last")).cast("bigint")).cast("int")
    return taken.select("doc_id", *LEVELS, "n_tokens", copies.alias("copies")).where("copies > 0"), plan


def mixed_documents(docs: DataFrame, *, domain: Column, share: float, weights: dict[str, dict[str, float]], epochs: int = 2, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, as many times as their leaf's budget takes them, with all columns. See ``mixture``."""
    _, plan = mixture(docs, domain=domain, share=share, weights=weights, epochs=epochs, seed=seed)
    leaf = {level: free_name(docs, f"leaf_{level}") for level in LEVELS}
    full, last, copies, copy = (free_name(docs, name) for name in ("full", "last", "copies", "copy"))
    cut = plan.select(*(F.col(level).alias(leaf[level]) for level in LEVELS), F.col("full").alias(full), F.col("last").alias(last))
    named = docs.withColumns({leaf[k]: c for k, c in _leaf_columns(domain).items()}).where(token_count("text") > 0)
    here = place(seed, full, "doc_id", "text")
    taken = (F.col(full) + (here <= F.col(last)).cast("bigint")).cast("int")
    out = named.join(cut, list(leaf.values())).withColumn(copies, taken).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
