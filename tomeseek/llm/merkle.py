"""A Merkle manifest of a table by time-forward processing.

Nodes of the hash trees are processed in the order of their labels (the last leaf below
them, then the level). A node does not look up its children: each child sends its
digest ahead to the parent's label through a priority queue, and the next label is
ready when its messages are at the head. A reversed sweep sends messages the other way: a
node's proof suffix (the siblings from there up to the root) goes to its children.

The queue is external: leaves are cut into blocks, the messages between blocks and the
tops of blocks travel by a shuffle sorted by label, and a task holds the queue of one
block at a time. A round takes every tree up by a block's levels, so the rounds are few.
No row goes to the driver but the root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.plans.joins import is_small
from tomeseek.session import written

#: Levels of a block: 4,096 nodes are taken to one.
LEVELS = 12
#: Modulus of crc32 for the rows that are tampered with.
TAMPERED = 7
NODES = "tree bigint, i bigint, n bigint, digest string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(column: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def _height(n: int) -> int:
    return (n - 1).bit_length()


def sweep(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], str]]:
    """The block's top, and the digests of all nodes by level and place."""
    made: dict[tuple[int, int], str] = {}
    queue: list[tuple[int, int, int, str]] = []  # last leaf below, level, place, digest: messages by the label they go to
    last = len(digests) - 1

    def send(level: int, place: int, digest: str) -> None:
        made[level, place] = digest
        if level < levels:
            end = min(last, ((place >> 1) + 1 << level + 1) - 1)
            heapq.heappush(queue, (end, level + 1, place, digest))

    for leaf, digest in enumerate(digests):
        send(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            _, level, place, one = heapq.heappop(queue)
            parts = [one]
            while queue and queue[0][1:3] == (level, place + 1) and place % 2 == 0:
                parts.append(heapq.heappop(queue)[3])
            send(level, place >> 1, digest_of(*parts))
    return made[levels, 0], made


def reversed_sweep(made: dict[tuple[int, int], str], levels: int, suffix: str, n: int) -> list[str]:
    """The proof suffix of each of the block's ``n`` nodes, given that of its top.

    A suffix is a list of steps joined by commas, from the node up: ``l`` or ``r`` and the digest of
    the sibling on that side, or ``-`` where the run has no other node.
    """
    queue = [(0, 0, suffix)]  # the highest level first: a parent's message is there before its children's turn
    out = [""] * n
    while queue:
        up, place, own = heapq.heappop(queue)
        level = levels - up
        if level == 0:
            out[place] = own
            continue
        left, right = made.get((level - 1, 2 * place)), made.get((level - 1, 2 * place + 1))
        rest = f",{own}" if own else ""
        if left is not None:
            heapq.heappush(queue, (up + 1, 2 * place, f"-{rest}" if right is None else f"r{right}{rest}"))
        if right is not None:
            heapq.heappush(queue, (up + 1, 2 * place + 1, f"l{left}{rest}"))
    return out


def fold(digest: str, suffix: str) -> str:
    """The root that a node's digest and its proof lead to."""
    for step in suffix.split(",") if suffix else ():
        digest = digest_of(digest) if step == "-" else digest_of(step[1:], digest) if step[0] == "l" else digest_of(digest, step[1:])
    return digest


def proof_digest(suffix: str) -> str:
    return digest_of(*(step[1:] for step in suffix.split(","))) if suffix else digest_of("")


def _levels(n: int) -> int:
    """Levels that a round takes a tree of ``n`` nodes up."""
    return min(LEVELS, _height(n))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows by block, each block's by place; a message to a block's top has place -1."""
    rows = rows.withColumn("block", F.when(F.col("place") < 0, F.col("i")).otherwise(F.shiftright("i", LEVELS)))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place", "i")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in the first columns; one run is held at a time."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and run[-1][:n_keys] != row[:n_keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), names)], [n for n, _ in names])


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _up(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks, as nodes of smaller trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[tuple]:
            for block in _grouped(batches, 2):
                tree, at, _, n, _ = block[0]
                levels = _levels(n)
                yield tree, at, -(-n >> LEVELS), sweep([r[4] for r in block], levels)[0]
        return _in_batches(tops(), NODES)

    placed = _blocks(nodes.withColumn("place", F.lit(0).cast("bigint")))
    return written(placed.select("tree", "block", "i", "n", "digest").mapInArrow(run, NODES), "tree-nodes")


def _down(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """tree, i, suffix, subroot of all nodes, from those of their blocks' tops."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def suffixes() -> Iterator[tuple]:
            for (_, _, _, _, subroot, suffix, _), *block in _grouped(batches, 2):
                levels = _levels(block[0][6])
                _, made = sweep([r[4] for r in block], levels)
                for row, own in zip(block, reversed_sweep(made, levels, suffix, len(block))):
                    yield row[0], row[3], row[4], own, subroot
        return _in_batches(suffixes(), SUFFIXES, 512)

    messages = tops.select("tree", "i", F.lit(-1).cast("bigint").alias("place"), F.col("subroot").alias("digest"), "suffix", F.lit(0).cast("bigint").alias("n"))
    own = nodes.select("tree", "i", F.lit(0).cast("bigint").alias("place"), "digest", F.lit("").alias("suffix"), "n")
    return _blocks(own.unionByName(messages)).select("tree", "block", "place", "i", "digest", "suffix", "n").mapInArrow(run, SUFFIXES)


SUFFIXES = "tree bigint, i bigint, digest string, suffix string, subroot string"


def trees(leaves: DataFrame) -> list[DataFrame]:
    """The nodes after each round, from the leaves (tree, i, n, digest) to one node a tree."""
    rounds = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(_up(rounds[-1]))
        most = -(-most >> LEVELS)
    return rounds


def numbered(rows: DataFrame, by: list[Column], tree: list[str]) -> DataFrame:
    """``rows`` with i, the place in its tree in the order of ``by`` (``tree`` first), and n, the tree's size. ``rows`` are sorted by Spark over all tasks."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("id", 33)), "ordered-rows")
    parts = ordered.groupBy("part", *tree).agg(F.min("id").alias("first"), F.count("*").alias("held"))
    one = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))
    earlier = one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "n": F.sum("held").over(one)}), "ordered-parts")
    parts = parts.select(F.col("part").alias("of_part"), *(F.col(c).alias(f"of_{c}") for c in tree), (F.col("before") - F.col("first")).alias("shift"), "n")
    same = reduce(Column.__and__, (ordered[c].eqNullSafe(parts[f"of_{c}"]) for c in tree), ordered["part"] == parts["of_part"])
    joined = ordered.join(F.broadcast(parts) if is_small(parts) else parts, same)
    return joined.withColumn("i", F.col("id") + F.col("shift")).select(*rows.columns, "i", "n")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    ``docs`` needs doc_id, source, lang, n_chars and text, each of which may be NULL;
    other columns are ignored. Per language, leaves ascend by doc_id (NULL first), then
    by digest, so rows that repeat are leaves of their own. An empty table has no root and gives no rows. Texts
    are hashed whole, by Spark; only digests leave their task. Rows whose crc32 of the id
    is divisible by TAMPERED are verified with n_chars raised by one.
    """
    values = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    raised = leaf_of(**values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("lang"), leaf_of(**values).alias("leaf"), F.when(changed, raised).alias("tampered"))
    first = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    # Written before it is sorted by range, which goes through its rows twice: texts are read and hashed once.
    rows = numbered(written(slim, "leaf-digests"), first, ["lang"])
    # A number for each language, in the order of their subroots.
    names = numbered(rows.where("i = 0").select("lang"), [F.col("lang").asc_nulls_first()], []).select(F.col("lang").alias("of"), F.col("i").alias("tree"), F.col("n").alias("trees"))
    names = written(names, "languages")
    rows = rows.join(F.broadcast(names) if is_small(names) else names, rows["lang"].eqNullSafe(names["of"])).drop("of", "lang", "trees")
    rows = written(rows, "leaves")

    nodes = trees(rows.select("tree", "i", "n", F.col("leaf").alias("digest")))
    subroots = nodes[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("i"), "digest").join(
        names.select(F.col("tree").alias("i"), F.col("trees").alias("n")), "i").select("tree", "i", "n", "digest")
    subroots = written(subroots, "subroots")
    above = trees(subroots)
    top = above[-1].select("digest").head()
    root = top[0] if top else None

    # Down again: the suffixes of the subroots first, then those of each round.
    found = above[-1].select("tree", "i", "digest", F.lit("").alias("suffix"), F.lit("").alias("subroot"))
    for level in reversed(above[:-1]):
        found = written(_down(level, found), "suffixes")
    found = found.select(F.col("i").alias("tree"), F.lit(0).cast("bigint").alias("i"), "digest", "suffix", F.col("digest").alias("subroot"))
    for level in reversed(nodes[1:-1]):
        found = written(_down(level, found), "suffixes")
    return _proofs(rows, found, root)


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(rows: DataFrame, tops: DataFrame, root: str | None) -> DataFrame:
    """The last step down: proofs of the leaves are used in the task that makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for (_, _, _, _, subroot, suffix, *_), *block in _grouped(batches, 2):
                levels = _levels(block[0][6])
                _, made = sweep([r[4] for r in block], levels)
                for row, own in zip(block, reversed_sweep(made, levels, suffix, len(block))):
                    got = fold(row[8] or row[4], own)
                    yield row[7], row[4], subroot, root, proof_digest(own), got, got == root
        return _in_batches(proofs(), PROOFS)

    messages = tops.select(
        "tree", "i", F.lit(-1).cast("bigint").alias("place"), F.col("subroot").alias("digest"), "suffix", F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("tampered"))
    own = rows.select("tree", "i", F.lit(0).cast("bigint").alias("place"), F.col("leaf").alias("digest"), F.lit("").alias("suffix"), "n", "doc_id", "tampered")
    return _blocks(own.unionByName(messages)).select("tree", "block", "place", "i", "digest", "suffix", "n", "doc_id", "tampered").mapInArrow(run, PROOFS)
