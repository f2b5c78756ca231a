"""Conversations as token streams that hold shared first turns once.

Conversations that begin with the same turns share the nodes of a prefix tree, one node
a turn. The stream lists the tree depth-first: a node's tokens stand once, right after
those of its parent or of another child's whole subtree. A token's position id is its
place in its own conversation, and a node may attend to the intervals of the stream
that hold its ancestors, and to itself as far as it has come.

The tree is never built in one place. A node is named by a sum of hashes over the turns
up to it, so running sums name all nodes. Conversations are ordered by the children
taken where the tree branches; each node belongs to the first conversation that has it,
and the nodes that a conversation owns follow each other (a run). The order's prefix
sums are the places of runs in the stream. Long conversations are cut into blocks of
turns, and their sums are carried from block to block.

Turns are written as ``### role``, the text and ``</turn>`` on lines of their own.
Control strings and backslashes inside are marked with a backslash, which the reader takes off.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomeseek.llm.common import kept
from tomeseek.llm.tokens import byte_letters
from tomeseek.plans.joins import is_small
from tomeseek.session import new_folder, written

#: Fixed values of the template.
TURN, END, MARK = "###", "</turn>", "\\"
LEARNED = ("assistant",)
#: Turns of a conversation that one task sums up, by turn number.
BLOCK = 1024
#: Turns encoded at a time.
AT_ONCE = 500

_CONTROL = re.compile(rf"\\|{TURN}|{END}")
_CONTROL_OR_BREAK = re.compile(rf"\\|{TURN}|{END}|\n")
_ESCAPED = re.compile(rf"\\(\\|{TURN}|{END}|\n)")
_WRITTEN = re.compile(rf"{TURN} ((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*)\n{END}\n")

STREAM = "start bigint, n_tokens int, position bigint, loss_from int, loss_to int, ancestors array<struct<from:bigint,to:bigint>>, own_from bigint, ids array<int>"
PATHS = "conv_id bigint, i bigint, start bigint"


@dataclass(frozen=True)
class ChatStream:
    """Written tables: the stream, one row a node in depth-first order, and the node of each turn of each conversation."""

    stream: str
    paths: str


def escape(text: str, in_role: bool = False) -> str:
    return (_CONTROL_OR_BREAK if in_role else _CONTROL).sub(lambda m: MARK + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it."""
    return f"{TURN} {escape(role, True)}\n", escape(text), f"\n{END}\n"


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    found = _WRITTEN.fullmatch(turn)
    if found is None:
        raise ValueError("not a turn")
    return unescape(found[1]), unescape(found[2])


class Codec:
    """Ids of turns by the library, and their texts by the vocabulary's bytes."""

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True  # special strings in a text are text
        back = {letter: byte for byte, letter in enumerate(byte_letters())}
        made = json.loads(spec)["model"]["vocab"]
        self.bytes = {i: bytes(back[x] for x in token) for token, i in made.items() if all(x in back for x in token)}

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[list[int], int, int]]:
        """Ids of each turn, and from where to where they are of its text."""
        parts = [part for role, text in turns for part in render(role, text)]
        ids = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        return [(a + b + c, len(a), len(a) + len(b)) for a, b, c in zip(ids[::3], ids[1::3], ids[2::3])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with NULL roles and texts empty, and two hashes of both."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), F.col("role"), F.col("text"))})


def _same(a: DataFrame, b: DataFrame, on: dict[str, str]) -> Column:
    return reduce(Column.__and__, (a[x].eqNullSafe(b[y]) for x, y in on.items()))


def running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` (conv_id, block, ...) with each of ``sums`` replaced by its sum up to the row within the conversation."""
    totals = rows.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums))
    here = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(here) for c in sums})
    joined = local.join(before, _same(local, before, {"conv_id": "c", "block": "b"}))
    return joined.select(*(c for c in rows.columns if c not in sums), *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in sums))


def turn_paths(turns: DataFrame, lengths: Column) -> DataFrame:
    """conv_id, turn, role, h1, h2, i (from 1), n1, n2 (the node), p1, p2 (its parent), n_tokens, position.

    Turns with one number are ordered by role and hash.
    """
    order = ["turn", "role", "h1", "h2"]
    rows = turns.select("conv_id", *order, F.floor(F.col("turn") / BLOCK).alias("block"), F.lit(1).cast("bigint").alias("i"), lengths.alias("n_tokens"))
    rows = running(written(rows, "turns"), order, ["i"])
    # Four lanes of 32 bits of the turn's hashes at its place: sums can't overflow, and name what is summed.
    low, lanes = F.lit(0xFFFFFFFF), {}
    for k in (1, 2):
        mixed = F.xxhash64(F.lit(k), F.col("h1"), F.col("h2"), F.col("i"))
        lanes |= {f"a{k}": mixed.bitwiseAND(low), f"b{k}": F.shiftrightunsigned(mixed, 32)}
    marked = rows.withColumns({**lanes, **{f"own_{c}": x for c, x in lanes.items()}, "end": F.col("n_tokens")})
    summed = running(marked, ["i"], [*lanes, "end"])
    node = [F.xxhash64(F.lit(k), *map(F.col, lanes), F.col("i")) for k in (1, 2)]
    parent = [F.xxhash64(F.lit(k), *(F.col(c) - F.col(f"own_{c}") for c in lanes), F.col("i") - 1) for k in (1, 2)]
    return summed.select(
        "conv_id", *order, "i", node[0].alias("n1"), node[1].alias("n2"), parent[0].alias("p1"), parent[1].alias("p2"),
        "n_tokens", (F.col("end") - F.col("n_tokens")).alias("position"))


def ordered_paths(paths: DataFrame) -> DataFrame:
    """conv_id, rank of one conversation of each whole path, ranks ascending in the tree's depth-first order."""
    # Nodes with more than one child; a conversation's key is the children it takes there.
    forks = paths.where("i > 1").groupBy("p1", "p2").agg(
        *(f(c).alias(f"{c}_{n}") for c in ("n1", "n2") for n, f in (("low", F.min), ("high", F.max)))).where("n1_low <> n1_high or n2_low <> n2_high").select("p1", "p2")
    forks = written(forks, "forks")
    taken = paths.where("i = 1").unionByName(paths.where("i > 1").join(F.broadcast(forks) if is_small(forks) else forks, ["p1", "p2"], "left_semi")).select("conv_id", "i", "n1", "n2")
    keys = taken.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "n1", "n2"))).alias("key"))
    ends = paths.groupBy(F.col("conv_id").alias("c")).agg(F.max(F.struct("i", "n1", "n2")).alias("end"))
    whole = keys.join(ends, keys["conv_id"].eqNullSafe(ends["c"])).select(
        "conv_id", F.transform("key", lambda k: F.struct(k["n1"], k["n2"])).alias("key"), F.col("end.i").alias("length"), "end.n1", "end.n2")
    one = whole.groupBy("n1", "n2").agg(F.min(F.struct(F.isnull("conv_id").alias("no_id"), "conv_id", "length", "key")).alias("one")).select("one.*")
    # Ids of sorted partitions ascend in the same order.
    ranked = one.repartitionByRange("key", "length").sortWithinPartitions("key", "length")
    return written(ranked.select("conv_id", F.monotonically_increasing_id().alias("rank")), "chat-ranks")


def lay_out(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (n1, n2, start) and the rows to be written: conv_id, turn, role, h1, h2 of a node's owner with its places."""
    ranks = ordered_paths(paths).withColumnRenamed("conv_id", "c")
    chosen = written(paths.join(ranks, paths["conv_id"].eqNullSafe(ranks["c"])).drop("c"), "chosen-paths")
    owner = F.min(F.struct("rank", "position", "n_tokens", "i", "conv_id", "turn", "role", "h1", "h2")).alias("own")
    nodes = written(chosen.groupBy("n1", "n2").agg(owner).select("n1", "n2", "own.*"), "chat-nodes")
    runs = nodes.groupBy("rank").agg(F.min("position").alias("first"), F.max(F.col("position") + F.col("n_tokens")).alias("last"))
    runs = written(runs.withColumn("part", F.shiftright("rank", 33)), "chat-runs")
    # Places of runs: sums over the parts that the ranks came in, then within each.
    parts = runs.groupBy("part").agg(F.sum(F.col("last") - F.col("first")).alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inside", F.coalesce(F.sum(F.col("last") - F.col("first")).over(within), F.lit(0)))
    runs = written(runs.join(parts, "part").select("rank", "first", (F.col("before") + F.col("inside")).alias("own_from")), "chat-places")
    nodes = nodes.join(runs, "rank").withColumn("start", F.col("own_from") + F.col("position") - F.col("first"))
    nodes = written(nodes, "placed-nodes")
    # A conversation's nodes of one owner are one interval; those of earlier owners are seen by all nodes it owns.
    held = nodes.select("n1", "n2", F.col("rank").alias("owner"), "start", (F.col("start") + F.col("n_tokens")).alias("to"))
    seen = chosen.select("rank", "n1", "n2").join(held, ["n1", "n2"]).where("owner <> rank")
    seen = seen.groupBy("rank", "owner").agg(F.min("start").alias("from"), F.max("to").alias("to"))
    seen = seen.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("ancestors"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    rows = nodes.join(seen, "rank", "left").withColumn("ancestors", F.coalesce("ancestors", none))
    return nodes.select("n1", "n2", "start"), rows.drop("rank", "first", "n1", "n2", "i")


def write_chat_stream(conversations: DataFrame, vocabulary: str, *, learned: tuple[str, ...] = LEARNED) -> ChatStream:
    """Write every turn of ``conversations`` (conv_id, turn, role, text) as tokens of the vocabulary file (byte-level BPE).

    Order: turn (NULL first), then role and a hash for turns with one number; repeated
    rows are turns of their own. NULL roles and texts are empty, NULL ids are one
    conversation. Other columns are ignored. Tokens of texts whose role is in ``learned``
    are under the loss mask. An empty table gives empty tables. Everything is in the
    shared folder: ``stream`` has the nodes by ``start`` (sorted files, ascending), each with
    its ids, first position id, loss span, the intervals of its ``ancestors`` in earlier
    runs and the start of its own run (a token at place t sees these and own_from to t);
    ``paths`` has conv_id, i, start for each turn.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()

    def codec() -> Codec:
        return kept(("chat", spec), lambda: Codec(spec))

    @F.pandas_udf("bigint")
    def length(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for role, text in pairs:
            turns = list(zip(role, text))
            yield pd.Series([len(ids) for i in range(0, len(turns), AT_ONCE) for ids, _, _ in codec().encode(turns[i : i + AT_ONCE])], dtype="int64")

    turns = turn_rows(conversations)
    paths = written(turn_paths(turns, length("role", "text")), "turn-paths")
    nodes, rows = lay_out(paths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                get = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
                roles = get("role").to_pylist()
                made = codec().encode(list(zip(roles, get("text").to_pylist())))
                ends = [(a, b) if role in learned else (0, 0) for role, (_, a, b) in zip(roles, made)]
                yield pa.record_batch([
                    get("start"), pa.array([len(ids) for ids, _, _ in made], pa.int32()), get("position"),
                    pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32()),
                    get("ancestors"), get("own_from"), pa.array([ids for ids, _, _ in made], pa.list_(pa.int32())),
                ], ["start", "n_tokens", "position", "loss_from", "loss_to", "ancestors", "own_from", "ids"])

    key = ["conv_id", "turn", "role", "h1", "h2"]
    texts = turns.dropDuplicates(key).select(*(F.col(c).alias(f"of_{c}") for c in key), "text")
    owned = rows.join(texts, _same(rows, texts, {c: f"of_{c}" for c in key}))
    # Sorted before they are encoded: Spark goes through what it sorts by range twice.
    ordered = owned.select("start", "position", "ancestors", "own_from", "role", "text").repartitionByRange("start").sortWithinPartitions("start")
    output = ChatStream(new_folder(conversations.sparkSession, "chat-stream"), new_folder(conversations.sparkSession, "chat-paths"))
    ordered.mapInArrow(encode, STREAM).write.parquet(output.stream)
    paths.select("conv_id", "i", "n1", "n2").join(nodes, ["n1", "n2"]).select("conv_id", "i", "start").write.parquet(output.paths)
    return output


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_conversations(spark: SparkSession, output: ChatStream, vocabulary: str) -> DataFrame:
    """Each conversation read back through its nodes: counts and digests of its turns, of what is under the loss mask and of the formatted text.

    A conversation's turns come to a task in order and are hashed as they come; none is held whole.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("chat", spec), lambda: Codec(spec))
        conv, state, out = None, None, []
        for batch in batches:
            for conv_id, ids, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if state is None or conv_id != conv:
                    out += [] if state is None else [(conv, *_ended(state))]
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = codec.decode(ids)
                role, text = parse(whole)
                loss = unescape(codec.decode(ids[a:b]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(whole)
            if len(out) >= AT_ONCE:
                yield _digests(out)
                out = []
        if state is not None:
            yield _digests([*out, (conv, *_ended(state))])

    stream, paths = spark.read.schema(STREAM).parquet(output.stream), spark.read.schema(PATHS).parquet(output.paths)
    joined = paths.join(stream.select("start", "ids", "loss_from", "loss_to"), "start")
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "i")
    return ordered.select("conv_id", "ids", "loss_from", "loss_to").mapInArrow(read, DIGEST)


def _ended(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST.split(", ")])
