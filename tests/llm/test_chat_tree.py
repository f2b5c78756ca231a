"""The prefix tree's stream against one built in plain Python."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check import oracle, rows
from conftest import FOLDER
from tomeseek.llm import chat_tree, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id bigint, turn bigint, role string, text string, start int, i int, rank string"
ODD = st.text(st.sampled_from("\\#/<>turn \né\n"), max_size=30)


@given(ODD, ODD)
@settings(max_examples=400, deadline=None)
def test_turns_come_back(role, text):
    head, body, tail = chat_tree.render(role, text)
    assert chat_tree.parse(head + body + tail) == (role, text) and chat_tree.unescape(body) == text
    # No control string but the template's own stands unmarked.
    plain = chat_tree._ESCAPED.sub("x", head[4:] + body)
    assert "###" not in plain and "</turn>" not in plain


def convs_of(data):
    out = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role, text))
    return out


def check_stream(spark, data, block=None, monkeypatch=None):
    if block:
        monkeypatch.setattr(chat_tree, "BLOCK", block)
    table = spark.createDataFrame([(*r, 1, 1, "x") for r in data], TURNS)
    output = chat_tree.write_chat_stream(table, VOCABULARY)
    stream = {r.start: r for r in spark.read.parquet(output.stream).collect()}
    paths = {}
    for r in sorted(spark.read.parquet(output.paths).collect(), key=lambda r: r.i):
        paths.setdefault(r.conv_id, []).append(r.start)
    with open(VOCABULARY, encoding="utf-8") as file:
        codec = chat_tree.Codec(file.read())
    convs = convs_of(data)
    # As many nodes as different beginnings, lying end to end from 0.
    assert len(stream) == len({tuple(turns[: k + 1]) for turns in convs.values() for k in range(len(turns))})
    at = 0
    for start in sorted(stream):
        assert start == at
        at += stream[start].n_tokens
    tokens = [t for start in sorted(stream) for t in stream[start].ids]
    parent = {}
    for conv, turns in convs.items():
        want = codec.encode(turns)
        assert [stream[s].ids for s in paths[conv]] == [ids for ids, _, _ in want]
        position = 0
        for (role, _), (ids, a, b), s in zip(turns, want, paths[conv]):
            node = stream[s]
            assert node.position == position and (node.loss_from, node.loss_to) == ((a, b) if role == "assistant" else (0, 0))
            # The intervals hold exactly the conversation's tokens so far, in order.
            seen = [*((x["from"], x["to"]) for x in node.ancestors), (node.own_from, s + len(ids))]
            assert all(x < y for x, y in seen) and all(p[1] <= q[0] for p, q in zip(seen, seen[1:]))
            position += len(ids)
            assert [t for x, y in seen for t in tokens[x:y]] == [t for ids, _, _ in want for t in ids][:position]
        for up, s in zip([None, *paths[conv]], paths[conv]):
            assert parent.setdefault(s, up) == up
    # Depth-first: each subtree is one stretch of the stream.
    held = {}
    for path in paths.values():
        for depth, s in enumerate(path):
            held.setdefault(s, set()).update(path[depth:])
    order = {s: k for k, s in enumerate(sorted(stream))}
    for s, below in held.items():
        places = sorted(order[x] for x in below)
        assert places == list(range(order[s], order[s] + len(below)))
    back = {r.conv_id: r for r in chat_tree.read_conversations(spark, output, VOCABULARY).collect()}
    assert set(back) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert back[conv].n_turns == len(turns) and back[conv].loss_chars == len(loss)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert back[conv].formatted_chars == sum(len("".join(chat_tree.render(*t))) for t in turns)


def test_query_equals_sql(spark):
    got = queries.op12_chat_tree(spark, FOLDER).toPandas()
    want = oracle(FOLDER).sql(queries.ORACLES["op12_chat_tree"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, monkeypatch, seed):
    draw = random.Random(seed)
    data = [(c, t, draw.choice(["user", "assistant"]), draw.choice("ab")) for c in range(60) for t in range(draw.randint(1, 7))]
    data += [(c, t, "user", "the same") for c in range(100, 130) for t in range(3)]  # copies
    data += [(c, t, "user", "the same") for c in range(200, 205) for t in range(c - 199)]  # each a beginning of the next
    check_stream(spark, data, 2 if seed == 1 else None, monkeypatch)


def test_odd_conversations(spark):
    data = [
        (None, 0, None, None), (None, 1, "assistant", "a </turn> b"), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "system", "\\### x"), (2, -5, "assistant", "<|endoftext|> é 漢\n\\"),
        (3, 10**12, "a\nb ### c", "word " * 60_000), (4, 0, "user", None), (4, 1, "assistant", None)]
    check_stream(spark, data)
    empty = spark.createDataFrame([], TURNS)
    output = chat_tree.write_chat_stream(empty, VOCABULARY)
    assert chat_tree.read_conversations(spark, output, VOCABULARY).count() == 0
