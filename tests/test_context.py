from __future__ import annotations

import random

import pytest

from tomeseek.operators.context import assemble_context, conversation_queries
from tomeseek.plans.ask import answer_context

random.seed(1)


def words(a, b):
    return " ".join(f"w{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(a, b))


@pytest.fixture(scope="module")
def index(make_index):
    return make_index({1: words(0, 40), 2: "x y z", 3: words(0, 20), 4: "x y z", 5: "b " * 30}, size=20, step=15)


@pytest.fixture(scope="module")
def hits(spark):
    def make(rows):
        return spark.createDataFrame(rows, "query_id bigint, doc_id bigint, chunk int, score double, rank int")
    return make


def assembled(index, make_queries, hits, rows, budget):
    asked = make_queries({q: "?" for q in (1, 2, 3)})
    got = assemble_context(asked, hits(rows), index.passages(), budget, 20, 15).collect()
    assert sorted(r.query_id for r in got) == [1, 2, 3]
    return {r.query_id: r for r in got}


def test_rank_order_and_budget(index, make_queries, hits):
    rows = [(1, 2, 0, 9.0, 1), (1, 1, 0, 8.0, 2), (1, 5, 0, 7.0, 3), (2, 1, 0, 3.0, 1)]
    got = assembled(index, make_queries, hits, rows, 23)
    assert got[1].cited == "2:0 1:0" and got[1].n_words == 23 and got[1].n_passages == 2
    assert got[1].context == "x y z\n" + words(0, 20)
    assert (got[3].n_passages, got[3].n_words, got[3].cited, got[3].context) == (0, 0, "", "")
    assert assembled(index, make_queries, hits, rows, 22)[1].cited == "2:0"
    assert assembled(index, make_queries, hits, rows, 2)[1].context == ""


def test_copies_are_given_once(index, make_queries, hits):
    rows = [(1, 4, 0, 9.0, 1), (1, 2, 0, 9.0, 2), (1, 3, 0, 8.0, 3), (1, 1, 0, 7.0, 4)]
    got = assembled(index, make_queries, hits, rows, 100)
    assert got[1].cited == "4:0 3:0" and got[1].n_words == 23


def test_neighbours_share_words(index, make_queries, hits):
    after = assembled(index, make_queries, hits, [(1, 1, 0, 9.0, 1), (1, 1, 1, 8.0, 2)], 100)
    assert after[1].context == words(0, 20) + "\n" + words(20, 35) and after[1].n_words == 35
    before = assembled(index, make_queries, hits, [(1, 1, 1, 9.0, 1), (1, 1, 0, 8.0, 2)], 100)
    assert before[1].context == words(15, 35) + "\n" + words(0, 15) and before[1].n_words == 35
    both = assembled(index, make_queries, hits, [(1, 1, 0, 9.0, 1), (1, 1, 2, 8.0, 2), (1, 1, 1, 7.0, 3)], 100)
    assert both[1].n_words == 40 and both[1].context.split("\n")[2] == words(20, 30)


@pytest.mark.parametrize("history", [0, 1, 3, 100])
def test_conversations(spark, history):
    # One conversation holds most turns; some turn numbers are missing.
    turns = {(1, t): random.choice(["user", "assistant"]) for t in range(300) if t % 9}
    turns |= {(c, t): random.choice(["user", "assistant", "system"]) for c in range(2, 20) for t in range(4)}
    rows = [(c, t, role, f"{c}/{t}") for (c, t), role in turns.items()]
    got = conversation_queries(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), history
    ).collect()
    want = {
        (c, t): "\n".join(f"{c}/{i}" for i in range(t - history, t + 1) if (c, i) in turns)
        for (c, t), role in turns.items() if role == "user"
    }
    assert {(r.conv_id, r.turn): r.text for r in got} == want and len(got) == len(want)
    assert all(r.query_id == r.conv_id * 2**31 + r.turn for r in got)


def test_answer_context(spark, index):
    turns = spark.createDataFrame(
        [(1, 0, "user", "x?"), (1, 1, "assistant", "z"), (1, 2, "user", "nothing known"), (2, 0, "user", "none")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = {r.query_id: r for r in answer_context(turns, index, k=3, budget=10).collect()}
    assert got[2**31].context == "x y z" and got[2**31 + 2].context == "x y z" and got[2**32].context == ""


def test_turns_with_high_numbers(spark):
    turns = spark.createDataFrame(
        [(1, 1_000_001, "user", "a"), (2, 1, "user", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert len({r.query_id for r in conversation_queries(turns).collect()}) == 2
    with pytest.raises(Exception, match="not within"):
        conversation_queries(turns.withColumn("turn", turns["turn"] + 2**31)).collect()
