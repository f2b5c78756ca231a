from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tomeseek.operators import names
from tomeseek.operators.passages import passages
from tomeseek.plans import joins

random.seed(9)
ALIASES = {
    1: "Red Dragon", 2: "dragon", 3: "red dragon of doom", 4: "doom", 5: "Doom Hall", 6: "hall", 7: "red", 8: "Dragon!",
    9: "of doom hall",
}
VOCABULARY = ["red", "dragon", "of", "doom", "hall", "x", "y"]
TEXTS = {i: " ".join(random.choice(VOCABULARY) for _ in range(n)) for i, n in enumerate([0, 1, 3, 40, 127, 129, 700])}
TEXTS[7] = "Red dragon of doom hall"


def brute(size=128, step=96):
    out, margin = [], (size - step) // 2
    aliases = {(e, tuple(a.lower().strip("!").split())) for e, a in ALIASES.items()}
    for d, t in TEXTS.items():
        w = t.lower().split()
        last = max(len(w) - 1 - (size - step), 0) // step
        all_ = [(p, len(a), e) for e, a in aliases for p in range(len(w))
                if tuple(w[p:p + len(a)]) == a]
        for p, n, e in all_:
            if not any(q < p + n and p < q + m and (m > n or (m == n and q < p)) for q, m, _ in all_):
                out.append((d, min(max((p - margin) // step, 0), last), p, n, e))
    return sorted(out)


@pytest.fixture(scope="module")
def glossary(spark):
    return spark.createDataFrame([(e, a, "k") for e, a in ALIASES.items()], "entity_id bigint, alias string, kind string")


@pytest.mark.parametrize(
    "small", [lambda df: True, lambda df: False, lambda df: df.columns == ["w0"]], ids=["all", "none", "first words"])
def test_link_entities(monkeypatch, make_docs, glossary, small):
    monkeypatch.setattr(names, "is_small", small)
    got = names.link_entities(passages(make_docs(TEXTS)), glossary)
    assert sorted(tuple(r) for r in got.collect()) == brute()
    assert (7, 0, 0, 4, 3) in brute()


def test_names_of_any_length(spark, make_docs):
    tower, saga = "the very old red stone tower", " ".join(f"{c}{d}" for c in "abcdefghij" for d in "klmnopq")
    texts = {1: f"{tower} red", 2: "x " * 90 + tower + " x" * 200, 3: "x " * 30 + saga + " y", 4: saga[3:]}
    rows = [(1, tower, "k"), (2, "red", "k"), (3, saga, "k"), (4, saga.replace(" ", ", "), "k"), (5, "?", "k")]
    known = spark.createDataFrame(rows, "entity_id bigint, alias string, kind string")
    # Passages of 10 words that share 2: the second name is longer than any of them.
    got = names.link_entities(passages(make_docs(texts), 10, 8), known, 10, 8)
    assert sorted((r.doc_id, r.pos, r.len, r.entity_id) for r in got.collect()) == [
        (1, 0, 6, 1), (1, 6, 1, 2), (2, 90, 6, 1), (3, 30, 70, 3), (3, 30, 70, 4)]


def test_names_on_both_sides_of_a_border(spark):
    rows = [(1, 0, 111, 1, 7), (1, 1, 112, 1, 8), (1, 1, 160, 1, 9), (2, 0, 111, 1, 9)]
    mentions = spark.createDataFrame(rows, "doc_id bigint, chunk int, pos int, len int, entity_id bigint")
    assert [(r.entity_a, r.entity_b, r.n) for r in names.entity_graph(mentions).collect()] == [(7, 8, 1)]


@pytest.mark.parametrize("within", [1, 7, 32])
def test_entity_graph(spark, make_docs, glossary, within):
    mentions = names.link_entities(passages(make_docs(TEXTS)), glossary)
    n = Counter()
    for d, _, p, _, e in brute():
        for d2, _, q, _, other in brute():
            if d == d2 and abs(p - q) <= within and e < other:
                n[e, other] += 1
    share, total = Counter(), sum(n.values())
    for (a, b), c in n.items():
        share[a] += c
        share[b] += c
    want = {(a, b): (c, math.log(2 * c * total / (share[a] * share[b]))) for (a, b), c in n.items()}
    got = {(r.entity_a, r.entity_b): (r.n, r.pmi) for r in names.entity_graph(mentions, within).collect()}
    assert got.keys() == want.keys()
    for pair, (count, pmi) in want.items():
        assert got[pair][0] == count and got[pair][1] == pytest.approx(pmi, abs=1e-6)


def test_salted_join_equals_broadcast(spark):
    large = spark.range(1000).selectExpr("IF(id % 3 = 0, 0, id % 7) AS key", "id")
    small = spark.range(5).selectExpr("id AS key", "id * 2 AS value")
    rows = [sorted(joins.join_small(large, small, "key", ["id"], way).select("key", "id", "value").collect())
            for way in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) > 500


def test_is_small(spark):
    assert joins.is_small(spark.range(10), max_rows=10)
    assert not joins.is_small(spark.range(11), max_rows=10)
    assert not joins.is_small(spark.range(1).selectExpr("repeat('x', 2000) AS t"), max_bytes=1000)
    assert joins.is_small(spark.range(0))


def test_runs_of_words_that_are_no_name_are_not_shuffled(monkeypatch, spark, make_docs, glossary):
    large = spark.range(20_000).selectExpr("id", "concat('word ', id) AS alias")
    keys = spark.range(0, 40_000, 20).selectExpr("concat('word ', id) AS alias")
    left = {r.id for r in joins.thinned(large, keys, "alias").collect()}
    assert set(range(0, 20_000, 20)) <= left and len(left) < 1_050
    # With a glossary that is not small, runs are thinned before they are joined.
    met = []

    def counted(rows, *given):
        out = joins.thinned(rows, *given)
        met.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(names, "is_small", lambda df: False)
    monkeypatch.setattr(names, "thinned", counted)
    texts = TEXTS | {20: "z " * 500}
    got = names.link_entities(passages(make_docs(texts)), glossary)
    assert sorted(tuple(r) for r in got.collect()) == brute()
    assert met[0][1] < met[0][0] - 1_400


@pytest.mark.parametrize("shifted", [1, 8])
def test_short_and_long_names_meet_the_text_alike(monkeypatch, make_docs, glossary, shifted):
    """Words ahead as columns of their own, or as slices where names are long."""
    monkeypatch.setattr(names, "SHIFTED", shifted)
    got = names.link_entities(passages(make_docs(TEXTS)), glossary)
    assert sorted(tuple(r) for r in got.collect()) == brute()


def test_names_that_are_nowhere_are_not_copied_for_salts(monkeypatch, spark, make_docs, glossary):
    many = glossary.unionByName(spark.range(5000).selectExpr("id + 100 AS entity_id", "concat('name', translate(id, '0123456789', 'abcdefghij')) AS alias", "'k' AS kind"))
    copied = []

    def counted(large, small, on, spread, *given):
        copied.append(small.count())
        return joins.join_small(large, small, on, spread, *given)

    monkeypatch.setattr(names, "is_small", lambda df: False)
    monkeypatch.setattr(names, "join_small", counted)
    got = names.link_entities(passages(make_docs(TEXTS)), many)
    assert sorted(tuple(r) for r in got.collect()) == brute()
    assert copied and max(copied) < 100


def test_frequent_keys_are_joined_apart(monkeypatch, spark):
    large = joins.written(spark.range(1000).selectExpr("IF(id % 3 = 0, 0, id % 70) AS key", "id"), "test-large")
    small = spark.range(50).selectExpr("id AS key", "id * 2 AS value")
    want = sorted(large.join(small, "key").select("key", "id", "value").collect())
    for is_small in (lambda df: True, lambda df: False):
        monkeypatch.setattr(joins, "is_small", is_small)
        for most in (10_000, 100, 3):
            assert sorted(joins.join_skewed(large, small, "key", ["id"], most).select("key", "id", "value").collect()) == want
