"""Words close together, contexts without repeats, misspelt names and the paired test, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tomeseek.operators import context, names, ranking, search
from tomeseek.operators.passages import passages

LETTERS = "abcdefg"


def shortest(text, query):
    """start and width of the shortest, earliest stretch with all words of the query as often as it has them."""
    ws, need, best = re.findall(r"[^\W\d_]+", text.lower()), {}, None
    for w in re.findall(r"[^\W\d_]+", query.lower()):
        need[w] = need.get(w, 0) + 1
    for i in range(len(ws)):
        for j in range(i, len(ws)):
            part = ws[i : j + 1]
            if all(part.count(w) >= n for w, n in need.items()):
                if best is None or j - i + 1 < best[1]:
                    best = (i, j - i + 1)
                break
    return best if need else None


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_stretch(make_index, make_queries, seed):
    draw = random.Random(seed)
    docs = {i: " ".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for i in range(20)}
    docs[50] = "a " * 140 + "b c" + " d" * 200 + " a"  # over several passages
    asked = {i: " ".join(draw.choice(LETTERS) for _ in range(draw.randint(1, 4))) for i in range(12)} | {20: "a a b", 21: "", 22: "a nowhere", 23: "1 2", 24: "B, a!"}
    got = {}
    for r in search.proximity_search(make_queries(asked), make_index(docs), 100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.start, r.width))
    want = {}
    for q, text in asked.items():
        found = [(d, *s) for d, t in docs.items() if (s := shortest(t, text))]
        if found:
            want[q] = sorted(found, key=lambda f: (f[2], f[0]))
    assert got == want
    few = search.proximity_search(make_queries(asked), make_index(docs), 2).collect()
    assert sorted((r.query_id, r.doc_id) for r in few) == sorted((q, f[0]) for q, fs in want.items() for f in fs[:2])


def greedy(rows, budget, weight=0.5):
    top, chosen, used = max(r["score"] for r in rows), [], 0
    like = lambda a, b: round(len(set(a) & set(b)) / max(1, len(set(a) | set(b))), 6)
    while True:
        open_ = [r for r in rows if r not in chosen and used + len(r["tokens"]) <= budget]
        if not open_:
            return chosen, used
        near = lambda r: max([0.0, *(like(r["tokens"], c["tokens"]) for c in chosen)])
        best = min(open_, key=lambda r: (-round(weight * r["score"] / top - (1 - weight) * near(r), 6), r["rank"]))
        chosen, used = [*chosen, best], used + len(best["tokens"])


@pytest.mark.parametrize("budget", [0, 25, 60, 1000])
def test_greedy_choice(spark, make_docs, make_queries, budget):
    draw = random.Random(budget)
    docs = {i: " ".join(draw.choice(LETTERS) * draw.randint(1, 3) for _ in range(draw.randint(3, 15))) for i in range(30)}
    docs[30] = docs[3]
    cut = passages(make_docs(docs))
    tokens = {r.doc_id: r.tokens for r in cut.collect()}
    hits = []
    for q in range(6):
        found = draw.sample(range(30), 8) + ([30] if q % 2 else [])
        scores = sorted((round(draw.uniform(0.1, 9), 4) for _ in found), reverse=True)
        hits += [(q, d, 0, s, k + 1) for k, (d, s) in enumerate(zip(found, scores))]
    table = spark.createDataFrame(hits, "query_id bigint, doc_id bigint, chunk int, score double, rank int")
    got = {r.query_id: r for r in context.diverse_context(make_queries({q: "x" for q in range(7)}), table, cut, budget).collect()}
    assert set(got) == set(range(7)) and got[6].n_passages == 0 and got[6].context == ""
    for q in range(6):
        rows = [{"rank": r, "doc": d, "score": s, "tokens": tokens[d]} for a, d, _, s, r in hits if a == q]
        chosen, used = greedy(rows, budget)
        assert got[q].cited == " ".join(f"{c['doc']}:0" for c in chosen) and got[q].n_words == used <= budget
        assert got[q].context == "\n".join(" ".join(c["tokens"]) for c in chosen)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_misspelt_names(spark, make_docs):
    draw = random.Random(5)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(4, 7))) for _ in range(300)]
    aliases = {i: " ".join(draw.sample(words[:60], draw.randint(1, 3))) for i in range(40)} | {90: "abcde abcde", 91: "Abcde", 92: ""}
    terms = sorted(set(words) | {"abcdf", "abcd", "bcde", "xabcde", "abde", "acbde"})
    given = spark.createDataFrame([(t,) for t in terms], "term string")
    glossary = spark.createDataFrame(list(aliases.items()), "entity_id bigint, alias string")
    got = {tuple(r) for r in names.misspelt_names(given, glossary).collect()}
    own = {w for a in aliases.values() for w in a.lower().split()}
    want = set()
    for entity, alias in aliases.items():
        parts = alias.lower().split()
        for w in set(parts):
            for t in terms:
                variant = " ".join(t if x == w else x for x in parts)
                if len(w) >= 5 and len(t) >= 5 and t not in own and one_edit(w, t) and variant not in {a.lower() for a in aliases.values()}:
                    want.add((entity, alias.lower(), w, t, variant))
    assert got == want and ("abcde", "xabcde") in {(r[2], r[3]) for r in got}

    glossary = spark.createDataFrame([(7, "iron keep tower"), (8, "stonehenge")], "entity_id bigint, alias string")
    docs = make_docs({1: "an iron keep towwr and stonehange", 2: "iron keep tower, stonehenge", 3: "stonehenges"})
    cut = passages(docs)
    terms = cut.selectExpr("explode(tokens) AS term").distinct()
    found = {(r.doc_id, r.pos, r.len, r.entity_id) for r in names.link_misspelt(cut, terms, glossary).collect()}
    assert found == {(1, 1, 3, 7), (1, 5, 1, 8), (3, 0, 1, 8)}


def test_paired_test(spark):
    draw = random.Random(9)
    truth = [(q, q * 10) for q in range(25)]
    cols = "query_id bigint, doc_id bigint, chunk int, score double, rank int"

    def hits(place):
        return [(q, d if k == p else 1000 + k, 0, 1.0, k) for q, d in truth for p in [place(q)] for k in range(1, 6)]

    places = {"a": [draw.choice([1, 1, 2, 9]) for _ in truth], "b": [draw.choice([1, 2, 3, 9]) for _ in truth]}
    tables = {n: spark.createDataFrame(hits(lambda q: p[q]), cols) for n, p in places.items()}
    known = spark.createDataFrame(truth, "query_id bigint, doc_id bigint")
    got = ranking.paired_test(tables["a"], tables["b"], known, rounds=300, seed=3).collect()
    gain = lambda p: round(1e9 / p) if p <= 5 else 0
    d = [gain(a) - gain(b) for a, b in zip(places["a"], places["b"])]
    flip = lambda r, q: 1 if hashlib.md5(f"3:{r}:{q}".encode()).hexdigest()[0] < "8" else -1
    far = 1 + sum(abs(sum(x * flip(r, q) for q, x in enumerate(d))) >= abs(sum(d)) for r in range(1, 301))
    assert len(got) == 1 and got[0].n_queries == 25 and got[0].p_value == round(far / 301, 6)
    assert got[0].mean_a == round(sum(map(gain, places["a"])) / 25 / 1e9, 6) and got[0].difference == round(sum(d) / 25 / 1e9, 6)
    same = ranking.paired_test(tables["a"], tables["a"], known, rounds=50).collect()[0]
    assert same.p_value == 1.0 and same.difference == 0.0
    assert ranking.paired_test(tables["a"], tables["b"], known.limit(0)).count() == 0
