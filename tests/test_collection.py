from __future__ import annotations

from tomeseek.operators import collection
from tomeseek.plans import joins

TEXTS = {1: "Some Words", 2: "some\n words ", 3: "other", 4: "", 5: "SOME WORDS", 6: " "} | {i: "hot" for i in range(10, 40)}


def test_copies_both_ways(make_docs, monkeypatch):
    docs = make_docs(TEXTS)
    docs = docs.union(make_docs({7: ""}).selectExpr("doc_id", "NULL AS text", "lang", "source", "n_chars"))
    rows = []
    for small in (True, False):
        monkeypatch.setattr(joins, "is_small", lambda df, small=small: small)
        rows.append(sorted(tuple(r) for r in collection.exact_copies(docs).collect()))
    assert rows[0] == rows[1]
    assert rows[0][:7] == [(1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 3), (5, 1, 3), (6, 4, 3), (7, 4, 3)]
    assert all(r[1:] == (10, 30) for r in rows[0][7:])
    assert sorted(r.doc_id for r in collection.exact_dedup(docs).collect()) == [1, 3, 4, 10]


def test_profile(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {(r.level, r.lang): r for r in collection.corpus_profile(make_docs({1: "a", 2: "A", 3: "b"}), labels).collect()}
    assert got[3, None].n_docs == 3 and got[3, None].n_copies == 1 and got[3, None].good == 0.5
    assert got[1, "en"].n_labelled == 1 and got[1, "xx"].n_chars == 2 and got[0, "xx"].toxic == 0.0
