from __future__ import annotations

import re

import pyarrow as pa
import pytest

from tomeseek import schemas
from tomeseek.functions import dense
from tomeseek.operators.passages import passages, postings

TEXTS = {
    0: "", 1: "Word", 2: "... 12 --", 3: " ".join(f"w{chr(97 + i % 26)}" for i in range(128)),
    4: " ".join(f"w{chr(97 + i % 7)}" for i in range(129)), 5: "Ärger über Öl", 6: "Дракон и 龍 の話",
    7: "a b a " * 100, 8: " ".join(["the"] * 321), 9: "x'y don't",
}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


@pytest.fixture(scope="module")
def cut(spark, make_docs):
    return passages(make_docs(TEXTS)).collect()


def test_owned_words_give_the_whole_text_once(cut):
    for doc_id, text in TEXTS.items():
        mine = sorted((r for r in cut if r.doc_id == doc_id), key=lambda r: r.chunk)
        assert [w for r in mine for w in r.tokens[:r.own]] == words(text)
        assert [r.chunk for r in mine] == list(range(len(mine)))


def test_windows(cut):
    for r in cut:
        text = words(TEXTS[r.doc_id])
        assert r.tokens == text[r.chunk * 96:r.chunk * 96 + 128]
        assert 0 < r.n_tokens == len(r.tokens) <= 128
    assert sum(r.doc_id == 3 for r in cut) == 1
    assert sum(r.doc_id == 4 for r in cut) == 2
    assert not [r for r in cut if r.doc_id in (0, 2)]


def test_other_sizes(make_docs):
    rows = passages(make_docs({1: "a b c d e f g"}), size=4, step=3).orderBy("chunk").collect()
    assert [r.tokens for r in rows] == [list("abcd"), list("defg")]


def test_postings(spark, make_docs):
    cut = passages(make_docs(TEXTS), size=16, step=12)
    got = {(r.doc_id, r.chunk, r.term): (r.tf, r.own_tf, r.positions, r.len) for r in postings(cut, 12).collect()}
    want = {}
    for r in cut.collect():
        for term in set(r.tokens):
            places = [i for i, t in enumerate(r.tokens) if t == term]
            own = sum(i < r.own for i in places)
            want[(r.doc_id, r.chunk, term)] = (len(places), own, [i + 12 * r.chunk for i in places], r.n_tokens)
    assert got == want


def test_the_tokeniser_runs_once_for_each_row(make_docs):
    plan = passages(make_docs({1: "a"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_schema_check(spark):
    with pytest.raises(ValueError, match="text"):
        schemas.require(spark.range(1).withColumnRenamed("id", "doc_id"), schemas.DOCUMENTS, "documents")


def test_postings_are_made_in_order_of_their_terms():
    """Spark then merges a few long runs where the table is sorted by term."""
    tokens = [["b", "z", "é", "a", "b"], ["ab", "b", "Z", "a"], ["ﬀ", "𐐨", "a"]]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [3, 3, 5], "chunk": pa.array([0, 1, 0], pa.int32()), "tokens": tokens, "own": pa.array([4, 4, 3], pa.int32()),
        "lang": ["en"] * 3, "source": ["s"] * 3})
    (out,) = dense.postings_of(iter([batch]), 4)
    rows = [(r["term"].encode(), r["doc_id"], r["chunk"]) for r in out.to_pylist()]
    assert rows == sorted(rows) and len(rows) == sum(len(set(t)) for t in tokens)
    assert [r["positions"] for r in out.to_pylist() if r["term"] == "b"] == [[0, 4], [5]]
    assert [r["own_tf"] for r in out.to_pylist() if r["term"] == "b"] == [1, 1]
