"""Standing questions: streams against one batch, micro-batches that are run again, many and few questions."""

from __future__ import annotations

import random
import re

import pytest

from tomeseek.session import new_folder
from tomeseek.streaming import standing

LETTERS = [a + b for a in "abcdef" for b in "xyz"]


def found(df):
    return sorted((r.query_id, r.doc_id) for r in df.collect())


def plain(docs, asked):
    ws = lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower()))
    return sorted((q, d) for q, text in asked.items() for d, t in docs.items() if ws(text) and ws(text) <= ws(t))


@pytest.fixture
def tables(make_docs, make_queries):
    draw = random.Random(6)
    docs = {i: " ".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 12))) for i in range(60)} | {90: None, 91: "Ax, AX; ay!"}
    asked = {i: " ".join(draw.choice(LETTERS) for _ in range(draw.randint(1, 3))) for i in range(30)} | {50: "", 51: "12 !", 52: "ax ax AY"}
    return docs, asked, spark_docs(make_docs, docs), make_queries(asked)


def spark_docs(make_docs, docs):
    return make_docs({i: t or "" for i, t in docs.items()}).selectExpr("doc_id", "IF(doc_id = 90, NULL, text) AS text", "lang", "source", "n_chars")


@pytest.mark.parametrize("small", [True, False])
def test_matches_equal_plain(tables, monkeypatch, small):
    docs, asked, given, queries = tables
    questions = standing.file_questions(queries)
    monkeypatch.setattr(standing, "is_small", lambda df: small)
    assert found(standing.match_questions(given, questions)) == plain(docs, asked)
    assert found(standing.match_questions(given.unionByName(given), questions)) == plain(docs, asked)
    assert standing.match_questions(given.limit(0), questions).count() == 0
    assert standing.match_questions(given, standing.file_questions(queries.limit(0))).count() == 0


def test_filed_under_the_rarest_word(spark, make_queries):
    counts = spark.createDataFrame([("common", 9), ("rare", 1)], "term string, df bigint")
    filed = standing.file_questions(make_queries({1: "common rare", 2: "common new"}), counts)
    assert {r.query_id: r.term for r in filed.collect()} == {1: "rare", 2: "new"}
    assert {r.query_id: r.term for r in standing.file_questions(make_queries({1: "at common rare"})).collect()} == {1: "common"}


def test_stream_equals_batch(spark, tables):
    docs, asked, given, queries = tables
    source, out, state = (new_folder(spark, name) for name in ("documents", "matches", "state"))
    questions = standing.file_questions(queries)
    given.where("doc_id < 20").coalesce(1).write.parquet(source)
    first = standing.match_stream(spark, source, questions, out, state, max_files=1)
    assert found(first) == plain({i: t for i, t in docs.items() if i < 20}, asked)
    given.where("doc_id >= 15").repartition(3).write.mode("append").parquet(source)
    assert found(standing.match_stream(spark, source, questions, out, state, max_files=1)) == plain(docs, asked)
    # Nothing new, then all micro-batches once more by another run over the same numbers.
    assert found(standing.match_stream(spark, source, questions, out, state)) == plain(docs, asked)
    again = standing.match_stream(spark, source, questions, out, new_folder(spark, "state"), max_files=1)
    assert found(again) == plain(docs, asked)
