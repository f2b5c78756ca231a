"""Search on codes: codes and estimates against plain numpy, recall against the exact search, odd vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomeseek.functions import dense
from tomeseek.operators import quantised
from tomeseek.session import new_folder

LARGE = "/root/testdata/sf0.1"


def test_codes_and_estimates():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((200, 16))
    books = quantised.learn_books(x, 4, 7)
    codes = quantised.decode(quantised.encode(x, books))
    for row, code in zip(x, codes):
        for part in range(4):
            own = row[4 * part : 4 * part + 4]
            assert code[part] == np.argmin([np.linalg.norm(own - e) for e in books[part]])
    q = draw.standard_normal((3, 16))
    tables = np.stack([q[:, 4 * p : 4 * p + 4] @ books[p].T for p in range(4)], axis=1).astype(np.float32)
    rebuilt = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)
    assert np.allclose(quantised.estimates(tables, codes), q @ rebuilt.T, atol=1e-5)


def test_recall_over_every_hundredth(spark, monkeypatch):
    """Sixteen bytes a vector instead of 256, a hundred of 2,000 read whole."""
    want = {(r.query_id, r.vec_id): r.score for r in entry.vector_search(spark, LARGE).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in entry.vector_search_quantised(spark, LARGE).collect()}
    both = want.keys() & got.keys()
    print("recall", len(both) / len(want))
    assert len(got) == len(want) and len(both) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) <= 1e-5 for p in both)
    sizes = entry._codes(spark, LARGE).table("codes").select(F.octet_length("code")).distinct().collect()
    assert [r[0] for r in sizes] == [16]
    # In blocks, and with every vector a candidate: the exact result.
    monkeypatch.setattr(quantised, "BLOCK_QUERIES", 7)
    all_ = quantised.vector_search_quantised(entry._vector_queries(spark, LARGE), entry._codes(spark, LARGE), 10, 2000).collect()
    assert {(r.query_id, r.vec_id) for r in all_} == want.keys()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    index = quantised.build_code_index(vectors, new_folder(spark, "codes"), parts=2)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (9, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    got = [(r.query_id, r.vec_id, r.score, r.rank) for r in quantised.vector_search_quantised(asked, index, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 2, 0.0, 2), (1, 2, 0.0, 3), (9, 1, 0.0, 1), (9, 2, 0.0, 2), (9, 2, 0.0, 3)]
    assert quantised.vector_search_quantised(asked.limit(0), index, 3).count() == 0
    none = quantised.build_code_index(vectors.limit(0), new_folder(spark, "codes"), parts=2)
    assert quantised.vector_search_quantised(asked, none, 3).count() == 0
    assert dense.unit(np.zeros((1, 2)))[0].tolist() == [[0.0, 0.0]]
