from __future__ import annotations

import math

import pytest

from tomeseek.operators.ranking import rank_fusion, retrieval_eval

HITS = "query_id bigint, doc_id bigint, chunk int, score double, rank int"


def test_fusion_ignores_the_order_of_rankings(spark):
    a = spark.createDataFrame([(1, 10, 0, 5.0, 1), (1, 11, 0, 4.0, 2), (2, 10, 0, 1.0, 1)], HITS)
    b = spark.createDataFrame([(1, 11, 0, 0.9, 1), (1, 12, 0, 0.8, 2), (1, 10, 0, 0.7, 3)], HITS)
    one, two = (sorted(tuple(r) for r in rank_fusion(x, 2).collect()) for x in ([a, b], [b, a]))
    assert one == two
    assert one == [
        (1, 10, 0, round(1 / 61 + 1 / 63, 8), 2), (1, 11, 0, round(1 / 62 + 1 / 61, 8), 1),
        (2, 10, 0, round(1 / 61, 8), 1),
    ]


def test_eval_by_hand(spark):
    hits = spark.createDataFrame([
        (1, 10, 0, 9.0, 1), (1, 10, 1, 8.0, 2), (1, 11, 0, 7.0, 3), (1, 12, 0, 6.0, 4),  # documents 10, 11, 12
        (2, 20, 0, 5.0, 1),
    ], HITS)
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 99), (1, 11)], "query_id bigint, doc_id bigint")
    got = {r.k: r for r in retrieval_eval(hits, truth, [1, 2, 3]).collect()}
    assert all(r.n_queries == 2 for r in got.values())
    assert (got[1].recall, got[1].mrr, got[1].ndcg) == (0.0, 0.0, 0.0)
    assert got[2].recall == 0.25 and got[2].mrr == 0.25
    ideal = 1 + 1 / math.log2(3)
    assert got[2].ndcg == pytest.approx((1 / math.log2(3)) / ideal / 2, abs=1e-6)
    assert got[3].recall == 0.5
    assert got[3].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal / 2, abs=1e-6)
