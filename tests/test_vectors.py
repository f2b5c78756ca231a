from __future__ import annotations

import numpy as np
import pytest

from conftest import FOLDER
from tomeseek.operators import vectors as V
from tomeseek.session import new_folder
from tomeseek.sources import tables

rng = np.random.default_rng(5)
CLUSTERS = rng.normal(size=(6, 8)) * 3
# A third of all vectors are copies of one; some are zero.
POINTS = np.concatenate([
    CLUSTERS[rng.integers(0, 6, 180)] + rng.normal(size=(180, 8)), np.repeat(CLUSTERS[:1], 90, axis=0), np.zeros((3, 8)),
]).astype(np.float32)
ASKED = np.concatenate([POINTS[:4], rng.normal(size=(4, 8)), np.zeros((1, 8))]).astype(np.float32)


def frame(spark, key, points):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


def brute(k):
    a, b = ASKED.astype(float), POINTS.astype(float)
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    scores = np.round(np.divide(a @ b.T, lengths, out=np.zeros_like(lengths), where=lengths > 0), 5) + 0.0
    return {q: [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(b)), -s))[:k]] for q, s in enumerate(scores)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score + 0.0))
    return out


@pytest.fixture(scope="module")
def index(spark):
    return V.build_vector_index(frame(spark, "vec_id", POINTS), new_folder(spark, "test-vectors"), 6)


@pytest.mark.parametrize("queries_at_once", [4096, 2])
@pytest.mark.parametrize("k", [1, 10, 400])
def test_exact_search(monkeypatch, spark, index, k, queries_at_once):
    monkeypatch.setattr(V, "BLOCK_QUERIES", queries_at_once)
    assert found(V.vector_search(frame(spark, "query_id", ASKED), index, k)) == brute(k)


def test_no_queries(spark, index):
    assert V.vector_search(frame(spark, "query_id", ASKED).limit(0), index, 3).collect() == []


def test_exact_search_leaves_lists_out(monkeypatch, spark, index):
    chosen = []
    scan = V._Block.scan
    monkeypatch.setattr(V._Block, "scan", lambda self, i, c, b, k: chosen.append(c) or scan(self, i, c, b, k))
    V.vector_search(frame(spark, "query_id", POINTS[:4]), index, 5).collect()
    assert chosen[1].sum() < chosen[1].size


def test_all_lists_probed_is_exact(spark, index):
    assert found(V.vector_search_ivf(frame(spark, "query_id", ASKED), index, 10, 6)) == brute(10)


def test_every_vector_is_in_one_list(index):
    assert index.vectors().count() == len(POINTS) == index.vectors().select("vec_id").distinct().count()
    assert index.lists().agg({"n": "sum"}).first()[0] == len(POINTS)


def test_recall_grows_with_the_lists_probed(spark):
    vectors = tables.embeddings(spark, FOLDER)
    index = V.build_vector_index(vectors, new_folder(spark, "test-vectors"), 16)
    asked = vectors.selectExpr("vec_id AS query_id", "embedding")
    exact = found(V.vector_search(asked, index, 10))
    recall = []
    for n_probe in (1, 4, 16):
        near = found(V.vector_search_ivf(asked, index, 10, n_probe))
        recall.append(np.mean([len(set(near[q]) & set(exact[q])) / 10 for q in exact]))
    assert recall[0] < recall[1] < recall[2] == 1.0
    assert recall[1] > 0.5


def test_plan(spark, index):
    df = V.vector_search(frame(spark, "query_id", ASKED), index, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "PartitionFilters: [list_id" in plan and "WindowGroupLimit" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # each task's k best, by query


def test_vectors_with_gaps_take_no_part(spark):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    index = V.build_vector_index(table, new_folder(spark, "gaps"), 2)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r.vec_id for r in V.vector_search(asked, index, 9).orderBy("rank").collect()] == [1, 6]
