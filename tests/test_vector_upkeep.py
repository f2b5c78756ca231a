"""A kept vector index against one built anew, and against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeseek.operators import vector_upkeep, vectors
from tomeseek.session import new_folder

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(rows, asked, k):
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q, v in asked.items():
        v = np.array(v, np.float32).astype(float)
        scores = np.round(x @ (v / np.linalg.norm(v)), 5)
        out += [(q, int(ids[i])) for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]]
    return sorted(out)


@pytest.fixture
def rows():
    draw = np.random.default_rng(11)
    centers = draw.standard_normal((6, 8))
    return {i: (centers[i % 6] + 0.5 * draw.standard_normal(8)).tolist() for i in range(240)}


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMA)


def test_three_updates_equal_a_new_build(spark, rows):
    draw = np.random.default_rng(12)
    asked = {i: draw.standard_normal(8).tolist() for i in range(12)}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, embedding array<float>")
    held = {i: v for i, v in rows.items() if i < 120}
    index = first = vectors.build_vector_index(table(spark, held), new_folder(spark, "kept"), 5)
    crowd = {1000 + i: (np.array(rows[0]) + 0.05 * draw.standard_normal(8)).tolist() for i in range(150)}
    updates = [
        ({i: v for i, v in rows.items() if 120 <= i < 200}, range(0, 40, 3)),
        (crowd | {7: rows[239]}, [5, 150, 99999]),  # a crowd around one vector, and an id given anew
        ({i: v for i, v in rows.items() if i >= 200} | {150: rows[150]}, [1001, 1002]),
    ]
    for added, removed in updates:
        index = vector_upkeep.update_vectors(index, table(spark, added), spark.createDataFrame([(i,) for i in removed], "vec_id bigint"))
        held = {i: v for i, v in held.items() if i not in set(removed)} | added
        got = index.vectors().collect()
        assert sorted(r.vec_id for r in got) == sorted(held)
        lists = {r.list_id: r for r in index.lists().collect()}
        for r in got:
            unit = np.array(r.embedding) / np.linalg.norm(r.embedding)
            assert abs(np.linalg.norm(unit - lists[r.list_id].center) - r.list_dist) < 1e-5 and r.list_dist <= lists[r.list_id].radius + 1e-9
        assert {i: r.n for i, r in lists.items() if r.n} == {i: sum(r.list_id == i for r in got) for i in {r.list_id for r in got}}
        assert sorted((r.query_id, r.vec_id) for r in vectors.vector_search(queries, index, 5).collect()) == exact(held, asked, 5)
    fresh = vectors.build_vector_index(table(spark, held), new_folder(spark, "fresh"), 5)
    key = lambda r: (r.query_id, r.rank)
    assert sorted(vectors.vector_search(queries, index, 5).collect(), key=key) == sorted(vectors.vector_search(queries, fresh, 5).collect(), key=key)
    # The crowd's list was split, and the first state can still be searched.
    assert len(lists) > 5 and sorted((r.query_id, r.vec_id) for r in vectors.vector_search(queries, first, 5).collect()) == exact({i: v for i, v in rows.items() if i < 120}, asked, 5)
    assert vector_upkeep.open_kept(first).last == 3


def test_an_update_that_is_cut_off(spark, rows, monkeypatch):
    index = vectors.build_vector_index(table(spark, rows), new_folder(spark, "kept"), 4)
    with monkeypatch.context() as cut:
        cut.setattr(vector_upkeep, "_two_centers", lambda own: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            vector_upkeep.update_vectors(index, table(spark, {500: rows[3]}), crowded=0.1)
    assert vector_upkeep.open_kept(index).last == 0 and vector_upkeep.open_kept(index).vectors().count() == 240
    odd = spark.createDataFrame([(500, rows[3]), (None, rows[4]), (501, None), (502, [float("nan")] * 8), (503, [None] * 8)], SCHEMA)
    again = vector_upkeep.update_vectors(index, odd)
    assert again.last == 1 and again.vectors().count() == 241
    nothing = vector_upkeep.update_vectors(again, odd.limit(0))
    assert nothing.vectors().count() == 241 and nothing.vectors().select(F.count_distinct("vec_id")).first()[0] == 241
    alike = vector_upkeep.update_vectors(nothing, table(spark, {i: [1.0] * 8 for i in range(2000, 2400)}), spark.createDataFrame([(i,) for i in range(600)], "vec_id bigint"))
    assert alike.vectors().count() == 400  # a list of equal vectors is not split
