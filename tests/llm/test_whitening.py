"""Whitening against a dense eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import FOLDER
from tomeseek.llm import queries, whitening

VECTORS = "vec_id bigint, embedding array<double>, component int, x int"


def dense(rows, k=8):
    """n, exact deviations, eigenvalues (falling), components and the trace."""
    x = np.floor(1024 * np.array(rows, float)) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    whole = x.astype(object)
    far = n * whole - whole.sum(0)
    return n, [int(d) for d in (far * far).sum(1)], e, c @ u, np.trace(v)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_query_equals_dense(spark):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    n, far, e, projected, trace = dense([r.embedding for r in given])
    got = by_id(queries.op11_whitening(spark, FOLDER))
    assert sorted(got) == [r.vec_id for r in given] and all(sorted(g) == list(range(1, 9)) for g in got.values())
    want = projected / np.sqrt(e)
    have = np.array([[got[r.vec_id][k].whitened for k in range(1, 9)] for r in given])
    assert np.allclose(have, want * np.sign((have * want).sum(0)), atol=1e-9)
    one = got[given[0].vec_id]
    assert one[1].n == n and one[1].identity_error < 1e-9
    assert all(abs(one[k].explained / (e[k - 1] / trace) - 1) < 1e-9 for k in one)
    assert [got[r.vec_id][1].deviation for r in given] == far


@pytest.mark.parametrize("kind", ["equal deviations", "pairs", "few rows", "flat", "steep", "one direction hidden"])
def test_spectra(spark, kind):
    draw = np.random.default_rng(3)
    if kind == "equal deviations":  # every direction has the same one: one start vector sees a single one
        rows = np.vstack([s * np.eye(10) for s in (1, -1)])
    elif kind == "pairs":
        rows = np.vstack([s * np.eye(12)[i : i + 1] * (1 + i // 2) for i in range(12) for s in (1, -1)])
    elif kind == "few rows":
        rows = draw.standard_normal((5, 20))
    elif kind == "flat":
        rows = draw.standard_normal((300, 12))
    elif kind == "steep":
        rows = draw.standard_normal((300, 40)) * 10.0 ** -np.arange(40).clip(0, 7)
    else:  # two groups of rows that share no dimension
        rows = np.zeros((80, 12))
        rows[:40, :6], rows[40:, 6:] = draw.standard_normal((40, 6)), draw.standard_normal((40, 6))
    n, far, e, projected, trace = dense(rows)
    table = spark.createDataFrame([(i, r.tolist(), 0, 0) for i, r in enumerate(rows)], VECTORS).repartition(3)
    got = by_id(whitening.whiten(table))
    kept = e > 1e-9 * e[0]
    assert len(got) == n and all(len(g) == kept.sum() for g in got.values())
    assert np.allclose([got[0][k].explained for k in sorted(got[0])], e[kept] / trace, rtol=1e-7)
    assert got[0][1].identity_error < 1e-4 and [got[i][1].deviation for i in range(n)] == far
    # With equal eigenvalues the components are one basis of many: all together they give the same distances.
    have = np.array([[got[i][k].whitened for k in sorted(got[i])] for i in range(n)])
    if kind in ("few rows", "flat", "steep", "one direction hidden"):
        want = (projected / np.sqrt(e.clip(1e-300)))[:, kept]
        assert np.allclose(have, want * np.sign((have * want).sum(0)), atol=1e-5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []), (7, [3.0]), (8, [4.0, 5.5])]
    table = spark.createDataFrame([(*r, 1, 1) for r in data], VECTORS)
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2)]
    assert {r.n for r in got} == {4}
    assert whitening.whiten(table.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).where("component = 1").collect() if r.vec_id < 3} == {whitening.LONGEST}
