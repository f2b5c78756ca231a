"""Each registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import oracle, rows
from conftest import FOLDER


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(entry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [str(got[c].dtype) for c in sorted(got)] == [str(want[c].dtype) for c in sorted(want)]
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # Learned codes can't be followed in SQL: that query's recall is tested on its own.
    assert set(entry.QUERIES) == {*entry.ORACLES, "vector_search_quantised"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "chunk", "score", "rank"]
