"""Queries with SQL against it, and mixing and top-k on odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import oracle, rows
from conftest import FOLDER
from tomeseek.llm import decontamination, mixing, near_dups, queries, top_k
from tomeseek.llm.common import table


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = oracle(FOLDER).sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s1", 1000), ("b", "en", "s1", 5000)],
        "domain string, lang string, source string, tokens bigint")
    plan = {(r.domain, r.lang, r.source): r.full * r.tokens + r.rest for r in mixing.plan_mixture(leaves, 0.2, {"domain": {"a": 1, "b": 1}}, 1).collect()}
    # 1,420 tokens: 710 a domain, 355 a language, of which s1 has 100 only and s2 takes the rest.
    assert plan == {("a", "en", "s1"): 100, ("a", "en", "s2"): 255, ("a", "de", "s1"): 355, ("b", "en", "s1"): 710}


def test_mixing_odd_tables(spark):
    data = [(1, None, "en", "src1", 9), (None, "a b c", None, None, 9), (2, "x y", "en", "src1", 9), (2, "x y", "en", "src1", 9), (3, "", "de", "other", 9), (4, "w " * 40_000, "de", "src2", 9)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, leaf_lang int")
    given = {"domain": mixing.domain_of("source"), "share": 5.0, "weights": {}, "epochs": 2}
    out = mixing.mixed_documents(docs, **given)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 2, 2, 2, 2, 4, 4]
    assert mixing.mixed_documents(docs.limit(0), **given).count() == 0


def test_top_k_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (0, [1.0, 0.25]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [None, 1.0]), (50, [3.0]), (7, [-0.001]), (8, []), (100, [])]
    got = top_k.exact_top_k(spark.createDataFrame([(*r, 1) for r in data], "vec_id bigint, embedding array<double>, rank int"))
    found = sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))
    one = 256 * 256 + 64 * 256
    assert found == [(0, 1, 1, one), (0, 2, 1, one), (50, 1, 7, -768), (100, 1, 8, 0)]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert top_k.exact_top_k(none).count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    good = corpus_pipeline.good_text(spark, docs, FOLDER)
    assert good.columns == docs.columns and 0.6 * docs.count() < good.count() < docs.count()
    single = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    _, classes = near_dups.near_duplicates(docs)
    assert single.count() == single.select("doc_id").distinct().count() == classes.select("root").distinct().count()
    clean = corpus_pipeline.free_of_benchmark(spark, docs, FOLDER)
    leaked = decontamination.find_leaks(docs, table(spark, FOLDER, "benchmark")).select("doc_id").distinct()
    assert clean.count() == docs.count() - leaked.count() and clean.join(leaked, "doc_id").count() == 0
    mixed = corpus_pipeline.mixed(spark, docs, FOLDER)
    copies = queries.op7_mixing(spark, FOLDER).agg(F.sum("copies")).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_pipeline_runs_to_the_end(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    found = sorted(out.collect(), key=lambda r: r.start)
    assert len(found) and found[0].start == 0
    assert all(b.start == a.start + a.n_tokens and b.doc_id >= a.doc_id for a, b in zip(found, found[1:]))
