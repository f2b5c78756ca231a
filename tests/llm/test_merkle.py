"""The Merkle manifest against plain Python and SQL."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from check import oracle, rows
from conftest import FOLDER
from tomeseek.llm import merkle, queries

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, i int, n int, tree int, digest string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """The top, and each leaf's siblings as (side, digest)."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            if other < len(level):
                proofs[k].append(("l" if other < i else "r", level[other]))
            else:
                proofs[k].append(("-", None))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def plain_manifest(data):
    langs = {}
    for doc_id, source, lang, n_chars, text in data:
        own = leaf((doc_id, source, lang, n_chars, text))
        changed = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        langs.setdefault(lang, []).append((doc_id, own, leaf((doc_id, source, lang, n_chars + 1, text)) if changed else own))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        tops[lang] = tree([r[1] for r in langs[lang]])
    root, above = tree([tops[x][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for (doc_id, own, start), proof in zip(langs[lang], tops[lang][1]):
            proof, folded = proof + above[k], start
            for side, d in proof:
                folded = H(folded) if side == "-" else H(d, folded) if side == "l" else H(folded, d)
            out.append((doc_id, own, tops[lang][0], root, H(*(d for _, d in proof if d)), folded, folded == root))
    return sorted(out, key=str)


def test_query_equals_sql(spark):
    got = queries.op13_merkle(spark, FOLDER).toPandas()
    want = oracle(FOLDER).sql(queries.ORACLES["op13_merkle"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
    changed = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 7 == 0)
    assert (got["verified"] == ~changed).all() and changed.any()


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_trees_of_all_sizes(spark, monkeypatch, levels):
    """Blocks of few levels: several rounds, last blocks with one node, trees that end in different rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {"a": 1, "b": 2, "c": 3, "é": 17, "hot": 70, None: 5, "": 9, "z": 33}
    data = [(1000 * k + j, "s", lang, j, f"text {j}") for k, (lang, n) in enumerate(sizes.items()) for j in range(n)]
    got = merkle.manifest(spark.createDataFrame([(*r, 1, 1, 1, "x") for r in data], DOCS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(data)


def test_odd_documents(spark):
    data = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", None, ""), (5, "s", "en", 3, "x"), (5, "s", "en", 3, "x"), (-3, "", "", 0, "é" * 500_000), (7, "s", "en", (1 << 63) - 1, "y")]
    table = spark.createDataFrame([(*r, 1, 1, 1, "x") for r in data], DOCS)
    assert sorted(map(tuple, merkle.manifest(table).collect()), key=str) == plain_manifest(data)
    # One row, and every id that is tampered with at the largest count.
    for one in ([(9, "s", "en", 1, "x")], [(i, "s", None, (1 << 63) - 1, "x") for i in range(20)]):
        got = merkle.manifest(spark.createDataFrame([(*r, 1, 1, 1, "x") for r in one], DOCS))
        assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(one)
    assert merkle.manifest(table.limit(0)).count() == 0
