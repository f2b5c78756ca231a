"""The pipeline's rows against its five stages in plain Python."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import FOLDER
from test_near_dups import groups
from test_text_operators import plain_leaks
from tomeseek.llm import copies, quality, queries
from tomeseek.llm.common import table


def test_pipeline_equals_plain_stages(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    # Quality: the fitted dictionaries and curve, text by text.
    model = quality.fit_quality(docs, table(spark, FOLDER, "labels"))
    sizes, (bias, slope, own) = quality._Sizes(model), model.curve
    score = {i: 1 / (1 + math.exp(-(bias + slope * x[0] + own * x[1]))) for i, r in rows.items() for x in [sizes(r.text)]}
    left = {i: rows[i] for i, s in score.items() if s >= 0.7}
    assert 0.5 * len(rows) < len(left) < len(rows)
    # Near copies: all pairs of texts.
    sets = {i: copies.elements(r.text, 5) for i, r in left.items()}
    left = {i: left[i] for i, root in groups(sets, lambda a, b: copies.similarity(sets[a], sets[b]) >= 0.8).items() if i == root}
    assert len(left) < len(sets)
    # Benchmark passages: all windows.
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    found = {leak[0] for leak in plain_leaks([(i, r.text) for i, r in left.items()], items)}
    left = {i: r for i, r in left.items() if i not in found}
    assert found
    # Mixing: its SQL over what is left.
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in left.values()]))
    taken = dict(con.sql(f"SELECT doc_id, copies FROM ({queries.ORACLES['op7_mixing']})").fetchall())
    assert 0 < len(taken) < len(left)
    # Token files: the library, one document after another.
    library, start, want = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY)), 0, []
    for i in sorted(taken):
        ids = [*library.encode(left[i].text or "", add_special_tokens=False).ids, 1]
        for _ in range(taken[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted(want)
