"""Token counts and token files against the tokenizers library on whole texts."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import FOLDER
from tomeseek.llm import queries, token_files, tokens
from tomeseek.session import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", None, "don't we'll 'S ''t x'd", "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΟΔΥΣΣΕΥΣ. Σ", "İstanbul ÇA É é ẛ̣",
    "a\x1cb\x1fc\u0085d e f　g​h", "ab" * 3000 + " " + "a" * 5001, "aaa aaaa aaaaa", "1234 ٣٤ ½ ²", "日本語テキスト 漢字 😀👍🏽 café naïve", "x\ty\nz\r\n", "l'été ''ll", "¨ ̈ ä",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(n: int) -> list[str]:
    draw = random.Random(5)
    letters = "abcdeéßΣσİıſ'’st ll ve\n\t0123½٣😀漢字ǅŉ́̈ẛ#%&-_<|>"
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x370, 0x400), (0x400, 0x480), (0x5D0, 0x5F0), (0x900, 0x97F), (0x1E00, 0x2000), (0x3040, 0x30FF), (0x1F600, 0x1F640)]
    one = lambda: draw.choice(letters) if draw.random() < 0.6 else chr(draw.randint(*draw.choice(ranges)))
    return ["".join(one() for _ in range(draw.randint(1, 60))) for _ in range(n)]


def test_counts_equal_the_library(library):
    texts = HARD + noise(3000)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokens.Counter(tokens.load_vocabulary(PATH))(texts) == want


def test_parts_equal_whole_texts(library):
    texts = HARD + noise(3000)
    v = tokens.load_vocabulary(PATH)
    with open(PATH) as file:
        encode = token_files.Encoder(file.read(), v.pattern, v.specials, "<u2")
    for text in texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_other_kinds_are_refused(tmp_path):
    with open(PATH) as file:
        spec = json.load(file)
    spec["model"]["merges"].insert(0, ["the", "se</w>"])
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(spec))
    with pytest.raises((ValueError, KeyError)):
        tokens.load_vocabulary(str(bad))
    with pytest.raises((ValueError, KeyError, TypeError)):
        tokens.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_counts(spark, library):
    got = queries.op9_token_counts(spark, FOLDER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_counts_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 4), (2, "the cat", 5)], "doc_id bigint, text string, N_TOKENS int")
    got = tokens.token_counts(odd, PATH)
    assert got.columns == ["doc_id", "text", "N_TOKENS", "n_bytes", "_n_tokens", "over_limit"]
    assert sorted((r.n_bytes, r._n_tokens) for r in got.collect()) == [(0, 0), (0, 0), (0, 0), (7, 2)]
    assert tokens.token_counts(odd.limit(0), PATH).count() == 0


def brute(library, rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_files(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op10_token_files(spark, FOLDER).collect())) == brute(library, docs)


def test_files_of_odd_tables(spark, library):
    rows = [(3, "b " * 900), (1, None), (2, "same"), (2, "same"), (None, "none"), (7, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, start int").repartition(3)
    folder = new_folder(spark, "test-tokens")
    files = token_files.write_token_files(docs, folder, PATH, length=32, rows_per_batch=4)
    got = sorted((tuple(r) for r in token_files.read_documents(spark, files).collect()), key=lambda r: r[1])
    assert got == brute(library, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert token_files.open_token_files(spark, folder, 32) == files
    empty = token_files.write_token_files(docs.limit(0), new_folder(spark, "test-tokens"), PATH)
    assert token_files.read_documents(spark, empty).count() == 0


def test_random_access(spark, library):
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(50)], "doc_id bigint, text string")
    folder = new_folder(spark, "test-tokens")
    files = token_files.write_token_files(docs.coalesce(1), folder, PATH, length=32, rows_per_batch=4)
    stream = [x for i in range(50) for x in (*library.encode(f"text number {i} " * 9, add_special_tokens=False).ids, 1)]
    got = []
    for shard in files.starts:
        reader = token_files.open_shard(folder, shard)
        n = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        for i in range(n):
            ids, mask = token_files.sequence(reader, i)
            assert len(ids) == 32 and not ids.flags.owndata
            got += [int(x) for x, m in zip(ids, mask.to_pylist()) if m]
    assert got == stream
