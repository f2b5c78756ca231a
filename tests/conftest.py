from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tomeseek.operators.indexing import build_index  # noqa: E402
from tomeseek.session import new_folder, session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from {doc_id: text}."""
    def make(texts: dict[int, str], lang: str = "en"):
        rows = [(i, t, lang if i % 2 == 0 else "xx", "s", len(t)) for i, t in texts.items()]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return make


@pytest.fixture(scope="session")
def make_index(spark, make_docs):
    def make(texts: dict[int, str], **options):
        return build_index(make_docs(texts), new_folder(spark, "test-index"), n_buckets=3, **options)
    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    def make(texts: dict[int, str]):
        return spark.createDataFrame(list(texts.items()), "query_id bigint, text string")
    return make
