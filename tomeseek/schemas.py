"""Table schemas, and the check made where a table comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
BENCHMARK = "item_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"

PASSAGES = (
    "doc_id bigint, chunk int, tokens array<string>, n_tokens int, own int, lang string, source string"
)
POSTINGS = (
    "doc_id bigint, chunk int, term string, tf int, own_tf int, positions array<int>, "
    "len int, lang string, source string"
)
DOC_STATE = "doc_id bigint, doc_hash string"
RETIRED = "doc_id bigint"
TERM_STATS = "term string, df bigint, doc_df bigint"
CORPUS_STATS = "n bigint, total_len bigint, n_docs bigint, origin string, base int"


def require(df: DataFrame, ddl: str, name: str) -> DataFrame:
    """``df`` itself if it has every column of ``ddl`` with that type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    for field in StructType.fromDDL(ddl):
        want = field.dataType.simpleString()
        if have.get(field.name) != want:
            raise ValueError(f"{name}: column {field.name} should be {want}, is {have.get(field.name)}")
    return df
