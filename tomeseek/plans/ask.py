"""From conversations to the context of each answer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tomeseek.operators.context import assemble_context, conversation_queries
from tomeseek.operators.search import bm25_search
from tomeseek.session import written
from tomeseek.sources.index import Index


def answer_context(turns: DataFrame, index: Index, k: int = 10, budget: int = 400, history: int = 3) -> DataFrame:
    """One context row for each user turn: its question, searched, and the best passages.

    Queries and hits are written in between: both are used more than once.
    """
    queries = written(conversation_queries(turns, history), "queries")
    hits = written(bm25_search(queries, index, k), "hits")
    return assemble_context(queries, hits, index.passages(), budget, index.size, index.step)
