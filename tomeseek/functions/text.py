"""Column expressions for text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    An expression that is named twice, or within a lambda, is otherwise copied
    into each place: a tokeniser inside a lambda would run for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def doc_hash() -> Column:
    """Hash of all the index keeps of a document; NULL is told from the empty text."""
    return F.sha2(F.to_json(F.struct("text", "lang", "source")), 256)


def stable_id(text: Column) -> Column:
    """A bigint from the first 60 bits of the md5, the same in every run."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
