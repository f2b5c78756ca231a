"""Building the index, and keeping it equal to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek import schemas
from tomeseek.functions.text import doc_hash
from tomeseek.operators.passages import SIZE, STEP
from tomeseek.session import written
from tomeseek.sources.index import Index, bucket_count, create_index, empty_batches, merge_batches, of_documents, write_batch


def build_index(docs: DataFrame, path: str, n_buckets: int | None = None, size: int = SIZE, step: int = STEP) -> Index:
    """An index of ``docs`` in the new folder ``path``."""
    schemas.require(docs, schemas.DOCUMENTS, "documents")
    index = create_index(docs.sparkSession, path, n_buckets or bucket_count(docs), size, step)
    return write_batch(index, docs, 0)


def index_delta(old_state: DataFrame, new_docs: DataFrame, removed: bool = True) -> DataFrame:
    """doc_id and change: added, changed or removed. Unchanged documents give no row.

    A change is one of text, lang or source. ``old_state`` has doc_id and
    doc_hash, or documents' columns. Only the hashes are shuffled, never the
    texts. With ``removed=False`` the old documents that are no longer there
    are not asked for, and only those of ``new_docs`` are joined.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        value = F.col("doc_hash") if "doc_hash" in df.columns else doc_hash()
        return df.select("doc_id", value.alias(name))

    both = hashed(old_state, "old").join(hashed(new_docs, "new"), "doc_id", "full_outer" if removed else "right")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return both.select("doc_id", change.alias("change")).where(F.col("change").isNotNull())


def refresh_index(index: Index, new_docs: DataFrame, remove_missing: bool = True, origin: str | None = None) -> Index:
    """The index brought up to ``new_docs``: only documents that differ are cut and indexed.

    With ``remove_missing=False`` documents absent from ``new_docs`` stay.
    ``origin`` names where the documents came from, for ``has_batch_of``.
    """
    state = index.doc_state()
    if not remove_missing:
        # Only the documents that came are asked for: a small micro-batch does not read the whole state.
        state = of_documents(state, new_docs.select("doc_id"))
    delta = written(index_delta(state, new_docs, removed=remove_missing), "delta")
    if delta.isEmpty():
        return index
    fresh = new_docs.join(delta.where(F.col("change") != "removed"), "doc_id", "left_semi")
    retired = delta.where(F.col("change") != "added").select("doc_id")
    return write_batch(index, fresh, index.last_batch + 1, retired, origin)


def compact_index(index: Index, drop_old: bool = False) -> Index:
    """The index with all its batches merged into one, as a new snapshot.

    Rows of replaced and removed documents are left behind, counts of terms are
    added up, and files are one a bucket again. Searches that hold an earlier
    snapshot go on undisturbed, and a run that is cut off leaves the index as it
    was. An index of one batch is returned as it is. With ``drop_old`` the merged batches are then emptied,
    which ends earlier snapshots.
    """
    if index.last_batch > index.base:
        index = merge_batches(index)
    if drop_old:
        empty_batches(index)
    return index
