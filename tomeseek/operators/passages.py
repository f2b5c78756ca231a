"""Documents cut into overlapping passages, and the postings of each passage.

Both work within one row, so neither needs a shuffle. Postings are made in
numpy, for some thousand passages at a time.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeseek.functions import dense
from tomeseek.functions.text import let, words
from tomeseek.schemas import POSTINGS

# The code of the tasks travels with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(dense)

SIZE = 128
STEP = 96


def passages(docs: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """Windows of ``size`` words, one every ``step`` words, until the whole text is covered.

    Word p of a document is word ``p - chunk * step`` of a passage ``chunk``. A
    passage *owns* its first ``own`` words: those before the next passage
    starts, and all of them in the last passage. Each word has one owner.
    """
    def windows(tokens: Column) -> Column:
        last_start = F.greatest(F.size(tokens) - 1 - (size - step), F.lit(0))
        starts = F.sequence(F.lit(0), last_start, F.lit(step))
        cut = F.transform(starts, lambda start: F.struct(
            F.slice(tokens, start + 1, F.lit(size)).alias("tokens"),
            (start + size >= F.size(tokens)).alias("last"),
        ))
        nothing = F.array().cast("array<struct<tokens:array<string>,last:boolean>>")
        return F.when(F.size(tokens) > 0, cut).otherwise(nothing)

    # One select: an explode of a named column makes Spark add a filter on the
    # column's size, which runs the tokeniser a second time.
    cut = docs.select(
        "doc_id", F.posexplode(let(words(F.col("text")), windows)).alias("chunk", "window"), "lang", "source"
    )
    return cut.select(
        "doc_id", "chunk", F.col("window.tokens").alias("tokens"), F.size("window.tokens").alias("n_tokens"),
        F.when(F.col("window.last"), F.size("window.tokens")).otherwise(F.lit(step)).alias("own"), "lang", "source",
    )


def postings(cut: DataFrame, step: int = STEP) -> DataFrame:
    """One row for each distinct term of a passage, with its ascending positions in the document.

    The passage owns the first ``own_tf`` of them, so a sum of ``own_tf`` over
    the passages of a document counts no word twice.
    """
    rows = cut.select("doc_id", "chunk", "tokens", "own", "lang", "source")
    return rows.mapInArrow(lambda batches: dense.postings_of(batches, step), POSTINGS)
