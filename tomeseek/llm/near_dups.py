"""Near copies of documents by SimHash, found through tables of distances to pivots.

A fingerprint's Hamming distances to reference fingerprints (pivots) bound its
distance to any other one from below: two fingerprints differ by at least the
largest difference of their distances to one pivot. The pivots are one fixed
fingerprint and its variants with whole blocks of bits flipped. Distances to 17 of
them fix those to all 65,536, and the largest difference over all of these is the
sum over blocks of the difference in block distance. So a pair is discarded unless
the two rows of block distances are at most RADIUS apart in that sum. A second
table, with blocks of bits that lie apart, is made of what the first one leaves.

Neither pairs of rows nor pairs of fingerprints are listed. Each row stands in its
own cell and in those one step away; two rows are within two steps just when they
share a cell. A cell with a single fingerprint is discarded, and a fingerprint that
stands only in such cells. The others are verified: two fingerprints within two
bits share one of their 65 variants of at most one bit, and at most 65 fingerprints
share one, each of which is linked to the smallest. That keeps all groups exact,
with bounded work for any variant however many copies a text has.

Two bits are far less than what near copies differ by: texts of five-word Jaccard
similarity 0.8 are some nine bits apart, which no table of pivots tells from chance.
Where a similarity is asked, texts that the tables find meet first, the others as ``copies``
has it, and each link is a pair of texts whose shingles were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.llm.common import free_name, text_hash
from tomeseek.llm.components import components
from tomeseek.llm.copies import shingle_hashes, simhash, similar_links
from tomeseek.session import written

#: Bits by which linked fingerprints differ at most. The cells and variants are those of two steps.
RADIUS = 2
WORDS = 3
#: Shingle and least similarity of copies if nothing else is asked.
COPY_WORDS, SIMILARITY = 5, 0.8
BLOCKS, BITS = 16, 4
PIVOT = 0x5BD1E995_9E3779B9
#: The bits of each block, for either table of pivots: neighbours, and every sixteenth.
TABLES = (
    tuple(((1 << BITS) - 1) << (BITS * b) for b in range(BLOCKS)),
    tuple(sum(1 << (b + BLOCKS * i) for i in range(BITS)) for b in range(BLOCKS)),
)


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles, as a signed 64-bit number; 0 where there is no word."""
    return simhash(shingle_hashes(text, words))


def fingerprint(text: Column | str, words: int = WORDS) -> Column:
    """SimHash (bigint) of whole texts; NULL counts as a text without words."""

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, words) for t in batch], dtype="int64")

    return of(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: Column, pivot: int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(pivot))))


def pivot_cell(fp: Column, blocks: tuple[int, ...]) -> Column:
    """The row of block distances (0 to 4 each), four bits a block."""
    to_first = _differ(fp, PIVOT)
    cell = F.lit(0).cast("bigint")
    for b, block in enumerate(blocks):
        to_variant = _differ(fp, PIVOT ^ block)
        inside = ((to_first - to_variant + F.lit(BITS)) / 2).cast("bigint")
        cell = cell.bitwiseOR(F.shiftleft(inside, 4 * b))
    return cell


def _cells(cell: Column) -> Column:
    """The cell and those one step away in one block."""
    out = [cell]
    for b in range(BLOCKS):
        inside = F.shiftright(cell, 4 * b).bitwiseAND(F.lit(15))
        step = F.lit(_signed(1 << (4 * b)))
        out += [F.when(inside < BITS, cell + step), F.when(inside > 0, cell - step)]
    return F.array_compact(F.array(*out))


def not_alone(fps: DataFrame, blocks: tuple[int, ...]) -> DataFrame:
    """The fingerprints whose row of distances is at most RADIUS from another one's."""
    table = written(fps.select("fp", pivot_cell(F.col("fp"), blocks).alias("own")), "pivots")
    placed = table.select("fp", F.explode(_cells(F.col("own"))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("cell")
    return placed.join(shared, "cell", "left_semi").select("fp").distinct()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """a, b: links that join all of ``fps`` (fp, distinct) within RADIUS bits, each to the smallest around a shared variant."""
    left = fps
    for blocks in TABLES:
        left = not_alone(left, blocks)
    variants = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)))
    around = Window.partitionBy("variant")
    met = left.select("fp", F.explode(variants).alias("variant")).select(F.col("fp").alias("b"), F.min("fp").over(around).alias("a"))
    return met.where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", *, words: int = COPY_WORDS, similarity: float | None = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp) and classes (fp, root, component_id).

    Texts are linked whose shingles of ``words`` words have at least the given
    weighted Jaccard similarity; fp is the text's hash then. If it is None, texts
    are linked whose fingerprints (fp) are within RADIUS bits.

    ``root`` names a group of linked ones, ``component_id`` is the smallest
    doc_id of its rows (NULL if they have none). Texts without a word are alike
    (fingerprint 0). Repeated rows and NULL ids are rows like others. Exact copies
    share an fp and are grouped before anything is compared.
    """
    fp = fingerprint(text, words) if similarity is None else text_hash(text)
    rows = written(docs.select("doc_id", text_hash(text).alias("text_hash"), fp.alias("fp")), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(fingerprint_links(own.select("fp"))) if similarity is None else similar_links(docs, text, words, similarity, fingerprint_links)
    rooted = own.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, rooted.join(firsts, "root").select("fp", "root", "component_id")


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", *, words: int = COPY_WORDS, similarity: float | None = SIMILARITY
) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``: that of the smallest doc_id (NULL last).

    ``words`` and ``similarity`` are those of ``near_duplicates``. Of rows equal in doc_id and text one stays.
    """
    rows, classes = near_duplicates(docs, text, words=words, similarity=similarity)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = rows.join(classes, "fp").groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    mark = free_name(docs, "text_hash")
    marked = docs.withColumn(mark, text_hash(text))
    same = marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_hash"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)
