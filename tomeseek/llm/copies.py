"""Texts of a given weighted Jaccard similarity of their word shingles, grouped.

Each distinct text has a sketch: the SimHash of its shingles, and minimum hashes of them, in bands.
Texts meet first whose fingerprints are found near by the tables of pivots (``near_dups``). Fingerprints
within that few bits are only part of the near copies, so texts that share a band meet too, but not each with each other: in every band all are compared with one
of them, the one that shares most bands with others, as the text that copies were made from does.
Those that are not like it are compared with the next such one, as long as most are alike.

What is left are crowds whose members are partly alike at most, where such rounds would
come to all pairs. There only texts meet that share a rare shingle: with the shingles
of a text in order of how few texts have them, two texts of similarity t share one
among so many first ones that less than t would be left. How many those are follows from both
lengths, so texts are joined by shingle and class of length. That join loses no pair.

Pairs whose sketches are far apart are passed over. All others are compared exactly,
text by text in the order in which a shuffle delivers them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeseek.llm.common import text_hash
from tomeseek.llm.components import components
from tomeseek.session import written

SEED = 42
#: Bands of so many minimum hashes: texts of similarity 0.8 share one of them with probability 0.9996.
BANDS, ROWS = 20, 5
#: How far below the asked similarity the sketches' estimate may be: five of its standard deviations.
DOUBT = 0.2
#: A round of comparisons is followed by another if at least this part of its pairs was alike.
FAIR = 0.5
#: Pairs of one text that a task compares.
CROWD = 1000
#: Classes of length for each step by the similarity.
CLASSES = 4
#: Shingles whose bits are counted at a time.
STRETCH = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hash of each ``words`` words in a row; of all words where there are fewer."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number; 0 where there is none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STRETCH):
        part = hashes[i : i + STRETCH].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def elements(text: str | None, words: int) -> np.ndarray:
    """The shingles' hashes, sorted, each repetition with one of its own: as a set, they have the weighted Jaccard similarity."""
    return elements_of(shingle_hashes(text, words))


def elements_of(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    first = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
    at = np.arange(len(hashes))
    repeat = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(hashes + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_MINS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def minima(own: np.ndarray) -> np.ndarray:
    """The smallest of each of the mixed hashes of ``elements``."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(own), 1 << 12):
        mixed = (own[i : i + (1 << 12), None] ^ _MINS[0]) * (_MINS[1] | np.uint64(1))
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(0))
    return least


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(least: np.ndarray) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), b)) for b, x in enumerate(least.reshape(BANDS, ROWS))]


def bands_of(text: str | None, words: int) -> list[int]:
    """A hash of each band; texts without a word have all in common."""
    return _bands(minima(elements(text, words)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' ``elements``; 1 where neither has any."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _sketch(text: Column, words: int) -> Column:
    """n (elements), fp (SimHash), bands, and marks: a byte of each minimum."""
    @F.pandas_udf("n int, fp bigint, bands array<bigint>, marks binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for text in batch:
                hashes = shingle_hashes(text, words)
                least = minima(elements_of(hashes))
                out.append((len(hashes), simhash(hashes), _bands(least), least.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["n", "fp", "bands", "marks"])

    return of(text)


def _may_be_alike(x: Column, y: Column, least: float) -> Column:
    """Whether the part of equal marks allows for the similarity."""
    need = (BANDS * ROWS) * (max(0.0, least - DOUBT))

    @F.pandas_udf("boolean")
    def of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            marks = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), BANDS * ROWS) for s in (a, b))
            yield pd.Series((next(marks) == next(marks)).sum(1) >= need)

    return of(x, y)


class Texts:
    """Distinct texts by hash: sketches are written, the texts are read again where they are compared."""

    def __init__(self, docs: DataFrame, text: str, words: int, least: float) -> None:
        self.words, self.least = words, least
        self.rows = docs.select(text_hash(text).alias("node"), F.col(text).alias("text"))
        made = written(self.rows.select("node", _sketch(F.col("text"), words).alias("s")).select("node", "s.*"), "sketches")
        self.sketches = written(made.dropDuplicates(["node"]), "text-sketches")

    def of(self, nodes: DataFrame) -> DataFrame:
        """node, text, once for each of ``nodes``."""
        return self.rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are alike."""
        x, y = (self.sketches.select(F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("marks").alias(f"marks_{p}")) for p in "ab")
        near = pairs.distinct().join(x, "a").join(y, "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * self.least - 1e-6)
        near = written(near.where(_may_be_alike(F.col("marks_a"), F.col("marks_b"), self.least)).select("a", "b"), "near-texts")
        texts = written(self.of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
        # Each text of a crowd comes once, after the one it is compared with; a large crowd is cut into several.
        crowds = near.groupBy("a").agg((F.ceil(F.count("*") / CROWD)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("b"), F.col("parts"))
        others = near.join(crowds, "a").select("a", part.cast("int").alias("part"), F.col("b").alias("node")).join(texts, "node").select("a", "part", F.col("node").alias("b"), "text")
        firsts = crowds.join(texts.withColumnRenamed("node", "a"), "a").select(
            "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text")
        words, least = self.words, self.least

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                found: list[tuple[int, int]] = []
                for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    given = elements(text.as_py(), words)
                    if b is None:
                        own = given
                    elif similarity(own, given) >= least:
                        found.append((a, b))
                yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        delivered = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return written(delivered.mapInArrow(compare, "a bigint, b bigint"), "text-links")


def _limit(n: Column, other: Column, t: float) -> Column:
    """Among how many of the rarest of a text's ``n`` shingles one is shared with a text of ``other`` ones."""
    return n - F.ceil((n + other) * (t / (1 + t)) - 1e-9) + 1


def rare_pairs(texts: Texts, odd: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: pairs of a text of ``odd`` (node) and one of ``roots`` (node, root) of another root that share a shingle among their rarest."""
    t, words = texts.least, texts.words

    def list_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = elements(text.as_py(), words).view(np.int64)
                for i in range(0, len(own), 1 << 16):
                    some = own[i : i + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(some), node, np.int64)), pa.array(some)], ["node", "element"])

    each = written(texts.of(roots.select("node")).select("node", "text").mapInArrow(list_elements, "node bigint, element bigint"), "elements")
    counts = each.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    counts = written(counts, "shared-elements")
    # An element that one text alone has comes first, meets nothing and needs no row: its places are those before the others.
    shared = each.join(counts, "element")
    sizes = texts.sketches.select("node", "n")
    order = Window.partitionBy("node").orderBy("df", "element")
    ranked = shared.withColumns({"place": F.row_number().over(order), "held": F.count("*").over(Window.partitionBy("node"))})
    ranked = ranked.join(sizes, "node").withColumn("rank", F.col("place") + F.col("n") - F.col("held")).select("node", "element", "n", "rank")
    step = math.log(1 / t) / CLASSES
    cls = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    smallest = lambda c: F.ceil(F.exp(c * step) - 1e-6)
    n, c = F.col("n"), F.col("other")
    # No class reaches further than this.
    ranked = ranked.where(F.col("rank") <= n - F.ceil(n * t - 1e-9) + 1).join(roots, "node")
    ranked = ranked.withColumn("own", cls(n))
    meets = lambda low, high, other: ranked.withColumn("other", F.explode(F.sequence(low, high))).where(F.col("rank") <= _limit(n, other, t))
    longer = meets(cls(F.greatest(n * t, F.lit(1))) - 1, F.col("own"), F.greatest(smallest(c), F.ceil(n * t - 1e-9)))
    shorter = meets(F.col("own"), cls(n / t) + 1, F.greatest(n, smallest(c)))
    is_odd = odd.select("node").distinct()
    longer, shorter = written(longer, "longer"), written(shorter, "shorter")
    name = lambda df, p: df.select("element", *(F.col(x).alias(f"{p}_{x}") for x in ("node", "root", "n", "rank", "own", "other")))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = name(x, "a"), name(y, "b")
        fits = (F.col("b_n") <= F.col("a_n")) & (F.col("b_n") >= F.col("a_n") * t - 1e-6) & (F.col("a_root") != F.col("b_root"))
        here = (F.col("a_rank") <= _limit(F.col("a_n"), F.col("b_n"), t)) & (F.col("b_rank") <= _limit(F.col("b_n"), F.col("a_n"), t))
        same = (a["element"] == b["element"]) & (a["a_other"] == b["b_own"]) & (a["a_own"] == b["b_other"])
        return a.join(b, same & fits & here).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))

    odd_longer, odd_shorter = (df.join(is_odd, "node", "left_semi") for df in (longer, shorter))
    return met(odd_longer, shorter).unionByName(met(longer, odd_shorter)).distinct()


def fingerprint_pairs(sketches: DataFrame, link_fingerprints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: texts (node, fp) of one fingerprint with the first of it, and the first ones of linked fingerprints."""
    firsts = written(sketches.groupBy("fp").agg(F.min("node").alias("first")), "text-fingerprints")
    same = sketches.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    x, y = (firsts.select(F.col("fp").alias(p), F.col("first").alias(f"first_{p}")) for p in "ab")
    linked = link_fingerprints(firsts.select("fp")).join(x, "a").join(y, "b")
    return same.unionByName(linked.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def similar_links(docs: DataFrame, text: str, words: int, least: float, link_fingerprints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of all texts (by text_hash) that are linked with another one.

    ``link_fingerprints`` gives links a, b of near ones among distinct fingerprints (fp).
    """
    texts = Texts(docs, text, words, least)
    links = texts.links(fingerprint_pairs(texts.sketches.select("node", "fp"), link_fingerprints))
    placed = texts.sketches.select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = written(placed.join(shared, "band"), "shared-bands")
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    members = written(members.drop("size").join(degrees, "node"), "members")
    active, first = members, None
    while True:
        pivots = active.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("p")).select("band", F.col("p.node").alias("a"))
        pivots = written(pivots, "band-pivots")
        first = pivots if first is None else first
        compared = written(active.join(pivots, "band").where("node <> a").select("band", "a", "node", "degree"), "compared-texts")
        pairs = written(compared.select("a", F.col("node").alias("b")).distinct(), "text-pairs")
        found = texts.links(pairs)
        asked, alike = pairs.count(), found.count()
        links = links.unionByName(found)
        if alike < FAIR * asked or alike == asked:
            break
        # Only texts that are not like their band's text go on.
        active = compared.join(found.withColumnRenamed("b", "node"), ["a", "node"], "left_anti").select("band", "node", "degree")
    roots = components(links)
    rooted = written(members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "rooted-texts")
    # Texts of another group than the first one chosen in one of their bands.
    of_first = first.select("band", F.col("a").alias("node")).join(rooted.select("node", "root").distinct(), "node").select("band", F.col("root").alias("first_root"))
    mixed = written(rooted.join(of_first, "band").withColumn("odd", F.col("root") != F.col("first_root")), "mixed-bands")
    odd = mixed.where("odd").select("node").distinct()
    if odd.isEmpty():
        return roots
    bands = mixed.where("odd").select("band").distinct()
    around = written(mixed.join(bands, "band", "left_semi").select("node", "root").distinct(), "texts-around")
    rest = written(rare_pairs(texts, odd, around), "other-texts")
    return roots if rest.isEmpty() else components(links.unionByName(texts.links(rest)))
