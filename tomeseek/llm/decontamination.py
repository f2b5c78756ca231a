"""Benchmark passages in documents, by SimHash of item-sized windows.

For each benchmark item of n words, every window of n words of a document is a
candidate. Windows that have no five-word shingle of an item of their length have
similarity 0 with all of them and are passed over. The others get a fingerprint of
128 bits. Each of its eight 16-bit blocks has a table: for each value the items whose
block is at most three bits from it. Looking up a window's blocks finds every item within 31
bits (32 would need four in each block). Fingerprints of similarity 0.8 are some 18 bits apart. What is found is then compared exactly:
the weighted Jaccard similarity of the shingles, each weighing as often as it occurs.

An item of fewer than five words has one shingle, all its words: it is looked for word for word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeseek.llm.common import kept
from tomeseek.session import written

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Bytes of benchmark text that are sent to the tasks at a time; a larger benchmark is taken in parts.
#: An item's places in the tables take 22 KB.
PART = 1 << 20
#: Words whose hash a task remembers; the store is emptied when full.
REMEMBERED = 300_000

LEAK = "array<struct<item_id:bigint,start:bigint,n_words:bigint,similarity:double>>"
_WORD = re.compile(r"[^\W_]+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE, 0, -1)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return made


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: _Hashes) -> tuple[int, np.ndarray]:
    """Number of words (letters and digits, in lower case) and the hash of each five of them in a row."""
    words = _WORD.findall((text or "").lower())
    if len(words) < SHINGLE:
        return len(words), np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out += hashes[k : k + len(out)] * _POWERS[k]
    return len(words), out


def fingerprints(hashes: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Blocks (starts x 8, 16 bits each) of the windows of ``width`` shingles at ``starts``: a bit is 1 if over half the shingles have it."""
    low, high = int(starts.min()), int(starts.max()) + width
    bits = np.concatenate([
        np.unpackbits(_mix(hashes[low:high], seed).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)], axis=1)
    sums = np.zeros((len(bits) + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts - low + width] - sums[starts - low]
    return np.packbits(2 * ones > width, axis=1, bitorder="little").view("<u2")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the smaller count of each shingle over the larger one, summed."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


_MASKS = np.array([sum(1 << b for b in c) for k in range(FLIPS + 1) for c in combinations(range(16), k)], np.uint16)


class BlockTables:
    """For each block and each value it can have: the items whose block is within FLIPS bits of it."""

    def __init__(self, prints: np.ndarray) -> None:
        self.begin, self.items = [], []
        for b in range(BLOCKS):
            near = (prints[:, b, None] ^ _MASKS).ravel()
            order = np.argsort(near, kind="stable")
            self.items.append((order // len(_MASKS)).astype(np.int32))
            self.begin.append(np.searchsorted(near[order], np.arange((1 << 16) + 1)).astype(np.int64))

    def look_up(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items, each pair once, of all that agree in some block to within FLIPS bits."""
        found = []
        for b in range(BLOCKS):
            value = prints[:, b].astype(np.int64)
            first, held = self.begin[b][value], self.begin[b][value + 1] - self.begin[b][value]
            windows = np.repeat(np.arange(len(prints)), held)
            places = np.arange(len(windows)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
            found.append((windows << 32) | self.items[b][places])
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, pairs & 0xFFFFFFFF


class ItemIndex:
    """Items by shingle (which lengths have it) and by fingerprint; those of fewer than five words by all their words."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.items = []
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        lengths: dict[int, set[int]] = defaultdict(set)
        prints, known = [], _Hashes()
        for item_id, text in items:
            n, hashes = shingles(text, known)
            if 0 < n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(tuple(_WORD.findall(text.lower())), []).append(item_id)
            if len(hashes):
                self.items.append((item_id, n, Counter(hashes.tolist())))
                prints.append(fingerprints(hashes, len(hashes), np.zeros(1, np.int64))[0])
                for x in set(hashes.tolist()):
                    lengths[x].add(n)
        self.shingles = np.array(sorted(lengths), np.uint64)
        self.lengths = [sorted(lengths[x]) for x in sorted(lengths)]
        self.prints = np.array(prints, np.uint16).reshape(-1, BLOCKS)
        self.sizes = np.array([n for _, n, _ in self.items], np.int64)

    def near(self, prints: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(window, item) of all items of ``n`` words within RADIUS bits."""
        # Made once in each worker: the tables are larger than what they are made of.
        tables = kept(("leak tables", xxhash.xxh64_intdigest(self.prints.tobytes())), lambda: BlockTables(self.prints))
        windows, items = tables.look_up(prints)
        own = self.sizes[items] == n
        windows, items = windows[own], items[own]
        fits = np.bitwise_count(prints[windows] ^ self.prints[items]).sum(1, dtype=np.int64) <= RADIUS
        yield from zip(windows[fits].tolist(), items[fits].tolist())

    def word_for_word(self, text: str) -> Iterator[tuple[int, int, int]]:
        """item_id, first word and words of the short items that the text has, each at its first place."""
        words = _WORD.findall(text.lower())
        for n, items in self.short.items():
            seen = set()
            for at in range(len(words) - n + 1):
                one = tuple(words[at : at + n])
                if one in items and one not in seen:
                    seen.add(one)
                    yield from ((item_id, at, n) for item_id in items[one])

    def leaks(self, text: str | None, known: _Hashes) -> list[tuple[int, int, int, float]]:
        """item_id, first word, words and similarity of each item's best window, the earliest of equals; by item_id."""
        best: dict[int, tuple[float, int, int]] = {}
        if self.short and text:
            best |= {item_id: (1.0, at, n) for item_id, at, n in self.word_for_word(text)}
        words, hashes = shingles(text, known) if len(self.shingles) else (0, self.shingles)
        windows: dict[int, set[int]] = defaultdict(set)
        if len(hashes):
            at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
            for p in np.flatnonzero(self.shingles[at] == hashes).tolist():
                for n in self.lengths[at[p]]:
                    width = min(n - SHINGLE + 1, len(hashes))  # a text shorter than the item is one window
                    windows[n].update(range(max(0, p - width + 1), min(p, len(hashes) - width) + 1))
        for n, starts in windows.items():
            width, begin = min(n - SHINGLE + 1, len(hashes)), np.array(sorted(starts), np.int64)
            # Windows that overlap are counted up together; a gap starts anew, however far apart its sides lie.
            for run in np.split(begin, np.flatnonzero(np.diff(begin) > width) + 1):
                for k in range(0, len(run), 256):
                    part = run[k : k + 256]
                    for w, i in self.near(fingerprints(hashes, width, part), n):
                        item_id, _, counts = self.items[i]
                        like = similarity(Counter(hashes[part[w] : part[w] + width].tolist()), counts)
                        if like >= SIMILARITY and (item_id not in best or (-like, int(part[w])) < (-best[item_id][0], best[item_id][1])):
                            best[item_id] = (like, int(part[w]), min(n, words))
        return [(i, start, n, like) for i, (like, start, n) in sorted(best.items())]


def _found(index: ItemIndex, text: Column) -> Column:
    @F.pandas_udf(LEAK)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Hashes()
        names = ("item_id", "start", "n_words", "similarity")
        for batch in texts:
            out = []
            for value in batch:
                out.append([dict(zip(names, x)) for x in index.leaks(value, known)])
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.Series(out)

    return find(text)


def _parts(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of the benchmark's parts, each of about PART bytes of text."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART)
    for k in range(n):
        yield ItemIndex(sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, start, n_words, similarity for each row of ``docs`` and each item that it has a window of.

    ``start`` counts words. An item of fewer than five words is found where all its words
    stand in a row, one without a word nowhere; a text of fewer words than the item is one window. NULL texts and items,
    and items without an id, match nothing. Rows that repeat have their own rows. Of a very long text a task holds
    the hashes of its words and shingles, and the counts of one stretch of windows.
    """
    out = None
    for index in _parts(benchmark):
        found = docs.select("doc_id", F.explode(_found(index, F.col(text))).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = F.lit(None)
        return docs.select("doc_id", none.cast("bigint").alias("item_id"), none.cast("bigint").alias("start"), none.cast("bigint").alias("n_words"), none.cast("double").alias("similarity")).limit(0)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, as ``find_leaks`` has them."""
    first = True
    for index in _parts(benchmark):
        docs = (docs if first else written(docs, "clean")).where(F.size(_found(index, F.col(text))) == 0)
        first = False
    return docs
