"""Token counts by rank-synchronous merging of ragged arrays.

A byte-pair vocabulary file of the ``tokenizers`` library is read as data; no
text goes through that library here. Texts are normalised and cut to pre-tokens
as the file says, the pre-tokens of a batch are laid end to end in one numpy
array, and in each round every sequence merges the pair of lowest rank that it
holds, at all its places at once. What is left of a sequence is its token count.

Merging all places of a pair at once equals merging them one by one as long as a
merge only makes pairs of a higher rank; ``load_vocabulary`` checks that.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.llm.common import free_name

#: Pre-tokens whose count a task remembers; the store is emptied when full.
REMEMBERED = 400_000
#: Pre-tokens merged together.
AT_ONCE = 50_000
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    pattern: str
    specials: dict[str, int]  # special strings and their ids
    inner: np.ndarray  # symbol of each byte
    final: np.ndarray  # symbol of each byte at the end of a pre-token
    keys: np.ndarray  # left * size + right, ascending
    ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # symbol made by the merge of each rank
    size: int


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else free))
        free += byte not in plain
    return letters


def load_vocabulary(path: str) -> Vocabulary:
    """Read a vocabulary file; raises ValueError for a kind that is not byte-level BPE with word ends in lower case."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split, letters = spec["pre_tokenizer"]["pretokenizers"]
    end = model.get("end_of_word_suffix")
    if (model["type"], steps, split["behavior"], split["invert"], letters["type"], letters["use_regex"], letters["add_prefix_space"]) != (
        "BPE", ["NFC", "Replace", "Lowercase"], "Removed", True, "ByteLevel", False, False,
    ) or not end or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a vocabulary of the supported kind")
    ids = model["vocab"]
    left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in model["merges"])))
    size = max(ids.values()) + 1
    born = np.full(size, -1, np.int64)
    ranks = np.arange(len(made))
    np.maximum.at(born, made, ranks)
    if (np.maximum(born[left], born[right]) >= ranks).any():
        raise ValueError(f"{path}: a merge comes before one that makes its parts")
    keys = left * size + right
    order = np.argsort(keys)
    return Vocabulary(
        split["pattern"]["Regex"], {x["content"]: x["id"] for x in spec["added_tokens"]},
        np.array([ids[x] for x in byte_letters()], np.int64), np.array([ids[x + end] for x in byte_letters()], np.int64),
        keys[order], ranks[order].astype(np.int32), made, size,
    )


class Cutter:
    """Cuts a text to special strings and pre-tokens."""

    def __init__(self, pattern: str, specials: tuple[str, ...]) -> None:
        self.pieces = regex.compile(pattern)
        # The common case by the faster library: the same classes, spelled out for letters up to ÿ.
        letters = "a-zß-öø-ÿ"
        spelled = pattern.replace("\\p{L}", letters).replace("\\p{N}", "0-9").replace("\\s", " \t-\r")
        self.common = re.compile(spelled)
        self.uncommon = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def plain(self, text: str) -> list[str]:
        if not self.uncommon.search(text):
            return self.common.findall(text.lower())
        # Letter by letter: a final capital sigma becomes the plain small one.
        return self.pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return self.plain(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.plain(part)], len(parts) - 1


def symbol_counts(words: list[str], v: Vocabulary) -> np.ndarray:
    """How many symbols are left of each word after all merges. No word may be empty."""
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    symbols, ends = v.inner[data], np.cumsum(lengths) - 1
    symbols[ends] = v.final[data[ends]]
    counts, which = lengths.copy(), np.arange(len(raw))
    while symbols.size:
        starts = np.cumsum(lengths) - lengths
        rank = np.full(symbols.size, NONE, np.int32)
        pair = symbols[:-1] * v.size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, pair), v.keys.size - 1)
        rank[:-1] = np.where(v.keys[at] == pair, v.ranks[at], NONE)
        rank[starts + lengths - 1] = NONE
        lowest = np.minimum.reduceat(rank, starts)
        hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != NONE))
        if hit.size:
            # Of overlapping places (as in "aaa") every second one, from the left.
            opens = np.r_[True, np.diff(hit) != 1]
            run = hit[np.maximum.accumulate(np.where(opens, np.arange(hit.size), 0))]
            hit = hit[(hit - run) % 2 == 0]
            symbols[hit] = v.merged[rank[hit]]
        keep = np.ones(symbols.size, bool)
        keep[hit + 1] = False
        alive = lowest != NONE
        counts[which[~alive]] = lengths[~alive]
        left = np.add.reduceat(keep.astype(np.int64), starts)
        symbols = symbols[keep & np.repeat(alive, lengths)]
        lengths, which = left[alive], which[alive]
    return counts


class Counter:
    """Token counts of texts, remembering pre-tokens between batches."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.cut, self.known = v, Cutter(v.pattern, tuple(v.specials)), {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.cut(t or "") for t in texts]
        new = list(dict.fromkeys(w for words, _ in cut for w in words if w not in self.known))
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            self.known.update(zip(part, symbol_counts(part, self.v).tolist()))
        return [sum(map(self.known.__getitem__, words)) + specials for words, specials in cut]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Every row gets its figures from its whole text; NULL counts as the empty text
    and has none. Repeated rows stay repeated. Where ``docs`` already has a column
    of such a name, the new one takes underscores before it. The vocabulary is
    read on the driver, so executors need no file.
    """
    v = load_vocabulary(vocabulary)

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(v)
        for batch in texts:
            values = batch.tolist()
            yield pd.Series([n for i in range(0, len(values), 500) for n in counter(values[i : i + 500])], dtype="int64")

    bytes_, tokens, over = (free_name(docs, x) for x in ("n_bytes", "n_tokens", "over_limit"))
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumns({bytes_: F.octet_length(whole).cast("bigint"), tokens: count(whole)})
        .withColumn(over, F.col(tokens) > limit)
    )
