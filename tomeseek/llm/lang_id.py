"""Language of texts by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed
letter n-grams predicts whether the text's language has it; the language is that
whose codeword loses least against the predicted bits, each bit's loss weighted by
how well its classifier does on texts it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.llm.common import fold_of, free_name
from tomeseek.llm.samples import sample_pieces

#: Hashed n-gram features.
WIDTH = 4096
#: Bounds of what is fitted on: pieces of each language, and their bytes.
PIECES = 600
PIECE = 1024
#: Most pieces in all; many languages share them.
ALL_PIECES = 6_000
#: A lead over the second language below which the answer is ambiguous.
LEAD = 0.2
#: Letters hashed at a time.
STRETCH = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # WIDTH + 1 (bias) x bits
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords: all splits of the languages in two for up to seven, else 15 log2(n) random splits that differ."""
    if n <= 7:
        return np.array([[1 if not i or (split >> (i - 1)) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8).reshape(n, -1)
    draw, columns = np.random.default_rng(seed), {}
    bits = int(np.ceil(15 * np.log2(n)))
    while len(columns) < bits:
        column = draw.choice([1, -1], n)
        if abs(column.sum()) < n:
            columns.setdefault(tuple(column * column[0]))
    return np.array(list(columns), np.int8).T


def features(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the letters, words apart; square roots, of length 1. Zero if there is no letter."""
    counts = np.zeros(WIDTH)
    text = text.lower()
    for i in range(0, len(text), STRETCH):  # stretches overlap by two letters, so that each n-gram counts once
        begin = max(0, i - 2)
        letters = np.frombuffer(text[begin : i + STRETCH].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        # Other signs count as a space; case was folded.
        plain = ((letters >= 97) & (letters <= 122)) | ((letters >= 0xC0) & (letters != 0xD7) & (letters != 0xF7) & ((letters < 0x2000) | (letters > 0x206F)))
        letters = np.where(plain, letters, 32)
        skip = i - begin
        one = letters * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (letters[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
        three = (two[:-1] ^ (letters[2:] * np.uint64(0x27D4EB2F165667C5))) * np.uint64(0x9E3779B185EBCA87)
        blank = letters == 32
        for grams, dull, first in ((one, blank, skip), (two, blank[:-1] & blank[1:], max(0, skip - 1)), (three, blank[1:-1] & (blank[:-2] | blank[2:]), max(0, skip - 2))):
            keep = ~dull
            keep[:first] = False
            counts += np.bincount((grams[keep] >> np.uint64(40)).astype(np.int64) % WIDTH, minlength=WIDTH)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic classifiers of all bits at once, by accelerated gradient steps."""
    w = ahead = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for k in range(rounds):
        slope = x.T @ (y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))) / len(x) - 1e-5 * ahead
        new = ahead + 8 * slope
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def fit_language(docs: DataFrame) -> LanguageModel:
    """Fit on text and lang of the rows outside fold 2 (a NULL lang or id is left out).

    A sample by hash of at most PIECES pieces of PIECE bytes for each language out of
    all texts; a third of it measures the bits' trust. A language whose sample has no letter is not learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id") != 2))
    labels = known.select("doc_id", F.col("lang").alias("group"))
    n = known.select("lang").distinct().count()
    pieces = sample_pieces(known, labels, max(20, min(PIECES, ALL_PIECES // max(1, n))), PIECE)
    rows = [(lang, x) for lang in sorted(pieces) for p in pieces[lang] if (x := features(p.decode("utf-8", "ignore"))).any()]
    languages = tuple(sorted({lang for lang, _ in rows}))
    code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int8)
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((WIDTH + 1, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32))
    x = np.c_[np.array([x for _, x in rows]), np.full(len(rows), 0.1, np.float32)]
    place = {lang: i for i, lang in enumerate(languages)}
    y = code[[place[lang] for lang, _ in rows]].astype(np.float32)
    late = np.arange(len(rows)) % 3 == 2
    # Without a piece to measure on, all bits are trusted alike.
    right = ((x[late] @ _fit_bits(x[~late], y[~late])) * y[late] > 0).mean(0) if late.any() and not late.all() else np.full(y.shape[1], 0.75)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return LanguageModel(languages, code, _fit_bits(x, y), (trust / trust.sum()).astype(np.float32))


def decode(model: LanguageModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses of the languages for rows of features (rows x languages), and their shares by exp(-loss)."""
    margin = np.c_[x, np.full(len(x), 0.1, np.float32)] @ model.weights
    losses = np.logaddexp(0, -margin[:, None, :] * model.code[None]) @ model.trust
    share = np.exp(-3 * (losses - losses.min(1, keepdims=True)))
    return losses, share / share.sum(1, keepdims=True)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with a struct column language: lang_pred, score (0 to 1), ambiguous.

    A NULL text or one without a letter is ``und`` with score 0, and so is every text if
    no language was learned; with one language learned each text has it. Ties go to the first by name. Rows that repeat stay;
    a column of that name that is there already makes the new one ``_language``.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for value in batch:
                if not model.languages or value is None or not any(map(str.isalpha, value)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                if len(model.languages) == 1:
                    out.append((model.languages[0], 1.0, False))
                    continue
                share = decode(model, features(value)[None])[1][0]
                first, second = np.argsort(-share, kind="stable")[:2]
                out.append((model.languages[first], float(share[first]), bool(share[first] - share[second] < LEAD)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(free_name(docs, "language"), predict(F.col(text)))
