"""Quality of texts by compression.

Two zstandard dictionaries are built, of good and of bad labelled text. A text is
compressed in blocks with either and with none; the difference of the two sizes,
over the size with none, tells which kind it resembles. A logistic curve, fitted on
labelled texts that the dictionaries have not seen, turns it to a score. Its second
input is how well the text compresses by itself: text that repeats itself leaves
no difference between dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.llm.common import fold_of, free_name
from tomeseek.llm.samples import draw, sample_pieces, share_of, shares

#: Bytes compressed at a time: all of a long text has the dictionary at hand alike.
BLOCK = 4096
LEVEL = 3
#: Bounds of what is fitted on: blocks for each dictionary, texts of each class for the curve.
DICTIONARY_BLOCKS = 2_000
CURVE_TEXTS = 10_000
DICTIONARY_BYTES = 112_640
#: Compressed size over size from which on a text doesn't count as repeating itself.
PLAIN = 0.3
KEEP = 0.7


@dataclass(frozen=True)
class QualityModel:
    """The two dictionaries and the curve: bias, weight of the difference, weight of the text's own compression."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float]


class _Sizes:
    def __init__(self, model: QualityModel) -> None:
        self.by = [self._compressor(model.good), self._compressor(model.bad), self._compressor(b"")]

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not dictionary:
            return zstandard.ZstdCompressor(level=LEVEL, **plain)
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)

    def __call__(self, text: str | None) -> tuple[float, float]:
        """The normalised difference (above 0: nearer to good) and the clipped own compression."""
        data = (text or "").encode()
        if not data:
            return 0.0, PLAIN
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad, plain = (sum(len(c.compress(b)) for b in blocks) for c in self.by)
        return (bad - good) / plain, min(plain / len(data), PLAIN)


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of weighted rows by Newton steps with a little shrinking, on centred columns."""
    centre = np.average(x, 0, weight)
    spread = np.sqrt(np.average((x - centre) ** 2, 0, weight)) + 1e-9
    design = np.c_[np.ones(len(x)), (x - centre) / spread]
    w, keep = np.zeros(design.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + keep, design.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -4, 4)
    slopes = w[1:] / spread
    return float(w[0] - slopes @ centre), float(slopes[0]), float(slopes[1])


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the rows of ``labels`` (doc_id, quality 0 or 1) outside fold 2; other values of quality are left out.

    Folds 0 and 1 give the dictionaries (DICTIONARY_BLOCKS blocks of each class), fold
    3 the curve (CURVE_TEXTS texts of each class, weighted by the class's size): samples by hash, of all labelled rows with a text. If
    a class has no row, every text gets the share of good ones among the labels (0.5 if there are none).
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of("doc_id") != 2)).select("doc_id", F.col("quality").cast("int").alias("group"))
    docs = docs.where(F.col("text").isNotNull())
    pieces = sample_pieces(docs, known.where(fold_of("doc_id") < 2), DICTIONARY_BLOCKS, BLOCK)
    counts = {r["group"]: r["count"] for r in known.join(docs.select("doc_id"), "doc_id").groupBy("group", (fold_of("doc_id") == 3).alias("late"))
              .count().where("late").collect()}
    if not (pieces.get(0) and pieces.get(1) and counts.get(0) and counts.get(1)):
        share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
        return QualityModel(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0))
    raw = QualityModel(_dictionary(pieces[1]), _dictionary(pieces[0]), (0.0, 0.0, 0.0))
    late = known.where(
        (fold_of("doc_id") == 3) & (draw("doc_id") < share_of(F.col("group"), shares(counts, CURVE_TEXTS)))).limit(4 * CURVE_TEXTS)
    # ``late`` is bounded by its limit.
    measured = docs.select("doc_id", "text").join(F.broadcast(late), "doc_id").select("group", _measure(raw)("text").alias("x")).select("group", "x.*").collect()
    measured.sort()
    x = np.array([(r["difference"], r["own"]) for r in measured])
    y = np.array([r["group"] for r in measured])
    # Each row stands for as many of its class: the curve learns the true share, whatever part of a class is drawn.
    weight = np.array([counts[c] for c in (0, 1)])[y] / np.maximum(np.bincount(y, minlength=2), 1)[y]
    return QualityModel(raw.good, raw.bad, _fit_curve(x, y.astype(float), weight))


def _measure(model: QualityModel):
    @F.pandas_udf("difference double, own double")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(model)
        for batch in texts:
            yield pd.DataFrame([sizes(t) for t in batch], columns=["difference", "own"])

    return measure


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a column score, 0 to 1 (higher: label 1 likelier), of each row's whole text.

    NULL counts as the empty text, which resembles neither kind. Rows that repeat stay;
    a column of that name that is there already makes the new one ``_score``.
    """
    bias, slope, own = model.curve
    x = _measure(model)(F.col(text))
    score, held = free_name(docs, "score"), free_name(docs, "measured")
    raw = F.lit(bias) + slope * F.col(f"{held}.difference") + own * F.col(f"{held}.own")
    return docs.withColumn(held, x).withColumn(score, 1 / (1 + F.exp(-raw))).drop(held)
