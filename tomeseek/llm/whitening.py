"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, each step makes u = Xv - beta u' and then v = X'u - alpha v,
both sums over all rows made by Spark. Each new u and v is made orthogonal to all
earlier ones, twice. The numbers alpha and beta are a small bidiagonal matrix whose
singular values approach those of X, and whose singular vectors turn the v's into the
components.

A u has an entry for each row, but each is a combination of rows' products with known
directions: u = Xp. Only p is kept, by the driver, and a task that meets a row makes
its entries of all u's anew. So nothing that grows with the rows is carried from step
to step, and a lost executor costs the part of one pass.

A run ends when the wanted singular values no longer move. A start vector can miss a
direction (of several with one deviation it sees only one), so a further run looks at
the space outside all directions tried; if a component is there, a run starts from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.session import written

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Whole entries beyond this are set to it, so that sums and differences stay exact.
MOST = 1 << 50
#: Bytes of a block of vectors.
BLOCK = 2 << 20
#: A singular value counts as found when its error is below this part of the largest one.
CLOSE = 1e-14
#: Singular values below this part of the largest one are rounding, not deviation.
NOTHING = 1e-13
SEED = 7
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, exact sums, components (one a row), their eigenvalues and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)


def blocks(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """width, ids, x of blocks of vectors: floor(scale * entry) + offset as 64-bit integers, row after row."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    most = float(MOST)
    whole = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-most)), F.lit(most))).cast("bigint") + F.lit(offset))
    rows = vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint"), whole.alias("x"), F.size("embedding").alias("width"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths):
                same = batch.filter(pa.array(widths == width))
                step = max(1, BLOCK // (8 * max(1, int(width))))
                for i in range(0, same.num_rows, step):
                    part = same.slice(i, step)
                    yield pa.record_batch([
                        pa.array([int(width)], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    ], ["width", "ids", "x"])

    return rows.mapInArrow(pack, "width int, ids array<bigint>, x binary")


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, np.ndarray]]:
    for ids, x in zip(batch.column(1).to_pylist(), batch.column(2)):
        yield ids, np.frombuffer(x.as_py(), "<i8").reshape(len(ids), width)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n with one rounding: the whole part of the mean is taken off exactly."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum of (n x - S)^2 of each row; at most the largest 64-bit number."""
    s = np.array(sums, object)
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) <= LONGEST:
        far = n * x - s.astype(np.int64)
        return (far * far).sum(1).tolist()
    far = n * x.astype(object) - s
    return [min(LONGEST, int(d)) for d in (far * far).sum(1)]


def _summed(table: DataFrame, width: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` (``size`` numbers of a block of whole rows) summed over all blocks: in each task first, then by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for batch in batches:
            for _, x in _rows(batch, width):
                total += of(x)
                any_ = True
        if any_:
            yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "part"])

    out = np.zeros(size)
    for i, part in table.mapInArrow(run, "i int, part double").groupBy("i").agg(F.sum("part")).collect():
        out[i] = part
    return out


class Products:
    """Products of the centred rows with directions, as sums over all rows."""

    def __init__(self, table: DataFrame, n: int, sums: tuple[int, ...]) -> None:
        self.table, self.n, self.sums = table, n, sums

    def forward(self, past: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """U'w and w'w for w = Xp, where the u's are X times the rows of ``past``."""
        n, sums, k = self.n, self.sums, len(past)

        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            w = c @ p
            return np.append((c @ past.T).T @ w, w @ w)

        got = _summed(self.table, len(sums), k + 1, of)
        return got[:k], float(got[k])

    def back(self, past: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X'u, U'u and u'u for u = Xp."""
        n, sums, k, d = self.n, self.sums, len(past), len(p)

        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            u = c @ p
            return np.concatenate([c.T @ u, (c @ past.T).T @ u, [u @ u]])

        got = _summed(self.table, d, d + k + 1, of)
        return got[:d], got[d : d + k], float(got[-1])


def _outside(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def _basis(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """An orthonormal basis of what ``vectors`` (of unit length) span."""
    out: list[np.ndarray] = []
    for v in vectors:
        rest = _outside(v, out)
        if (length := np.linalg.norm(rest)) > 1e-8:
            out.append(_outside(rest / length, out))
    return out


def lanczos(
    products: Products, width: int, wanted: int, known: list[np.ndarray], start: np.ndarray, draw: np.random.Generator, least: float, scale: float,
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Singular values (falling), right vectors (rows) and the searched directions, all outside ``known``.

    Ends when ``wanted`` values are found, when all that can still come are below
    ``least``, or when no direction is left. ``scale``: the largest singular value so
    far, for what counts as nothing.
    """
    def unit(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray | None:
        v = _outside(v, basis)
        return v / np.linalg.norm(v) if len(basis) < width else None

    vs: list[np.ndarray] = []
    ps: list[np.ndarray] = []
    matrix = np.zeros((0, 0))
    v, beta = unit(start, known), 0.0
    values, right = np.zeros(0), np.zeros((0, width))
    while v is not None:
        vs.append(v)
        k = len(vs)
        past = np.array(ps).reshape(len(ps), width)
        # u: Xv without its parts along all earlier u's (beta times the last one among them).
        p = v - (beta * ps[-1] if ps else 0.0)
        along, square = products.forward(past, p)
        p = p - along @ past
        alpha = np.sqrt(max(0.0, square - along @ along))
        grown = np.zeros((k, k))
        grown[: k - 1, : k - 1] = matrix
        if k > 1:
            grown[k - 2, k - 1] = beta
        scale = max(scale, alpha, np.sqrt(square))
        if alpha > NOTHING * scale:
            p = p / alpha
            pull, rest, square = products.back(past, p)
            # The second orthogonalisation, and the length as measured.
            p, pull = p - rest @ past, pull - rest @ _pulls(grown, vs, k - 1)
            length = np.sqrt(max(square - rest @ rest, 0.0)) or 1.0
            p, pull, alpha = p / length, pull / length, alpha * length
        else:  # v leads nowhere new: a row of zeros
            p, pull, alpha = np.zeros(width), np.zeros(width), 0.0
        ps.append(p)
        grown[k - 1, k - 1] = alpha
        matrix = grown
        v = _outside(pull - alpha * vs[-1], [*known, *vs])
        beta = float(np.linalg.norm(v))
        left, values, rows = np.linalg.svd(matrix)
        right = rows @ np.array(vs)
        # The error of a singular value is at most what beta makes of the last entry of its left vector.
        error = beta * np.abs(left[-1])
        scale = max(scale, values[0])
        if beta <= NOTHING * scale:
            beta, v = 0.0, unit(draw.standard_normal(width), [*known, *vs])
        else:
            v = v / beta
            close = error <= CLOSE * scale
            if len(values) >= wanted and close[:wanted].all() or values[0] + error.max() < least:
                break
    return values, right, vs


def _pulls(matrix: np.ndarray, vs: list[np.ndarray], k: int) -> np.ndarray:
    """X'u of the first k u's, from the bidiagonal matrix: alpha v + beta times the next v."""
    return matrix[:k] @ np.array(vs) if k else np.zeros((0, len(vs[0])))


def fit_width(table: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The fit over all vectors of ``table`` (see ``blocks``, all of one width)."""
    total = table.select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0]
    sums = _exact_sums(table, width)
    products = Products(table, total, sums)
    trace = float(_summed(table, width, 1, lambda x: np.array([(_centred(x, total, sums) ** 2).sum()]))[0]) / total
    wanted = min(components, width)
    draw = np.random.default_rng(SEED)
    scale = float(np.sqrt(trace * total / max(1, width)))
    values, found, searched = np.zeros(0), np.zeros((0, width)), []
    start = draw.standard_normal(width)
    while trace:
        new, right, tried = lanczos(products, width, wanted, list(found), start, draw, 0.0, scale)
        scale, searched = max([scale, *new[:1]]), searched + tried
        values, found = np.append(values, new[:wanted]), np.vstack([found, right[:wanted]])
        order = np.argsort(-values, kind="stable")[:wanted]
        values, found = values[order], found[order]
        # What no run has looked at: of interest if it holds more than the last component found.
        basis = _basis([*found, *searched])
        if len(basis) >= width:
            break
        least = max(values[-1] * (1 + CLOSE), NOTHING * scale)
        probe, right, _ = lanczos(products, width, 1, basis, draw.standard_normal(width), draw, least, scale)
        if not len(probe) or probe[0] <= least:
            break
        start = right[0]
    keep = values > NOTHING * scale
    vectors = found[keep] / np.linalg.norm(found[keep], axis=1, keepdims=True) if keep.any() else np.zeros((0, width))
    return Whitening(total, sums, vectors, values[keep] ** 2 / total, trace)


def _exact_sums(table: DataFrame, width: int) -> tuple[int, ...]:
    """Sums of each dimension, exact: in halves of 32 bits, which tasks add without overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [0] * width, [0] * width
        for batch in batches:
            for _, x in _rows(batch, width):
                for out, part in ((low, x & 0xFFFFFFFF), (high, x >> 32)):
                    out[:] = [a + b for a, b in zip(out, part.sum(0).tolist())]
        yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["i", "low", "high"])

    wide = "decimal(38,0)"
    parts = table.mapInArrow(run, "i int, low bigint, high bigint").groupBy("i").agg(F.sum(F.col("low").cast(wide)).alias("low"), F.sum(F.col("high").cast(wide)).alias("high"))
    found = {r.i: int(r.low) + (int(r.high) << 32) for r in parts.collect()}
    return tuple(found[i] for i in range(width))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)


def identity_error(table: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.eigenvalues)

    def of(x: np.ndarray) -> np.ndarray:
        y = _projected(x, model)
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    got = _summed(table, model.width, k + k * k, of) / model.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whitened(table: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened entries of every vector of ``table``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _rows(batch, model.width):
                y = _projected(x, model)
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array(deviations(x, model.n, model.sums), pa.int64()),
                    pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel())),
                ], ["vec_id", "deviation", "whitened"])

    return table.mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component.

    ``vectors`` needs vec_id and embedding; other columns are ignored. NULL vectors and
    those with a NULL or non-finite entry are left out; repeated rows and NULL ids are
    rows like others. Vectors of different widths are different spaces: each width has
    its own fit. A component without deviation (equal vectors, fewer rows than
    components, empty vectors) has no rows, so an empty table gives none. Entries are clamped to
    2^50 in size after scaling; a deviation beyond 64 bits is given as the largest number.
    """
    whole = written(blocks(vectors, scale, offset), "vector-blocks")
    out = None
    for width in sorted(r[0] for r in whole.select("width").distinct().collect()):
        table = whole.where(F.col("width") == width)
        model = fit_width(table, width, components)
        if not len(model.eigenvalues):
            continue
        error = identity_error(table, model)
        explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
        rows = whitened(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
            F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
        out = rows if out is None else out.unionByName(rows)
    if out is not None:
        return out
    none = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    return whole.select(F.lit(None).cast("bigint").alias("vec_id"), *(F.lit(None).cast(t).alias(c) for c, t in none.items())).limit(0)
