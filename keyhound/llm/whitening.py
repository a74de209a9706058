"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Spark sums the vectors (exact integers) and the products of centred vectors (a small matrix per task, added
up entry by entry).  The covariance, ``dimensions`` squared numbers however many rows there are, is then
split into its components: the polar factor ``U`` of ``V - shift`` has the eigenvalues 1 and -1, so
``(U + 1) / 2`` projects on the components above the shift; an orthonormal basis of that space and of its complement
splits ``V`` into two smaller blocks, and so on down to single components.  ``U`` comes from the dynamically
weighted Halley iteration, in QR form while badly conditioned and in Cholesky form afterwards.  The
components go to all tasks, which project their rows.

A vector's entry ``c`` counts as the long ``floor(64 * c) + 1000000``.  Entries beyond +-2**52 after the
scaling are held there.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped, and so are
vectors without entries; vectors of several lengths are refused; an empty table gives no rows; repeated rows and ids are rows
of their own; extra columns are ignored.  A component without variance (at most ``d * 2**-50`` of
the largest eigenvalue, as when all vectors are equal) has whitened value 0, and takes no part in the identity error; its
share is its eigenvalue over the trace, and 0 if the trace is 0.  A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 52)
MAX_DIMENSIONS = 8_192
ROWS_AT_ONCE = 1_024
_EPS = np.finfo(float).eps


# --- linear algebra -----------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps."""
    n = len(a)
    size = np.linalg.norm(a)  # at least the largest singular value
    x = a / size
    low = max(_smallest(x), _EPS)  # at most the smallest one, unless the matrix is singular
    one = np.eye(n)
    for _ in range(60):
        w = low * low
        d = np.cbrt(4.0 * (1.0 - w) / (w * w))
        root = np.sqrt(1.0 + d)
        weight = root + 0.5 * np.sqrt(max(8.0 - 4.0 * d + 8.0 * (2.0 - w) / (w * root), 0.0))
        b = (weight - 1.0) ** 2 / 4.0
        c = weight + b - 1.0
        if c > 100.0:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + c * (x.T @ x))
            solved = np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
            new = (b / c) * x + (weight - b / c) * solved
        low = min(low * (weight + b * w) / (1.0 + c * w), 1.0)
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2.0
        if moved < 4 * n * _EPS or (low > 1.0 - 8 * _EPS and moved < np.cbrt(_EPS)):
            break
    return x


def _smallest(x: np.ndarray) -> float:
    """A lower bound of the smallest singular value, from the triangular factor."""
    r = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(r))
    if diagonal.min() <= _EPS * diagonal.max():
        return 0.0
    inverse = np.linalg.solve(r, np.eye(len(r)))
    return 1.0 / np.linalg.norm(inverse)


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal columns: the range of the projector first, then its complement.

    Columns are taken by falling remainder, so the first ``rank`` ones span the range.
    """
    n = len(projector)
    work, chosen = projector.copy(), np.empty((n, 0))
    for _ in range(rank):
        k = int(np.argmax((work * work).sum(0)))
        v = work[:, k]
        for _ in range(2):
            v = v - chosen @ (chosen.T @ v)
            v = v / np.linalg.norm(v)
        chosen = np.column_stack([chosen, v])
        work = work - np.outer(v, v @ work)
    return np.linalg.qr(chosen, mode="complete")[0]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    n = len(v)
    v = (v + v.T) / 2.0
    vectors = np.empty((n, n))
    small = _EPS * np.linalg.norm(v)
    done = 0
    blocks = [(v, np.eye(n))]
    while blocks:
        block, basis = blocks.pop()
        m = len(block)
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        if m == 1 or off <= small:
            vectors[:, done : done + m] = basis
            done += m
            continue
        q, rank = _split(block)
        turned = q.T @ block @ q
        blocks.append((_symmetric(turned[:rank, :rank]), basis @ q[:, :rank]))
        blocks.append((_symmetric(turned[rank:, rank:]), basis @ q[:, rank:]))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(x: np.ndarray) -> np.ndarray:
    return (x + x.T) / 2.0


def _split(block: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthogonal matrix that parts the block's space in two, and the size of the first part.

    A shift at an eigenvalue has no clear polar factor; the next shift is tried then.
    """
    m = len(block)
    diagonal = np.sort(np.diag(block))
    spread = max(diagonal[-1] - diagonal[0], np.linalg.norm(block - np.diag(np.diag(block))) / m)
    middle = [np.median(diagonal), diagonal.mean()]
    shifts = [*middle, *(middle[0] + spread * k / 64 for k in (1, -1, 3, -3, 7, -7, 13, -13, 29, -29, 47, -47))]
    best = None
    for shift in shifts:
        moved = block - shift * np.eye(m)
        factor = polar(moved)
        rank = round((np.trace(factor) + m) / 2.0)
        if not 0 < rank < m:
            continue
        q = _basis((factor + np.eye(m)) / 2.0, rank)
        rest = np.linalg.norm(q[:, :rank].T @ block @ q[:, rank:])
        if best is None or rest < best[0]:
            best = (rest, q, rank)
        if rest <= 8 * m * _EPS * np.linalg.norm(block):
            break
    if best is None:
        raise ArithmeticError("no shift parts the matrix")
    return best[1], best[2]


# --- sums over rows -----------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows whose vector has entries, none of them null, NaN or infinite."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.where((F.size("embedding") > 0) & finite)


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors, a bounded number of rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            entries = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            scaled = np.clip(np.floor(entries * SCALE), -LARGEST, LARGEST)
            yield part.column("vec_id"), scaled.astype(np.int64) + SHIFT


def _entry_sums(parts: DataFrame, exact: bool) -> np.ndarray:
    """Sums over tasks of rows ``i, values``: a row of a matrix each."""
    kind = "decimal(38,0)" if exact else "double"
    sums = parts.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j")
    rows = sums.agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()  # an entry each, whatever the number of vectors
    if not rows:
        return np.zeros((0, 0), object if exact else float)
    out = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1), object if exact else float)
    for r in rows:
        out[r.i, r.j] = int(r.value) if exact else r.value
    return out


def _products(rows: DataFrame, d: int, width: int, of) -> np.ndarray:
    """The sum of ``y' y`` over all rows, where ``of`` turns integer vectors into ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _matrices(batches, d):
            y = of(x)
            total += y.T @ y
        if total.any():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * width + 1, width, np.int32)), pa.array(total.ravel()))
            yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), lists], ["i", "values"])

    found = _entry_sums(rows.mapInArrow(run, "i int, values array<double>"), False)
    return found if found.size else np.zeros((width, width))


class Whitening:
    """The fitted transformation: ``n``, sums ``S``, eigenvalues and unit eigenvectors."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, count: int):
        self.n, self.sums, self.count = n, sums, min(count, len(values))
        self.values = np.maximum(values[: self.count], 0.0)
        self.vectors, trace = vectors[:, : self.count], float(np.maximum(values, 0.0).sum())
        self.trace = trace
        self.varies = self.values > len(values) * 2.0**-50 * max(float(values[0]), 0.0)
        self.explained = self.values / trace if trace else np.zeros(self.count)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``; the whole part is taken off as integers, so nothing cancels in floating point."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.varies, 1.0 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        return (self.centred(x) @ self.vectors) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of ``(n * x - S) ** 2``, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        off = x - whole
        reach = int(np.abs(off).max(initial=0)) + 1
        if (reach * self.n) ** 2 * len(rest) < 1 << 63:
            y = off * self.n - np.array(rest, np.int64)
            return (y * y).sum(1).tolist()
        exact = [sum((self.n * int(a) - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in off]
        return [e if e < 1 << 63 else None for e in exact]


def fit(vectors: DataFrame, count: int = 32) -> Whitening | None:
    """Components of all rows that ``usable`` keeps; None if there are none."""
    rows = usable(vectors)
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return None
    if least != most or most > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {least} to {most} entries; one length of at most {MAX_DIMENSIONS} is needed")
    d = most

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches, d):
            sums = [Decimal(c) for c in x.sum(0).tolist()]  # below 2**63: entries up to 2**52, 2**10 rows
            lists = pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), pa.array(sums, pa.decimal128(38)))
            yield pa.record_batch([pa.array([0], pa.int32()), lists], ["i", "values"])

    sums = _entry_sums(rows.mapInArrow(add, "i int, values array<decimal(38,0)>"), True)[0]
    centre = Whitening(n, sums, np.zeros(d), np.eye(d), d).centred
    covariance = _products(rows, d, d, centre) / n
    return Whitening(n, sums, *components(covariance), count)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """How far the covariance of the whitened rows, measured over all of them, is from the identity."""
    d = len(fitted.sums)
    found = _products(usable(vectors), d, fitted.count, fitted.project) / fitted.n
    off = np.abs(found - np.eye(fitted.count))[np.ix_(fitted.varies, fitted.varies)]
    return float(off.max(initial=0.0))


COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, count: int = 32) -> DataFrame:
    """A row per vector and component: ``vec_id`` and ``COLUMNS``."""
    key = vectors.select("vec_id").schema[0].dataType.simpleString()
    schema = f"vec_id {key}, {COLUMNS}"
    fitted = fit(vectors, count)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, d = identity_error(vectors, fitted), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.count
        for ids, x in _matrices(batches, d):
            rows = len(x)
            yield pa.record_batch(
                [
                    ids.take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * m, fitted.n)),
                    pa.array(fitted.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(fitted.project(x).ravel()),
                    pa.array(np.tile(fitted.explained, rows)),
                    pa.array(np.full(rows * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable(vectors).mapInArrow(run, schema)
