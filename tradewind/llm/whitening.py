"""Whitening of embeddings by a covariance that is exact until its eigenvectors are taken.

Entries c become whole numbers x = floor(64 * c) + 1000000, and the fit list holds each
distinct x vector once. With n vectors and sums S, m = n * x - S is x centred, in whole
numbers. One pass sums the squares of m_i for every dimension and of m_i + m_j for every
pair of dimensions, exactly; by polarisation

    2 * sum(m_i * m_j) = sum((m_i + m_j)^2) - sum(m_i^2) - sum(m_j^2)

so differences of these variances are all the cross-covariances. What reaches the driver
is one sum for each dimension and pair, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import map_batches, written
from tradewind.llm.vectors import matrix, usable_vectors

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**53  # entries from here on drop their row: x would leave the whole numbers of 64 bits
LIMB = 21  # bits; a square of three limbs stays in 64 bits when summed over a million rows
SPLIT = 10**24  # sums are shuffled as two decimals, value = high * SPLIT + low
ROWS = 4096

SUMS = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("high", T.StringType()),  # whole numbers of any size leave Python as text
        T.StructField("low", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)
MOMENTS = T.StructType(
    [
        *SUMS.fields[:2],
        *[T.StructField(name, T.DoubleType()) for name in ("comoment", "product", "sum_i", "sum_j")],
    ]
)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of the squares of every column of whole numbers; at most a million rows."""
    if not len(y):
        return [0] * y.shape[1]
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=0)]
    most = max(int(y.max()), -int(y.min()))
    if most * most * len(y) < 1 << 63:
        return (y * y).sum(axis=0).tolist()
    mask = (1 << LIMB) - 1
    limbs = [y & mask, (y >> LIMB) & mask, y >> (2 * LIMB)]
    total = [0] * y.shape[1]
    for a, b in combinations_with_replacement(range(3), 2):
        part = (limbs[a] * limbs[b]).sum(axis=0).tolist()
        weight = (1 if a == b else 2) << (LIMB * (a + b))
        total = [t + weight * p for t, p in zip(total, part, strict=True)]
    return total


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of 64-bit whole numbers."""
    high, low = (x >> 31).sum(axis=0).tolist(), (x & ((1 << 31) - 1)).sum(axis=0).tolist()
    return [(h << 31) + v for h, v in zip(high, low, strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in 64 bits where twice it fits, else in Python's whole numbers."""
    floors = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    near = x - floors
    most = max(int(near.max()), -int(near.min())) if near.size else 0
    if n * (most + 1) < 1 << 60:
        return near * n - np.array(rest, np.int64)
    return near.astype(object) * n - np.array(rest, object)


def pair_names(dims: int) -> tuple[list[int], list[int]]:
    """The dimension (k, k) and the pair (i, j) of every square sum, in the order of ``pair_square_sums``."""
    i = [*range(dims), *(a for a in range(dims) for _ in range(a + 1, dims))]
    j = [*range(dims), *(b for a in range(dims) for b in range(a + 1, dims))]
    return i, j


def pair_square_sums(m: np.ndarray) -> list[int]:
    """Sums of the squares of m_k, then of m_i + m_j for i < j."""
    total = square_sums(m)
    for i in range(m.shape[1] - 1):
        total += square_sums(m[:, i : i + 1] + m[:, i + 1 :])
    return total


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _summed(
    fit: DataFrame, of: Callable[[np.ndarray], list[int]], names: Callable[[int], tuple[list[int], list[int]]]
) -> tuple[int, dict[tuple[int, int], int]]:
    """The number of rows, and the exact sums that ``of`` gives for their vectors; every task sends one row per sum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, count, dims = None, 0, 0
        for batch in _slices(batches):
            x = matrix(batch.column("x"), np.int64)
            own = of(x)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
            count, dims = count + len(x), x.shape[1]
        if total is not None:
            i, j = names(dims)
            yield {
                "i": i,
                "j": j,
                "high": [str(v // SPLIT) for v in total],
                "low": [str(v % SPLIT) for v in total],
                "rows": [count] * len(total),
            }

    found = map_batches(fit, rows, SUMS).selectExpr(
        "i", "j", "cast(high as decimal(38,0)) as high", "cast(low as decimal(38,0)) as low", "rows"
    )
    merged = found.groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("rows").alias("rows")
    )
    sums = {(r.i, r.j): (int(r.high) * SPLIT + int(r.low), r.rows) for r in merged.collect()}
    count = max((rows for _, rows in sums.values()), default=0)
    return count, {pair: value for pair, (value, _) in sums.items()}


def covariance(sums: dict[tuple[int, int], int], n: int, dims: int) -> np.ndarray:
    """The covariance with divisor n from the square sums; every entry is rounded once."""
    result = np.empty((dims, dims))
    for (i, j), value in sums.items():
        product = 2 * value if i == j else value - sums[i, i] - sums[j, j]
        result[i, j] = result[j, i] = product / (2 * n**3)
    return result


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    peak = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return values, vectors * np.where(peak < 0, -1.0, 1.0)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Every distinct vector of whole numbers once, from ``id`` and ``vector``."""
    return vectors.select(_whole()).distinct()


def _whole() -> F.Column:
    return F.expr(f"transform(vector, c -> cast(floor({SCALE} * double(c)) as bigint) + {OFFSET})").alias("x")


def _identity_error(fit: DataFrame, project: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], kept: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity.

    Every task centres at its own mean before it multiplies; the means are merged afterwards.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = np.triu_indices(kept)
        for batch in _slices(batches):
            white = project(matrix(batch.column("x"), np.int64))[1][:, :kept]
            mean = white.mean(axis=0)
            away = white - mean
            yield {
                "i": a,
                "j": b,
                "comoment": (away.T @ away)[a, b],
                "product": len(white) * mean[a] * mean[b],
                "sum_i": len(white) * mean[a],
                "sum_j": len(white) * mean[b],
            }

    merged = map_batches(fit, rows, MOMENTS).groupBy("i", "j").agg(
        *[F.sum(name).alias(name) for name in ("comoment", "product", "sum_i", "sum_j")]
    )
    n = fit.count()
    off = [
        abs((r.comoment + r["product"] - r.sum_i * r.sum_j / n) / n - (r.i == r.j)) for r in merged.collect()
    ]
    return max(off, default=None)


def whiten(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per usable row and component: id, ``component`` from 1, ``n`` of the fit list, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    Rows whose vector is null or empty, holds a null or non-finite entry or one of 2^53 or more
    in size, or has not the commonest length, take no part. Rows that repeat an id or a vector,
    and rows with a null id, each get their own; other columns are ignored; an empty table gives
    an empty result. ``deviation`` is null where a long can't hold it. A component without
    variance (an eigenvalue within rounding of zero) has a null ``whitened`` and takes no part in
    ``identity_error``; where nothing varies ``explained`` and ``identity_error`` are null.

    The fit list is written to the shared folder and read three times: sums, square sums, check.
    """
    vectors = usable_vectors(df, id_column, vector_column, LARGEST)
    fit = written(fit_list(vectors), "fit")
    n, sums = _summed(fit, column_sums, lambda dims: (list(range(dims)), list(range(dims))))
    dims = len(sums)
    totals = [sums[k, k] for k in range(dims)]
    _, squares = _summed(fit, lambda x: pair_square_sums(centred(x, n, totals)), pair_names)
    count = min(components, dims)
    if n:
        values, axes = eigen(covariance(squares, n, dims))
        axes, trace = axes[:count], sum(squares[k, k] for k in range(dims)) / n**3
        kept = int((values[:count] > dims * np.finfo(float).eps * max(values[0], 0.0)).sum())
        explained = [float(v) / trace if trace else None for v in values[:count]]
        roots = np.sqrt(np.maximum(values[:count], 0.0))

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = centred(x, n, totals)
        with np.errstate(divide="ignore", invalid="ignore"):
            return m, (m / n).astype(float) @ axes.T / roots

    error = _identity_error(fit, project, kept) if n else None
    schema = T.StructType(
        [
            T.StructField(id_column, T.LongType()),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            m, white = project(matrix(batch.column("x"), np.int64))
            ids = batch.column("id").to_pylist()
            deviation = [v if v < 1 << 63 else None for v in row_squares(m)]
            flat = white.ravel()
            yield {
                id_column: [v for v in ids for _ in range(count)],
                "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(ids)),
                "n": [n] * len(flat),
                "deviation": [v for v in deviation for _ in range(count)],
                "whitened": pa.array(flat, mask=np.tile(np.arange(count) >= kept, len(ids))),
                "explained": explained * len(ids),
                "identity_error": [error] * len(flat),
            }

    return map_batches(vectors.select("id", _whole()), rows, schema)


def row_squares(m: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    return square_sums(np.ascontiguousarray(m.T)) if len(m) else []
