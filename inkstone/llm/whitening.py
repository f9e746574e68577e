"""Operator 13: whitening of embeddings by the leading eigenvectors of their covariance.

Three scans of the table, none of which shuffles a vector:

1. sums of the grid values x = floor(scale * c) + offset of each dimension, exact;
2. the covariance, centred before multiplying: a task multiplies centred blocks and hands on one d x d matrix,
   which Spark adds up by entry;
3. the projection on the components, which travel to the tasks (at most MAX_DIM x ``components`` numbers).

The d x d matrix (d at most MAX_DIM, checked) is decomposed on the driver: Householder
reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse
iteration their vectors, which are made orthogonal again within clusters of near eigenvalues.

Defined results: a vector that is null, empty, or holds null or non-finite entries is dropped (it is not
in the fit list either); vectors of different lengths, an entry beyond +-2^52 on the grid and more than
MAX_DIM dimensions raise an error.  Components whose eigenvalue is numerically zero
(d * 2^-52 of the largest) cannot be whitened and are left out, so a table of equal vectors has none; an
empty table gives an empty result.  Rows are kept as they are, repeated or without an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import id_column, materialise

MAX_DIM = 2048
CLUSTER = 1e-3  # eigenvalues closer than this share of the largest are one cluster
PROJECTED = "id long, deviation decimal(38,0), whitened array<double>"


@dataclass
class Whitening:
    """Rows fitted, exact sums by dimension, leading eigenvalues (falling) with unit vectors in columns, trace of the
    covariance, and the largest absolute entry of the whitened covariance minus the identity."""

    n: int = 0
    sums: list = field(default_factory=list)
    values: list = field(default_factory=list)
    vectors: object = None
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def explained(self) -> list:
        return [v / self.trace for v in self.values]


def tridiagonal(matrix):
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix by Householder reflections."""
    import numpy as np

    a = np.array(matrix, float)
    d, off, reflectors = len(a), np.zeros(max(len(a) - 1, 0)), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:  # nothing to reflect
            off[k], v = v[0], None
        else:
            off[k] = -np.copysign(size, v[0])
            v[0] -= off[k]
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    if d > 1:
        off[d - 2] = a[d - 1, d - 2]
    return np.diag(a).copy(), off, reflectors


def sturm_counts(diagonal, off, points):
    """For each point the number of eigenvalues below it: negative terms of the Sturm sequence."""
    import numpy as np

    squares = np.concatenate([[0.0], off * off])
    least = max(np.finfo(float).tiny, np.finfo(float).eps ** 2 * squares.max())
    q, below = np.ones_like(points), np.zeros(len(points), int)
    for a, b in zip(diagonal, squares):
        q = a - points - b / q
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal, off, k: int):
    """The ``k`` largest eigenvalues, falling, each by bisection."""
    import numpy as np

    d = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(k, np.min(diagonal - around)), np.full(k, np.max(diagonal + around))
    place = np.arange(1, k + 1)
    eps = np.finfo(float).eps
    slack = eps * max(abs(low[0]), abs(high[0]))
    low, high = low - 2 * slack, high + 2 * slack
    for _ in range(200):
        middle = (low + high) / 2
        if np.all(high - low <= 2 * eps * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny):
            break
        reached = d - sturm_counts(diagonal, off, middle) >= place  # that many are at least ``middle``
        low, high = np.where(reached, middle, low), np.where(reached, high, middle)
    return (low + high) / 2


def _solve(diagonal, off, shift, right, least):
    """Solve (T - shift I) y = right by elimination with row exchanges."""
    d = len(diagonal)
    main, upper, second = [a - shift for a in diagonal], list(off) + [0.0], [0.0] * d
    y = list(right)
    for i in range(d - 1):
        below = off[i]
        if abs(main[i]) >= abs(below):
            f = below / main[i] if main[i] else 0.0
            main[i + 1] -= f * upper[i]
            y[i + 1] -= f * y[i]
        else:
            f = main[i] / below
            main[i], upper[i], second[i], main[i + 1], after = below, main[i + 1], upper[i + 1], upper[i] - f * main[i + 1], upper[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
            upper[i + 1] = -f * after
    for i in range(d - 1, -1, -1):
        v = y[i] - (upper[i] * y[i + 1] if i + 1 < d else 0.0) - (second[i] * y[i + 2] if i + 2 < d else 0.0)
        y[i] = v / (main[i] if abs(main[i]) > least else least)
    return y


def tridiagonal_vectors(diagonal, off, values):
    """Unit eigenvectors of the tridiagonal matrix, in columns, by inverse iteration."""
    import numpy as np

    d, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if d > 1 else 0.0)
    eps = np.finfo(float).eps
    least, out = eps * norm or eps, np.zeros((d, k))
    a, b = diagonal.tolist(), off.tolist()
    rng = np.random.default_rng(13)
    first, shift = 0, None
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            first, shift = j, None
        # equal values get shifts a little apart, or their iterations would agree
        shift = values[j] if shift is None else min(values[j], shift - 10 * eps * norm)
        y = rng.standard_normal(d)
        for _ in range(4):
            y = np.array(_solve(a, b, shift, y / np.abs(y).max(), least))
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_components(matrix, k: int):
    """(eigenvalues, unit eigenvectors in columns) of a symmetric matrix, the ``k`` largest that are not numerically zero."""
    import numpy as np

    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > len(matrix) * np.finfo(float).eps * values[0]]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if reflectors[i] is not None:
            vectors[i + 1:] -= 2 * np.outer(reflectors[i], reflectors[i] @ vectors[i + 1:])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


def usable(column):
    """(mask of usable rows, their entries as a float64 matrix) of an Arrow list column."""
    import numpy as np

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    ends = np.append(0, np.cumsum(sizes))
    good = (sizes > 0) & (np.diff(bad[ends]) == 0)
    dims = np.unique(sizes[good])
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {dims[0]} and {dims[-1]}")
    return good, values[np.repeat(good, sizes)].reshape(int(good.sum()), int(dims[0]) if len(dims) else 0)


def grid(values, scale: float, offset: int):
    """floor(scale * c) + offset as integers."""
    import numpy as np

    x = np.floor(scale * values)
    if x.size and not np.abs(x).max() + abs(offset) <= 1 << 52:
        raise ValueError("an entry lies beyond 2^52 on the grid")
    return x.astype(np.int64) + offset


def _sums(rows: DataFrame, scale: float, offset: int) -> tuple[int, list]:
    """(n, exact sum of each dimension)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n, high, low = 0, None, None
        for batch in batches:
            _, values = usable(batch.column(0))
            if not len(values):
                continue
            if values.shape[1] > MAX_DIM:
                raise ValueError(f"vectors of {values.shape[1]} entries, more than {MAX_DIM}")
            x = grid(values, scale, offset)
            if high is None:
                high, low = np.zeros((2, x.shape[1]), np.int64)
            if len(high) != x.shape[1]:
                raise ValueError(f"vectors of different lengths: {len(high)} and {x.shape[1]}")
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & (1 << 26) - 1).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low), pa.array([n] * len(high))],
                                             names=["dim", "high", "low", "n"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    parts = rows.mapInArrow(partial, "dim long, high long, low long, n long")
    found = parts.groupBy("dim").agg(F.sum(wide("high") * (1 << 26) + wide("low")).alias("s"), F.sum("n").alias("n")).collect()
    found = sorted((r["dim"], int(r["s"]), r["n"]) for r in found)  # at most MAX_DIM rows
    if not found:
        return 0, []
    if len({n for _, _, n in found}) > 1:
        raise ValueError(f"vectors of different lengths, up to {len(found)}")
    return found[0][2], [s for _, s, _ in found]


def _covariance(rows: DataFrame, centred, d: int, n: int):
    """Sum over the rows of the products of centred entries, over ``n``; ``centred`` makes a matrix of a column."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros((d, d))
        for batch in batches:
            block = centred(batch.column(0))
            total += block.T @ block
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                         names=["i", "j", "v"])
    import numpy as np

    parts = rows.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = parts.toArrow()  # at most MAX_DIM * (MAX_DIM + 1) / 2 rows
    out = np.zeros((d, d))
    i, j, v = (table.column(c).to_numpy() for c in range(3))
    out[i, j] = out[j, i] = v / n
    return out


def whiten(df: DataFrame, components: int = 32, scale: float = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened) of every usable row, and the fitted :class:`Whitening`.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2; entry k of ``whitened`` is the centred row
    projected on component k over the root of its eigenvalue."""
    spark = df.sparkSession
    source = df.select(id_column(df, id_col).cast("long").alias("id"), id_column(df, vector_col).alias("vector"))
    vectors = source.select("vector")
    n, sums = _sums(vectors, scale, offset)
    if not n:
        return spark.createDataFrame([], PROJECTED), Whitening()
    d = len(sums)
    import numpy as np

    whole = np.array([s // n for s in sums], np.int64)
    left = [s % n for s in sums]
    part = np.array([r / n for r in left])

    def centred(column):
        """x - S / n: the integer part of the mean is taken off exactly, then its fraction."""
        _, values = usable(column)
        return (grid(values.reshape(-1, d), scale, offset) - whole) - part
    covariance = _covariance(vectors, centred, d, n)
    values, directions = leading_components(covariance, components)
    model = Whitening(n, sums, values.tolist(), directions, float(np.trace(covariance)))
    k = len(values)
    if not k:
        return spark.createDataFrame([], PROJECTED), model
    basis = directions / np.sqrt(values)

    def deviations(x):
        near = np.abs(x).max(initial=0) + 1
        if (n * int(near)) ** 2 * d < 1 << 63:
            y = x * n - np.array(left, np.int64)
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
        y = x.astype(object) * n - np.array(left, object)
        return pa.array([int(v) for v in (y * y).sum(1)], pa.decimal128(38, 0))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = usable(batch.column(1))
            x = grid(rows.reshape(-1, d), scale, offset) - whole
            out = pa.array(((x - part) @ basis).ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), deviations(x), pa.ListArray.from_arrays(ends, out)],
                                             names=["id", "deviation", "whitened"])
    out = materialise(source.mapInArrow(projected, PROJECTED), "whitened")
    flat = out.select("whitened")
    means = np.array(flat.select(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first())

    def around_means(column):
        return column.flatten().to_numpy().reshape(-1, k) - means
    model.identity_error = float(np.abs(_covariance(flat, around_means, k, n) - np.eye(k)).max())
    return out, model


def whitened_rows(df: DataFrame, components: int = 32, **columns) -> DataFrame:
    """:func:`whiten` in long form, one row per vector and component, with the fit's numbers beside them."""
    rows, model = whiten(df, components, **columns)
    explained = F.array(*[F.lit(v) for v in model.explained]).cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", explained[F.col("k")].alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
