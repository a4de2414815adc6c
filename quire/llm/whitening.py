"""Whitening of embeddings: unit eigenvectors of their covariance, refined in mixed precision.

*Covariance.* Vectors become whole numbers (a grid of ``scale`` steps a unit), so sums are
exact whatever the order of partitions.  One pass sums every dimension; a second
one multiplies the vectors less the whole part of their mean and adds the products up in
whole numbers; what the fraction of the mean adds is put right on the driver.  Each task
gives one row for each pair of dimensions, and these are grouped sums.

*Eigenvectors.* The d by d covariance is a model, not data.  It is solved in float32
and corrected by the iteration of Ogita and Aishima in extended precision: from
R = I - X'X and S = X'AX come new eigenvalues and a correction X(I + E), with
quadratic convergence.  Eigenvalues too close for a division by their
difference form a cluster; its small matrix X'(A - mI)X, shifted by its mean
m, is solved by itself, which turns the vectors inside the cluster, and the iteration goes on.

*Result.* A third pass measures the covariance of the whitened vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 52  # grid steps beyond which an entry is held at the edge
LIMIT = 60  # iterations, several times what even nested clusters need
_LOW = (1 << 26) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``mean`` holds the whole part of each dimension's mean and ``rest`` what n times it lacks of the sum."""

    n: int
    dim: int
    mean: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    components: np.ndarray  # one unit vector a column
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int = SCALE
    offset: int = OFFSET


def grid_vectors(column: pa.Array, dim: int | None = None, scale: int = SCALE, offset: int = OFFSET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of whole numbers) of the usable vectors of a list column, one for each length met, or for length ``dim`` alone.

    Vectors that are null or empty or hold null or non-finite entries are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    row = np.repeat(np.arange(len(lengths)), lengths)
    usable = (lengths > 0) & (np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) == 0)
    for n in [dim] if dim is not None else np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == n))
        if len(rows) and n:
            with np.errstate(over="ignore"):
                steps = np.clip(np.floor(scale * values[np.isin(row, rows)]), -LARGEST, LARGEST)
            yield rows, steps.astype(np.int64).reshape(len(rows), int(n)) + offset


def _sums(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """(dim, k, n, high, low): for each length of vectors and each dimension the number and the sum of its entries, in two parts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in grid_vectors(batch.column(0), None, scale, offset):
                s = held.setdefault(x.shape[1], [0, 0, 0])
                s[0] += len(x)
                s[1] = s[1] + (x >> 26).sum(0)
                s[2] = s[2] + (x & _LOW).sum(0)
        for dim, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], ["dim", "k", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return vectors.mapInArrow(summed, "dim long, k long, n long, high long, low long").groupBy("dim", "k").agg(wide("n"), wide("high"), wide("low"))


def _products(vectors: DataFrame, dim: int, scale: int, offset: int, mapped) -> tuple[np.ndarray, np.ndarray]:
    """Sums and products of ``mapped`` of all vectors: at most d (d + 3) / 2 rows a task and in the end."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = products = None
        for batch in batches:
            for _, x in grid_vectors(batch.column(0), dim, scale, offset):
                y = mapped(x)
                total, products = (y.sum(0), y.T @ y) if total is None else (total + y.sum(0), products + y.T @ y)
        if total is not None:
            i, j = np.triu_indices(len(total))
            i, j = np.concatenate([i, np.full(len(total), -1)]), np.concatenate([j, np.arange(len(total))])
            v = np.concatenate([products[np.triu_indices(len(total))], total])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])

    rows = vectors.mapInArrow(multiplied, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    i, j, v = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy()
    size = int(j.max()) + 1
    m, s = np.zeros((size, size)), np.zeros(size)
    pair = i >= 0
    m[i[pair], j[pair]] = m[j[pair], i[pair]] = v[pair]
    s[j[~pair]] = v[~pair]
    return s, m


def clusters(close: np.ndarray) -> list[np.ndarray]:
    """Sets of two or more indices linked by ``close``, a symmetric matrix of booleans."""
    label = np.arange(len(close))
    while True:
        low = np.minimum(label, np.where(close, label[None, :], len(close)).min(1))
        if (low == label).all():
            return [np.flatnonzero(label == c) for c in np.unique(label) if (label == c).sum() > 1]
        label = low


def refined_eigenvectors(a: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix by falling value, correct to double precision.

    Of exactly equal eigenvalues any orthonormal basis is given.  The entry of largest size of each vector is positive.
    """
    wide = np.longdouble
    d = len(a)
    size = np.abs(a).max(initial=0)
    if size == 0:
        return np.zeros(d), np.eye(d)
    a = a.astype(wide) / wide(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    eye, tiny = np.eye(d, dtype=wide), wide(np.finfo(wide).eps)
    own = np.eye(d, dtype=bool)
    kind, best = float, np.inf  # double precision does for the first steps
    for _ in range(limit):
        y, b = x.astype(kind), a.astype(kind)
        r, s = eye - y.T @ y, y.T @ (b @ y)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would spoil orthogonality
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        delta = 2 * (np.linalg.norm(s - np.diag(value)) + np.linalg.norm(a) * np.linalg.norm(r))
        close = (np.abs(gap) <= delta) & ~own
        e = np.where(close | own, r / 2, (s + value[None, :] * r) / np.where(gap == 0, 1, gap))
        x = x + (x.astype(kind) @ e.astype(kind))
        for j in clusters(close):
            part, z = x[:, j], x[:, j].astype(kind)
            gram = z.T @ z
            small = z.T @ (b @ z) - value[j].mean() * gram
            scale = np.abs(small).max()
            if scale > d * tiny:  # else equal to the last digit: every basis will do
                turn = np.linalg.eigh(((small + small.T) / 2 / scale).astype(float))[1]
                x[:, j] = part @ turn.astype(wide)
        change = float(max(np.abs(e).max(), np.abs(r).max()))
        if kind is float:
            kind = wide if change < 1e-10 or change >= best / 2 else float
        else:  # inside a cluster the products left say how far its vectors may still turn
            mixed = float(np.abs(np.where(close, s, 0)).max()) > 8 * d * tiny
            if not mixed and (change <= 8 * tiny * d or (change < 1e-16 and change >= best / 2)):
                break
        best = min(best, change)
    value = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-value, kind="stable")
    value, x = value[order], x[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, -1, 1)
    return (value * size).astype(float), x.astype(float)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    return ((x - model.mean) - model.rest / model.n) @ (model.components / np.sqrt(model.values))


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The model of all usable vectors of ``df``: of the most frequent length, of two equally frequent lengths the larger.

    An entry c counts as floor(scale * c) + offset, steps beyond 2^52 as 2^52.  At most ``components`` components are kept, and only
    those whose variance is above rounding (d * 2^-52 of the largest): vectors that fill fewer dimensions cannot be
    whitened in more.  Without usable vectors, or with equal ones only, the model has no component.
    """
    vectors = df.select(F.col(vector).alias("v"))
    sums = written(_sums(vectors, scale, offset), "sums")
    top = sums.where("k = 0").orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()
    if not top:
        none = np.zeros(0)
        return Whitening(0, 0, none, none, np.zeros((0, 0)), np.zeros((0, 0)), none, none, 0.0, scale, offset)
    dim, n = top[0]["dim"], int(top[0]["n"])
    total = [(int(r["high"]) << 26) + int(r["low"]) for r in sums.where(F.col("dim") == dim).orderBy("k").collect()]
    mean, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)

    _, m = _products(vectors, dim, scale, offset, lambda x: (x - mean).astype(float))
    part = rest.astype(np.longdouble) / n
    cov = m.astype(np.longdouble) / n - np.outer(part, part)
    values, x = refined_eigenvectors(cov)
    trace = float(np.trace(cov))
    k = min(components, int((values > dim * 2.0**-52 * max(values[0], 0)).sum()))
    model = Whitening(n, dim, mean, rest, cov.astype(float), x[:, :k], values[:k], values[:k] / trace if trace else values[:k], 0.0, scale, offset)
    if not k:
        return model
    s, m = _products(vectors, dim, scale, offset, lambda v: _whitened(model, v))
    error = np.abs(m / n - np.outer(s / n, s / n) - np.eye(k)).max()
    return Whitening(**(model.__dict__ | {"identity_error": float(error)}))


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """Exact sums over dimensions of (n * x - sum)^2, as n^2 yy - 2n yr + rr with y = x - mean and r = rest."""
    y, n, r = x - model.mean, model.n, model.rest
    rr = sum(int(v) ** 2 for v in r)
    edge = int(np.abs(y).max(initial=0)) + 1
    if model.dim * edge * max(edge, n) >= 1 << 62:
        y, r = y.astype(object), r.astype(object)
    yy, yr = (y * y).sum(1), (y * r).sum(1)
    if 4 * model.dim * (n * edge) ** 2 < 1 << 62:
        return pa.array(n * n * yy - 2 * n * yr + rr).cast(pa.decimal128(38, 0))
    exact = (n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(yy, yr, strict=True))
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitening") -> DataFrame:
    """``df`` with a struct ``out``, which replaces a column of that name: deviation decimal(38,0) and whitened array<double>.

    ``out`` is null for a vector that is null, holds null or non-finite entries or has another length than the
    model; deviation is the exact sum of (n * x - sum of x)^2 over dimensions, null from 10^38 on.
    """
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
    def whitened(column: pa.Array) -> pa.Array:
        size = len(column)
        for rows, x in grid_vectors(column, model.dim, model.scale, model.offset):
            w = np.ascontiguousarray(_whitened(model, x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            found = pa.StructArray.from_arrays([_deviations(model, x), lists], fields=list(kind))
            at = np.full(size, -1)
            at[rows] = np.arange(len(rows))
            return found.take(pa.array(at, mask=at < 0))
        return pa.nulls(size, kind)

    keep = [c for c in df.columns if c != out]
    if not model.values.size:
        return df.select(*keep, F.lit(None).cast("struct<deviation:decimal(38,0),whitened:array<double>>").alias(out))
    return df.select(*keep, whitened(F.col(vector)).alias(out))


def components_of(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = whiten(df.select(F.col(key), F.col(vector).alias("__vector")), model, "__vector", "__w")  # posexplode leaves out what is null
    share = F.lit([float(v) for v in model.explained]).cast("array<double>")
    rows = rows.select(F.col(key), F.col("__w.deviation").alias("deviation"), F.posexplode("__w.whitened").alias("__at", "whitened"))
    return rows.select(
        key, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("__at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
