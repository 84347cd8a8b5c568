"""Embedding whitening by matrix-free block subspace iteration.

The covariance matrix is never formed. A pass multiplies it by a block of directions: tasks hold only their rows' sums of
Xᵀ(XQ) over centred rows, and Spark adds them up. After each pass a Rayleigh-Ritz step over the blocks kept so far gives
candidate components and their residuals for free, since the products of the kept blocks are known; the next block is
the QR of what the residuals still miss. Passes end when the residuals of all k components are down to rounding. Blocks
beyond KEEP are folded into the best directions, so the driver holds a few thin matrices whatever the number of rows.

Centring is exact: n * x - S in integers, one division at the end. The fit list holds each distinct vector once.

Results: rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of another
length than the most frequent one (of equally frequent lengths the longer counts). Null and repeated ids keep their rows.
Entries beyond 2^60 are held at it, and a deviation beyond 64 bits is null. Components without variance are left out, so
n distinct vectors give at most n - 1; a single one, or an empty table, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import ROWS, stored

#: Directions carried beyond the k wanted ones, and blocks kept before they are folded.
OVER, KEEP = 16, 6
#: A residual counts as certified at this share of the largest eigenvalue, and passes end with an error after so many.
CERTIFIED, PASSES = 2e-14, 300
#: A component whose eigenvalue is under this share of the largest has no variance but rounding.
FLAT = 1e-12
LIMIT = 1 << 60


class Fit(NamedTuple):
    """Distinct vectors' count and sums, eigenvalues and unit columns, residuals, trace, and the whitened identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float


def integers(df: DataFrame, embedding: str, scale: int, shift: int) -> DataFrame:
    """df's usable rows with column __x: floor(scale * c) + shift of each entry."""
    v = F.col(embedding)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~bad).withColumn("__x", F.transform(v, lambda c: whole(c) + shift))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists of longs."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that holds it, else Python integers."""
    if max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (offsets(x, n, sums) / n).astype(np.float64)


def batches_of(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, matrix(part.column(at))


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their exact sums by dimension; high and low halves are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in batches_of(batches):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], names=["place", "high", "low", "n"])

    parts = fit.mapInArrow(run, "place long, high long, low long, n long").groupBy("place")
    rows = {r["place"]: r for r in parts.agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).collect()}
    return (rows[0]["n"] if rows else 0), [(rows[i]["high"] << 32) + rows[i]["low"] for i in range(d) if rows]


def multiply(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, in one pass over the fit list; V is the covariance matrix, which no one holds."""
    shared = fit.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total, squares = np.zeros(block.shape), 0.0
        for _, x in batches_of(batches):
            c = centred(x, n, sums)
            total += c.T @ (c @ block)
            squares += float((c * c).sum())
        out = np.append(total.ravel(), squares)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["place", "value"])

    rows = fit.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(q.size + 1)
    for r in rows:
        out[r["place"]] = r["value"]
    shared.destroy()
    return out[:-1].reshape(q.shape) / n, out[-1] / n


def fresh_directions(basis: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `wanted` adds to the orthonormal basis."""
    for _ in range(2):  # the second round removes what rounding left in the first
        size = np.linalg.norm(wanted, axis=0)
        wanted = wanted[:, size > 0] / size[size > 0]
        wanted = wanted - basis @ (basis.T @ wanted)
        wanted, r = np.linalg.qr(wanted[:, : basis.shape[0] - basis.shape[1]])
        wanted = wanted[:, np.abs(np.diag(r)) > 1e-10]
    return wanted - basis @ (basis.T @ wanted) if wanted.size else wanted


def subspace(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals) of the k largest, given only products with blocks."""
    k, p = min(k, d), min(d, k + OVER)
    block = np.linalg.qr(np.random.default_rng(11).standard_normal((d, p)))[0]
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    for _ in range(PASSES):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        h = basis.T @ image
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        vectors, moved = basis @ u[:, :p], image @ u[:, :p]
        rest = moved - vectors * e[:p]
        residuals = np.linalg.norm(rest, axis=0)[:k]
        scale = max(float(e[0]), 0.0)
        if (residuals <= CERTIFIED * scale).all() or basis.shape[1] == d:
            return e[:k], vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0), residuals
        if basis.shape[1] >= KEEP * p:
            basis, image = vectors, moved
        block = fresh_directions(basis, rest)
        if not block.size:  # the basis is invariant: nothing is missed
            return e[:k], vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0), residuals
    raise ArithmeticError(f"residuals {residuals} not certified after {PASSES} passes")


def fit_components(vectors: DataFrame, k: int) -> Fit | None:
    """Components of the distinct rows of column __x; None if no two rows differ."""
    lengths = vectors.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    fit = stored(vectors.where(F.size("__x") == d).select("__x").distinct(), "vectors")
    n, sums = column_sums(fit, d)
    traces: list[float] = []

    def product(q: np.ndarray) -> np.ndarray:
        out, trace = multiply(fit, n, sums, q)
        traces.append(trace)
        return out

    values, found, residuals = subspace(product, d, k)
    if n < 2 or traces[0] <= 0:
        return None
    kept = values > FLAT * values[0]
    values, found, residuals = values[kept], found[:, kept], residuals[kept]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    white = found / np.sqrt(values)
    error = np.abs(white.T @ product(white) - np.eye(len(values))).max()
    return Fit(n, sums, values, found, residuals, traces[0], float(error))


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, residual) of each usable row and component."""
    vectors = integers(df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")), "embedding", scale, shift).select("vec_id", "__x")
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    model = fit_components(vectors, k)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        white, width = m.vectors / np.sqrt(m.values), len(m.values)
        explained, residual = m.values / m.trace, m.residuals / m.values[0]
        for part, x in batches_of(batches, 1):
            far = offsets(x, m.n, m.sums)
            if float(np.abs(far.astype(np.float64)).max()) ** 2 * d < 2.0**62:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (sum(int(v) ** 2 for v in row) for row in far)]
            rows, repeat = len(x), np.repeat(np.arange(len(x)), width)
            columns = [
                part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)), pa.repeat(pa.scalar(m.n, pa.int64()), rows * width),
                pa.array(deviation, pa.int64()).take(pa.array(repeat)), pa.array(((far / m.n).astype(np.float64) @ white).ravel()), pa.array(np.tile(explained, rows)),
                pa.repeat(pa.scalar(m.identity_error), rows * width), pa.array(np.tile(residual, rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return vectors.where(F.size("__x") == d).mapInArrow(run, schema)
