"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the n centred rows, the method makes orthonormal v_1, v_2 ... (one value a dimension) and u_1, u_2 ... (one value a
row) with X v_k = b_(k-1) u_(k-1) + a_k u_k and X' u_k = a_k v_k + b_k v_(k+1). The small matrix of the a (diagonal) and b
(above it) has the singular values of X; its right vectors turn the v into the components. Both families are fully
reorthogonalised. u_k is never stored row by row: it is X w_k for a w_k of one value a dimension, and one job over the
rows gives the product X w, its inner products with all earlier u and the product X'(X w) as sums over tasks. What the
driver holds is square in the dimension at most and does not depend on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import work

SCALE, SHIFT = 64, 1_000_000  # fixed values: an entry c stands as floor(64 c) + 1,000,000
LARGEST = 2.0**50
BLOCK = 2048
CONVERGED, NOTHING = 1e-15, 1e-12


@dataclass
class Fit:
    """The fit list: ``table`` of distinct vectors ``x``, their number, sums and least and largest entry of each dimension."""

    table: DataFrame
    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)


@dataclass
class Whitening:
    """``components`` (one column each), their eigenvalues ``e`` and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    e: np.ndarray
    trace: float
    steps: int


def scaled(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: vectors as whole numbers. Rows go whose vector is null or empty, holds a null, an entry that is not finite
    or one beyond 2^50, or has another length than most vectors have (of two lengths as frequent the smaller one counts)."""
    entry = lambda c: c.cast("double")
    fine = lambda c: F.coalesce(F.abs(entry(c)) <= LARGEST, F.lit(False)) & ~F.isnan(entry(c))
    sound = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(F.col("_vector").isNotNull() & (F.size("_vector") > 0)).where(F.forall("_vector", fine))
    usual = sound.groupBy(F.size("_vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = usual[0]["size"] if usual else 0
    x = F.transform("_vector", lambda c: F.floor(entry(c) * SCALE).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    return sound.where(F.size("_vector") == size).select(F.col("_key").alias(key), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(vectors: DataFrame) -> Fit:
    """The distinct vectors of ``scaled``, written once, with exact sums; equal vectors meet after each task thinned its own."""
    table = work.written(vectors.select("x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = least = most = None
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(batch.column("x")[0]))
            n += len(x)
            parts = (x >> 24).sum(0).tolist(), (x & (2**24 - 1)).sum(0).tolist(), x.min(0), x.max(0)
            if high is None:
                high, low, least, most = parts
            else:
                high, low = [[a + b for a, b in zip(p, q, strict=True)] for p, q in ((high, parts[0]), (low, parts[1]))]
                least, most = np.minimum(least, parts[2]), np.maximum(most, parts[3])
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(least), pa.array(most)], names=["i", "n", "high", "low", "least", "most"])

    found = table.mapInArrow(sums, "i int, n bigint, high bigint, low bigint, least bigint, most bigint").groupBy("i")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = found.agg(F.sum("n").alias("n"), *exact, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    return Fit(table, rows[0]["n"] if rows else 0, [int(r["high"]) * 2**24 + int(r["low"]) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows])


def _numerators(x: np.ndarray, n: int, sums: list[int], small: bool) -> np.ndarray:
    """n x - S, exact: in 64 bits where they suffice, else as Python's numbers."""
    if small:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _small(f: Fit) -> bool:
    return f.n * max(map(abs, [*f.least, *f.most]), default=0) < 2**62


def _summed(f: Fit, size: int, of_block) -> np.ndarray:
    """Sum over all rows of ``of_block(centred rows)``, an array of ``size`` numbers."""
    n, sums, small, dim = f.n, f.sums, _small(f), f.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("x").slice(at, BLOCK), dim)
                total += of_block(_numerators(x, n, sums, small).astype(np.float64) / n)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "value"])

    out = np.zeros(size)
    for row in f.table.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row["i"]] = row["value"]
    return out


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def bidiagonalise(f: Fit, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The v (rows) and the small matrix, after as many steps as the ``wanted`` largest singular values need."""
    random = np.random.default_rng(20)
    dim = f.dim
    scale = math.sqrt(_summed(f, 1, lambda c: np.array([(c * c).sum()]))[0])
    vs: list[np.ndarray] = []
    ws: list[np.ndarray] = []  # u_k = X w_k; a zero w has no u
    backs: list[np.ndarray] = []  # X' u_k
    a: list[float] = []
    b: list[float] = []
    v = _orthogonal(random.standard_normal(dim), vs)
    v /= np.linalg.norm(v)
    beta = 0.0
    while True:
        w = v - beta * ws[-1] if ws else v
        vs.append(v)
        while True:  # once, unless much of it lay along earlier u
            stack = np.column_stack([w, *ws])

            def block(c, stack=stack):
                p = c @ stack
                return np.concatenate([c.T @ p[:, 0], p.T @ p[:, 0]])

            found = _summed(f, dim + stack.shape[1], block)
            back, square, along = found[:dim], found[dim], found[dim + 1 :]
            w = w - sum((g * x for g, x in zip(along, ws, strict=True)), np.zeros(dim))
            back = back - sum((g * x for g, x in zip(along, backs, strict=True)), np.zeros(dim))
            if square <= (NOTHING * scale) ** 2 or (along @ along) <= 1e-6 * square:
                break
        alpha = math.sqrt(max(square - along @ along, 0.0))
        if alpha <= NOTHING * scale:
            alpha, w, back = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, back = w / alpha, back / alpha
        a.append(alpha)
        ws.append(w)
        backs.append(back)
        k = len(vs)
        if k == dim:
            break
        v = _orthogonal(back, vs) if alpha else np.zeros(dim)
        beta = float(np.linalg.norm(v))
        if k >= wanted:
            small = np.diag(a) + np.diag(b, 1)
            left, values, _ = np.linalg.svd(small)
            if beta * np.abs(left[-1, :wanted]).max() <= CONVERGED * values[0] and (beta > NOTHING * scale or values[wanted - 1] > 0):
                break
        if beta <= NOTHING * scale:  # the v so far are closed under X'X: go on in what is orthogonal to them
            beta, v = 0.0, _orthogonal(random.standard_normal(dim), vs)
            v /= np.linalg.norm(v)
        else:
            v = v / beta
        b.append(beta)
    return np.array(vs), np.diag(a) + np.diag(b, 1), len(vs)


def train(f: Fit, components: int = 16) -> Whitening:
    """Eigenvectors of the covariance of the fit list, by falling eigenvalue; none for eigenvalues that are nothing.

    The entry of largest size of each component is positive. Equal eigenvalues: any orthonormal vectors of their space.
    One vector or none: no components.
    """
    none = Whitening(f.n, f.sums, np.zeros((f.dim, 0)), np.zeros(0), 0.0, 0)
    if f.n < 2:
        return none
    trace = _summed(f, 1, lambda c: np.array([(c * c).sum()]))[0] / f.n
    if trace <= 0:
        return none
    wanted = min(components, f.dim)
    vs, small, steps = bidiagonalise(f, wanted)
    _, values, right = np.linalg.svd(small)
    keep = [i for i in range(min(wanted, len(values))) if values[i] > 1e-10 * values[0]]
    vectors = vs.T @ right[keep].T
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    return Whitening(f.n, f.sums, vectors, values[keep] ** 2 / f.n, trace, steps)


def identity_error(f: Fit, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    r = len(model.e)
    if not r:
        return 0.0
    onto = model.components / np.sqrt(model.e)

    def block(c):
        z = c @ onto
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    found = _summed(f, r + r * r, block) / f.n
    return float(np.abs(found[r:].reshape(r, r) - np.outer(found[:r], found[:r]) - np.eye(r)).max())


def whiten(vectors: DataFrame, f: Fit, model: Whitening, key: str = "vec_id") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row of ``scaled`` and component.

    ``deviation`` is exact; beyond a 64-bit number it is null. Repeated rows and null keys come out as they are; no
    components: no rows.
    """
    error = identity_error(f, model)
    n, sums, small, dim, r = f.n, f.sums, _small(f), f.dim, len(model.e)
    bound = dim * max((max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(f.least, f.most, sums, strict=True)), default=0) ** 2
    onto = model.components / np.sqrt(model.e)
    explained = model.e / model.trace if r else model.e
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                numerators = _numerators(_matrix(batch.column("x"), dim), n, sums, small)
                exact = numerators if bound < 2**63 else numerators.astype(object)
                deviation = [None if x >= 2**63 else x for x in (exact * exact).sum(1).tolist()]
                z = (numerators.astype(np.float64) / n) @ onto
                rows = len(z)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(np.repeat(np.arange(rows), r))),
                        pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * r, n)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), r))),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * r, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = vectors if r else vectors.limit(0)
    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
