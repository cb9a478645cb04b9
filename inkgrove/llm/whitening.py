"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Vectors are put on a grid (``x``, whole multiples of 1 / 256), so that counts, sums and
deviations are exact.  The matrix Y of the distinct centred vectors stays distributed: a
step makes one pass over it for the products Yq and Y'(Yq).  Left vectors are never stored,
u = Yp holds with one short vector p for each; every step makes its left vector orthogonal
to all earlier ones by inner products taken in the same pass, and its right vector on the
driver.  The singular values of the small bidiagonal matrix give components and deviations.

Steps end when the leading triplets stand to rounding and the variance that no triplet
explains is too small to hide another one; at the latest, there is one for each dimension.
The driver holds vectors and matrices of the dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.llm.common import map_batches, stored

#: Residual of a triplet, against the largest singular value and its distance to the next.
CONVERGED = 1e-14
#: A variance below this share of the largest one is rounding.
NULL = 1e-13
LOW = (1 << 32) - 1


def on_grid(rows: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector is whole, with ``x``, the floor of ``scale`` times each entry, in its place.

    Rows with a null vector, or with a null, infinite or not-a-number entry, go.  Entries
    beyond a long's range are set to its end.
    """
    c = F.col(f"`{column}`")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    kept = [F.col(f"`{k}`") for k in rows.columns if k not in (column, "x")]
    return rows.where(c.isNotNull() & ~bad).select(*kept, x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    full = np.zeros((len(sizes), width), np.int64)
    full[np.arange(width) < sizes[:, None]] = flat
    return full


def _summed(vectors: DataFrame, per_batch, kind: str) -> dict[int, int | float]:
    """Sums over all rows of what ``per_batch`` gives for a batch, by position.

    Tasks add up what they read; Spark sums one row for each position.
    """
    number = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = per_batch(batch.column(0))
                total = found if total is None else total + found
        if total is not None:
            arrays = [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, number)]
            yield pa.RecordBatch.from_arrays(arrays, ["at", "value"])

    summed = vectors.mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    return {r["at"]: r["value"] for r in summed.collect()}


@dataclass(frozen=True)
class Vectors:
    """The distinct vectors, their number, width and exact sums."""

    rows: DataFrame
    n: int
    width: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def total(self, function) -> np.ndarray:
        """Sum of ``function(centred rows)``, an array, over all vectors."""
        mean, width = self.mean, self.width
        found = _summed(self.rows, lambda column: function(matrix(column, width) - mean), "double")
        return np.array([found[i] for i in range(len(found))])


def fit_list(gridded: DataFrame) -> Vectors:
    """Every distinct ``x`` once."""
    rows = stored(gridded.select("x").distinct(), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = width or 0

    def halves(column: pa.Array) -> np.ndarray:
        x = matrix(column, width)
        return np.concatenate([(x >> 32).sum(axis=0), (x & LOW).sum(axis=0)])

    found = _summed(rows, halves, "long") if n and width else {}
    return Vectors(rows, n, width, tuple((found[i] << 32) + found[width + i] for i in range(width) if found))


def bidiagonalise(vectors: Vectors, wanted: int, trace: float, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the centred vectors, and right vectors as columns."""
    width, random = vectors.width, np.random.default_rng(seed)
    right = np.empty((width, 0))  # v, orthonormal
    left, images = np.empty((width, 0)), np.empty((width, 0))  # p with u = Yp, and Y'u
    small = np.empty((0, 0))  # u' Y v: bidiagonal, in blocks if a start is renewed
    beta, linked = 0.0, False
    tiny = 1e-14 * np.sqrt(trace)
    v = orthogonal(random.standard_normal(width), right)
    while True:
        q = v - beta * left[:, -1] if linked else v

        def products(y: np.ndarray, q=q, left=left) -> np.ndarray:
            yq, u = y @ q, y @ left
            return np.concatenate([u.T @ yq, [yq @ yq], y.T @ yq])

        found = vectors.total(products)
        k = left.shape[1]
        along, norm, image = found[:k], found[k], found[k + 1 :]
        alpha = np.sqrt(max(norm - along @ along, 0.0))
        right = np.column_stack([right, v])
        small = np.pad(small, ((0, 0), (0, 1)))
        if linked:
            small[-1, -1] = beta
        linked = alpha > tiny
        if linked:
            left = np.column_stack([left, (q - left @ along) / alpha])
            images = np.column_stack([images, (image - images @ along) / alpha])
            small = np.pad(small, ((0, 1), (0, 0)))
            small[-1, -1] = alpha
            rest = images[:, -1] - right @ (right.T @ images[:, -1])
            rest -= right @ (right.T @ rest)
            beta = float(np.linalg.norm(rest))
            linked = beta > tiny
        u, values, vt = np.linalg.svd(small)
        if right.shape[1] == width or _settled(values, u, beta if linked else 0.0, trace, wanted):
            break
        v = orthogonal(rest if linked else random.standard_normal(width), right)
    basis = np.linalg.qr(right @ vt.T[:, :wanted])[0]
    return values[:wanted], basis


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vector along what the basis leaves of ``v``."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
        v = v / np.linalg.norm(v)
    return v


def _settled(values: np.ndarray, u: np.ndarray, beta: float, trace: float, wanted: int) -> bool:
    """Whether the leading triplets stand and no other can be as large."""
    if not len(values):
        return trace == 0
    if trace - values @ values < NULL * trace:
        return True
    if len(values) <= wanted:
        return False
    gaps = np.abs(np.diff(values))[:wanted]
    apart = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
    residual = beta * np.abs(u[-1, :wanted])
    return bool((residual <= CONVERGED * apart).all()) and trace - values @ values < values[wanted - 1] ** 2


@dataclass(frozen=True)
class Whitening:
    """Count, exact sums, components as columns, their variances, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows ``x``."""
        return project(x - np.array([s / self.n for s in self.sums]), self.components, self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sums) squared of every row, exact; none if beyond a long."""
        largest = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if x.shape[1] * largest**2 < 2.0**62 else object
        moved = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(d) if d < 1 << 63 else None for d in (moved * moved).sum(axis=1)]


def project(centred: np.ndarray, components: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return centred @ components / np.sqrt(variances)


def fit(gridded: DataFrame, components: int = 4) -> Whitening:
    """Whitening of rows with ``x``: at most ``components``, those with any variance.

    Covariances are over the distinct vectors, with their number as divisor.  Without rows,
    or with one vector only, there are no components.  Shorter vectors count as ending in
    zeros.  Of components with equal variances any basis is right.
    """
    vectors = fit_list(gridded)
    none = Whitening(vectors.n, vectors.sums, np.empty((vectors.width, 0)), np.empty(0), 0.0, 0.0)
    if vectors.n < 2 or not vectors.width:
        return none
    trace = float(vectors.total(lambda y: np.array([np.square(y).sum()]))[0])
    if trace == 0:
        return none
    values, basis = bidiagonalise(vectors, components, trace)
    n = vectors.n
    kept = values**2 > NULL * values[0] ** 2 if len(values) else np.empty(0, bool)
    variances, basis = values[kept] ** 2 / n, basis[:, : len(values)][:, kept]
    size = len(variances)

    def spread(y: np.ndarray) -> np.ndarray:
        w = project(y, basis, variances)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = vectors.total(spread) / n
    mean, second = found[:size], found[size:].reshape(size, size)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max())
    return Whitening(n, vectors.sums, basis, variances, trace / n, error)


RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(rows: DataFrame, column: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each row with a whole vector (see ``on_grid``) and each component, from 1 on.

    ``n`` counts the distinct vectors; ``deviation`` is the squared length of n x less the
    sums, null if a long can't hold it; ``whitened`` the coordinate; ``explained`` the
    component's share of the variance; ``identity_error`` how far the whitened vectors'
    covariance is from the identity.  Components without variance have no rows, so an empty
    table, or one with a single distinct vector, gives none.  Repeated rows get equal results;
    other columns pass through, those named like a result are replaced.
    """
    kept = [c for c in rows.columns if c not in (column, "x", *RESULTS)]
    gridded = on_grid(rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`")), column)
    found = fit(gridded, components)
    shares, width = found.variances / (found.trace or 1.0), len(found.sums)
    size = len(shares)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not size:
            return
        x = matrix(batch.column("x"), width)
        n = len(x)
        again = batch.take(pa.array(np.repeat(np.arange(n), size)))
        arrays = [
            pa.array(np.tile(np.arange(1, size + 1), n), pa.int32()),
            pa.array(np.full(n * size, found.n), pa.int64()),
            pa.array(found.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), size))),
            pa.array(found.apply(x).ravel()),
            pa.array(np.tile(shares, n)),
            pa.array(np.full(n * size, found.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays([*(again.column(c) for c in kept), *arrays], [*kept, *RESULTS])

    added = zip(RESULTS, (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()))
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in added)])
    return map_batches(gridded, run, schema)
