"""Whitening of embeddings from the singular values of the centred rows, by a bidiagonal qd solver.

Tasks reduce their centred rows block by block to triangular factors (QR), which are stacked and reduced again until one is
left. Householder reflections make it bidiagonal; dqds finds the squared singular values to high relative accuracy; twisted
factorisations of the shifted bidiagonal product give their vectors, which the reflections carry back to the input's
dimensions. What reaches the driver has the size of dimensions times dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T
from flowspark.llm import vectors as V
from flowspark.llm.shared import written

EPS = np.finfo(np.float64).eps
#: Rows of a block that is reduced at once.
ROWS = 4096
#: Triangular factors that one task stacks.
FAN_IN = 32


# --- the bidiagonal solver ----------------------------------------------------------------
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and upper off-diagonal of Uᵀ R V, and V, by Householder reflections."""
    r = r.astype(np.float64, copy=True)
    d = r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w, 2 / (w @ w)

    for i in range(d):
        left = reflector(r[i:, i])
        if left is not None:
            w, t = left
            r[i:, i:] -= t * np.outer(w, w @ r[i:, i:])
        if i < d - 2:
            right = reflector(r[i, i + 1 :])
            if right is not None:
                w, t = right
                r[i:, i + 1 :] -= t * np.outer(r[i:, i + 1 :] @ w, w)
                v[:, i + 1 :] -= t * np.outer(v[:, i + 1 :] @ w, w)
    return np.diagonal(r).copy(), np.diagonal(r, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One differential qd transform with a shift: (q, e, smallest d, whether all stayed positive)."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least, good = d, d >= 0
    for i in range(n - 1):
        q2[i] = d + e[i]
        if q2[i] <= 0:
            return q, e, min(least, d), False
        ratio = q[i + 1] / q2[i]
        e2[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
        good = good and d >= 0
    q2[n - 1] = d
    return q2, e2, least, good


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal matrix with diagonal ``a`` and off-diagonal ``b``.

    The diagonal must not hold a zero.
    """
    q, e, done, total = a**2, b**2, [], 0.0
    floor = np.finfo(np.float64).tiny
    for _ in range(100 * len(a) + 100):
        n = len(q)
        if n == 0:
            break
        if n == 1:
            done.append(q[0] + total)
            break
        if e[-1] <= (EPS * 0.25) ** 2 * (total + q[-1]) or e[-1] <= floor:
            done.append(q[-1] + total)
            q, e = q[:-1], e[:-1]
            continue
        if n == 2 or e[-2] <= (EPS * 0.25) ** 2 * (total + q[-2]) or e[-2] <= floor:
            # two by two: both values at once, the smaller one as a product over the larger
            x, y, z = q[-2], q[-1], e[-1]
            s = x + y + z
            large = (s + np.sqrt(max((x - y + z) ** 2 + 4 * y * z, 0.0))) / 2
            done += [total + large, total + (x / large) * y]
            q, e = q[:-2], e[:-2]
            continue
        # a value below the least of the remaining matrix, from the last transform without shift; too large a one is cut
        shift = max(0.0, q[-1] - np.sqrt(q[-1] * e[-1])) * 0.98 if e[-1] < q[-1] else 0.0
        for _ in range(6):
            q2, e2, least, good = _dqds_step(q, e, shift)
            if good:
                break
            shift = max(0.0, shift + least) * 0.9 if shift + least > 0 else shift / 8
        else:
            shift = 0.0
            q2, e2, least, good = _dqds_step(q, e, shift)
        q, e, total = q2, e2, total + shift
        if q[0] < q[-1] / 4:  # small values belong at the end: turn the matrix over
            q, e = _turned(q, e)
    else:
        raise ArithmeticError("dqds did not converge")
    return np.sort(np.maximum(np.array(done), 0.0))[::-1]


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values from the other end: B by rows and columns in reverse is lower bidiagonal; one zero-shift step on its
    transpose's qd arrays keeps the product."""
    n = len(q)
    # J Bᵀ B J has pivots from the bottom: progressive qd gives the upper form
    p = q[-1]
    u, f = np.empty(n), np.empty(n - 1)
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p
        u[i + 1] = pivot
        f[i] = q[i] * e[i] / pivot
        p = q[i] * p / pivot
    u[0] = p
    return u[::-1].copy(), f[::-1].copy()


def twisted(a: np.ndarray, b: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """Unit vector of BᵀB for its eigenvalue ``value`` from the twisted factorisation with the (``skip``-th) least pivot."""
    n = len(a)
    tiny = EPS * EPS * max(value, (a**2).max())
    d, low = a**2, np.append(b / a[:-1], 0.0) if n > 1 else np.zeros(1)
    plus, up, s = np.empty(n), np.zeros(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        plus[i] = s[i] + d[i]
        if abs(plus[i]) < tiny:
            plus[i] = -tiny
        if i < n - 1:
            up[i] = d[i] * low[i] / plus[i]
            s[i + 1] = up[i] * low[i] * s[i] - value
    down, p = np.zeros(n), np.empty(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * low[i] ** 2 + p[i + 1]
        if abs(minus) < tiny:
            minus = -tiny
        t = d[i] / minus
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    twist = np.abs(s + p + value)
    r = int(np.argsort(twist, kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): all squared singular values of R, falling, and unit right vectors of the first ``count``, as columns."""
    d = r.shape[1]
    if not d or not r.any():
        return np.zeros(d), np.zeros((d, 0))
    a, b, v = bidiagonal(r)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)  # within the rounding of R itself
    b = np.where(np.abs(b) <= EPS * np.sqrt(np.abs(a[:-1] * a[1:])) / 16, 0.0, b) if d > 1 else b
    cuts = np.concatenate(([0], np.flatnonzero(b == 0) + 1, [d]))
    found = []  # (value, block start, block end)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        found += [(x, int(lo), int(hi)) for x in dqds(a[lo:hi], b[lo : hi - 1])]
    found.sort(key=lambda f: -f[0])
    values = np.array([f[0] for f in found])
    vectors = np.zeros((d, 0))
    for i, (value, lo, hi) in enumerate(found[:count]):
        near = [j for j in range(i) if found[j][1] == lo and abs(found[j][0] - value) <= 1e-3 * found[j][0]]
        for skip in range(hi - lo):
            z = np.zeros(d)
            z[lo:hi] = twisted(a[lo:hi], b[lo : hi - 1], value, skip)
            before = vectors[:, near]
            for _ in range(2):  # neighbours of a close cluster are made orthogonal
                z = z - before @ (before.T @ z)
            left = np.linalg.norm(z)
            if left > 0.1:
                break
        vectors = np.column_stack((vectors, z / max(left, 1e-300)))
    return values, v @ vectors


# --- over tables ----------------------------------------------------------------------------
class Whitener(NamedTuple):
    n: int  # rows of the fit list
    sums: np.ndarray  # of x, per dimension, exact
    directions: np.ndarray  # dimensions x components, divided by the deviation along each
    explained: np.ndarray  # share of the trace per component


def fit_list(df: DataFrame, vector_col: str, scale: int, offset: int, *kept: Column) -> DataFrame:
    """(kept..., x) of the rows with a usable vector; x holds floor(scale * component) + offset, packed."""
    T.bound_batches(df.sparkSession)
    rows = df.select(*kept, F.col(vector_col).cast("array<double>").alias("_v"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, values = V.usable(batch.column("_v"))
            x, ends = V.scaled(values, scale) + offset, np.cumsum(sizes)
            raw = pa.array([V.packed(x[e - s : e]) for e, s in zip(ends, sizes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in names], raw], names=[*names, "x"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], "x binary"]))


def _rows(batches: Iterator[pa.RecordBatch], width: int, offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of ROWS rows with their integer matrix; components that a shorter vector lacks stand for 0."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            x = V.stacked(some.column("x").to_pylist()).astype(np.int64)
            if x.shape[1] < width:
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=offset)
            sizes = np.array([len(r) - 1 for r in some.column("x").to_pylist()])
            if len(set(sizes.tolist())) > 1:
                kinds = np.array([np.dtype(V.INTS[r[0]]).itemsize for r in some.column("x").to_pylist()])
                x[np.arange(width)[None, :] >= (sizes // kinds)[:, None]] = offset
            yield some, x


def _totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, exact sum per dimension); a shorter vector's missing components are told by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, held = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for raw in (batch.column("x").to_pylist()[i : i + ROWS] for i in range(0, batch.num_rows, ROWS)):
                sizes = np.array([(len(r) - 1) // np.dtype(V.INTS[r[0]]).itemsize for r in raw])
                x = V.stacked(raw).astype(np.int64)
                width = max(len(sums), x.shape[1])
                sums, held = (np.pad(s, (0, width - len(s))) for s in (sums, held))
                sums[: x.shape[1]] += x.sum(axis=0)
                held += (sizes[:, None] > np.arange(width)).sum(axis=0)
                n += len(raw)
        dims = np.arange(-1, len(sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array(np.concatenate(([n], sums))), pa.array(np.concatenate(([n], held)))], names=["dim", "s", "held"]
        )

    got = rows.select("x").mapInArrow(run, "dim int, s long, held long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("held").alias("held")).orderBy("dim").collect()
    n = int(got[0]["s"]) if got else 0
    return n, np.array([[int(r["s"]), int(r["held"])] for r in got[1:]], np.int64).reshape(-1, 2)


def _factor(rows: DataFrame, n: int, sums: np.ndarray, offset: int) -> np.ndarray:
    """The triangular factor of all centred rows: blocks in each task, then the tasks' factors in a tree."""
    width = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, x in _rows(batches, width, offset):
            r = np.linalg.qr(np.vstack((r, (n * x - sums) / n)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for raw in batch.column("r").to_pylist():
                r = np.linalg.qr(np.vstack((r, np.frombuffer(raw).reshape(-1, width))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    factors = written(rows.select("x").mapInArrow(reduce_rows, "r binary"), "factors")
    left = factors.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        factors = factors.repartition(left).mapInArrow(reduce_factors, "r binary")
    r = np.zeros((0, width))
    for row in factors.collect():  # FAN_IN factors at most
        r = np.linalg.qr(np.vstack((r, np.frombuffer(bytes(row["r"])).reshape(-1, width))), mode="r")
    return np.vstack((r, np.zeros((width - len(r), width))))


def fit(rows: DataFrame, components: int, offset: int) -> Whitener:
    """The whitener of a ``fit_list`` table. Directions without variance (at rounding level) are left out."""
    n, told = _totals(rows)
    width = len(told)
    if not n or not width:
        return Whitener(n, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0))
    sums = told[:, 0] + (n - told[:, 1]) * offset
    values, vectors = right_vectors(_factor(rows, n, sums, offset), min(components, width))
    kept = int(np.count_nonzero(values[: vectors.shape[1]] > values[0] * (width * EPS) ** 2 * 64)) if values[0] > 0 else 0
    return Whitener(n, sums, vectors[:, :kept] / np.sqrt(values[:kept] / n), values[:kept] / values.sum() if kept else np.zeros(0))


def identity_error(rows: DataFrame, model: Whitener, offset: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    n, sums, directions = model.n, model.sums, model.directions
    c = directions.shape[1]
    if not c:
        return 0.0
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(c), np.zeros((c, c))
        for _, x in _rows(batches, width, offset):
            w = ((n * x - sums) / n) @ directions
            first += w.sum(axis=0)
            second += w.T @ w
        whole = np.vstack((first, second)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], names=["i", "v"])

    got = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    whole = np.array([r["v"] for r in got]).reshape(c + 1, c)
    return float(np.abs(whole[1:] / n - np.outer(whole[0], whole[0]) / n**2 - np.eye(c)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    x is floor(scale * entry) + offset, as long, the fit list all rows with a vector without null or non-finite entries;
    other rows are left out. ``deviation`` is the sum over dimensions of (n*x-S)^2, exact; ``whitened`` the centred row
    along a unit eigenvector of the covariance (divisor n), over the root of its eigenvalue; ``explained`` that eigenvalue's
    share of the trace; ``identity_error`` the largest absolute entry of the whitened covariance less the identity.
    Components are numbered from 1 by falling eigenvalue; those without variance are left out, so rows that are all equal,
    a single row and an empty table give none. Entries that a shorter vector lacks count as 0. Repeated rows count each, a
    null id stays null. A deviation that exceeds a long raises an error. Three passes over the rows run while the query is
    built: sums, factor, covariance.
    """
    rows = written(fit_list(df, vector_col, scale, offset, F.col(id_col).alias("vec_id")), "fit_list")
    model = fit(rows, components, offset)
    error = identity_error(rows, model, offset)
    n, sums, directions, explained = model
    width, c = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _rows(batches, width, offset):
            if not c:
                continue
            y = n * x - sums
            if width * np.abs(y).max(initial=0).astype(float) ** 2 >= 2.0**63:
                raise OverflowError("a deviation exceeds a long")
            deviation = (y * y).sum(axis=1)
            white, m = (y / n) @ directions, len(x)
            of = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("vec_id").take(of), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                    pa.array(np.repeat(deviation, c)), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
