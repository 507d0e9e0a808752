"""Whitening of vectors: unit principal directions, scaled to unit variance.

Entries are made whole numbers (``floor(scale * c) + shift``), so that counts and sums are exact. Then

1. each task centres its rows and reduces them, a block at a time, to one triangle by QR; triangles
   meet by sixteens until one is left (R'R is n times the covariance, which is never formed);
2. Householder reflections from both sides make R bidiagonal;
3. the dqds iteration (quotient-difference with shifts) finds its singular values to high relative
   accuracy, small ones included;
4. twisted factorisations of B'B - s^2 I, shifted at each value, give its singular vectors;
   vectors of a cluster are made orthogonal, a lost one is found again by inverse iteration.

Steps 2 to 4 see one triangle of the dimension of the vectors, whatever their number. The covariance
of the whitened rows is measured in a pass of its own and its error is returned with every row.

Rows whose vector is null, empty or holds a null or non-finite entry are dropped; a null id is kept.
Vectors of different lengths, and entries beyond a long, are errors. Repeated rows count each. Equal
variances: any orthonormal choice of directions. A direction without variance (fewer rows than
dimensions, constant entries) has ``whitened`` null and takes no part in the error; without any
variance ``explained`` is null. A deviation beyond a long is null. An empty table gives no rows.
Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import type_of
from wattline.llm.vectors import clean, dimension, matrix, whole

SCALE, SHIFT = 1024, 100_000
BLOCK_ROWS = 2048
FAN_IN = 16
TINY = 1e-290


# ---------------------------------------------------------------------- one triangle
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: r = U B V' with B upper bidiagonal: its diagonal, what is above it, and V."""
    a, n = r.astype(float).copy(), len(r)
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        h = x.copy()
        h[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(h)
        return h / size if size > 0 else None

    for k in range(n):
        if (h := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        if k < n - 2 and (h := mirror(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ h, h)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform with shift s; None if the shift was beyond the smallest value."""
    d, low, new_q, new_e = q[0] - s, q[0] - s, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(e[k] * ratio if top > 0 else 0.0)
        d = (d * ratio if top > 0 else q[k + 1]) - s
        low = min(low, d)
    return (new_q + [d], new_e, low) if d >= 0 else None


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    q, e, found = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], []
    stack = [(q, e, 0.0)]
    eps = np.finfo(float).eps
    while stack:
        q, e, base = stack.pop()
        low = 0.0
        for _ in range(200 * len(q) + 1):
            if len(q) == 1:
                found.append(base + q[0])
                break
            cut = next((k for k in range(len(e)) if e[k] <= eps**2 * (base + q[k]) or e[k] <= TINY), None)
            if cut is not None:
                stack += [(q[:cut + 1], e[:cut], base), (q[cut + 1:], e[cut + 1:], base)]
                break
            if q[0] * 1.5 < q[-1]:  # small values to the end, where they split off
                q, e = q[::-1], e[::-1]
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            tail = (a * c - b) / ((a + c) / 2 + np.sqrt(((a - c) / 2) ** 2 + b))  # smaller eigenvalue of the last block
            s, made = min(max(tail, 0.0), q[-1]), None
            for attempt in (0.99 * s, 0.5 * min(s, low) if low else 0.25 * s, 0.05 * s, 0.0):
                made = _sweep(q, e, attempt)
                if made is not None:
                    base += attempt
                    break
            q, e, low = made
        else:
            raise ArithmeticError("singular values did not converge")
    return np.array(sorted(found, reverse=True))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of B'B at ``value``, by the twisted factorisation with the smallest middle pivot."""
    n = len(diagonal)
    qq, ee, ab = diagonal**2, above**2, diagonal[:-1] * above
    guard = lambda x: x if abs(x) > TINY else TINY
    down, up = np.empty(n), np.empty(n)
    down[0], up[-1] = -value, qq[-1] - value
    plus, minus = np.empty(n), np.empty(n)
    for i in range(n - 1):
        plus[i] = guard(down[i] + qq[i])
        down[i + 1] = ee[i] / plus[i] * down[i] - value
    for i in range(n - 2, -1, -1):
        minus[i + 1] = guard(ee[i] + up[i + 1])
        up[i] = qq[i] / minus[i + 1] * up[i + 1] - value
    k = int(np.argmin(np.abs(down + up + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -ab[i] / plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -ab[i] / minus[i + 1] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size > 0 else np.eye(n)[k]


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix, falling, and its right singular vectors as columns."""
    n, size = len(r), np.abs(r).max(initial=0.0)
    if size == 0:
        return np.zeros(n), np.eye(n)
    d, u, v = bidiagonal(r / size)
    eps = np.finfo(float).eps
    u[np.abs(u) <= eps * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))] = 0.0
    values, vectors, start = [], [], 0
    for end in [*(np.flatnonzero(u == 0.0) + 1).tolist(), n]:  # an unreduced block has distinct values
        own_d, own_u = d[start:end], u[start:end - 1]
        dense = np.diag(own_d) + np.diag(own_u, 1)
        dense = dense.T @ dense
        got: list[np.ndarray] = []
        found = dqds(own_d, own_u)
        for j, x in enumerate(found):
            z = twisted(own_d, own_u, float(x))
            near = [got[i] for i in range(j) if found[i] - x <= 1e-3 * max(found[i], eps * found[0])]
            z = _orthogonal(z, near, dense, float(x), j)
            got.append(z)
        for x, z in zip(found, got, strict=True):
            long = np.zeros(n)
            long[start:end] = z
            values.append(x * size**2)
            vectors.append(v @ long)
        start = end
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order].T


def _orthogonal(z: np.ndarray, near: list[np.ndarray], dense: np.ndarray, value: float, seed: int) -> np.ndarray:
    """z without its part along ``near``; if little is left, inverse iteration from another start."""
    if not near:
        return z
    basis = np.array(near).T
    clear = lambda x: (y := x - basis @ (basis.T @ x)) - basis @ (basis.T @ y)
    left = clear(z)
    if np.linalg.norm(left) > 0.5:
        return left / np.linalg.norm(left)
    x = clear(np.random.default_rng(seed).standard_normal(len(z)))
    shifted = dense - (value + np.finfo(float).eps * max(abs(value), np.abs(dense).max())) * np.eye(len(z))
    for _ in range(4):
        x = clear(x / np.linalg.norm(x))
        x = clear(np.linalg.solve(shifted, x))
    return x / np.linalg.norm(x)


# ---------------------------------------------------------------------- all rows
@dataclass
class Whitening:
    n: int
    sums: list[int]  # of the whole-number entries, per dimension
    directions: np.ndarray  # dimension x components
    variances: np.ndarray
    trace: float
    scale: int
    shift: int

    def centred(self, raw: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S over n, and the sum of squares of n * x - S, exact."""
        x = whole(self.scale * raw) + self.shift
        reach = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if reach < 2**62:
            y = x * self.n - np.array(self.sums, dtype=np.int64)
            top = int(np.abs(y).max(initial=0))
            if top * top * x.shape[1] < 2**63:
                return y / self.n, (y * y).sum(axis=1).tolist()
        wide = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        exact = (wide * wide).sum(axis=1).tolist()
        return (wide / self.n).astype(float), [v if v < 2**63 else None for v in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, centred @ self.directions / np.sqrt(self.variances), np.nan)


def _sums(vectors: DataFrame, d: int, scale: int, shift: int) -> list[int]:
    def run(batches):
        total = [0] * d
        for b in batches:
            x = whole(scale * matrix(b.column("vector"), d)) + shift
            safe = int(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = [t + int(v) for t, v in zip(total, (x if safe else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([str(t) for t in total])], names=["dim", "total"])

    parts = vectors.select("vector").mapInArrow(run, "dim int, total string")
    got = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return [got[i] for i in range(d)]


def _triangle(vectors: DataFrame, d: int, base: Whitening) -> np.ndarray:
    """R of all centred rows: one triangle a task, then sixteen at a time."""
    def reduce(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
        return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")

    def run(batches):
        from pyspark import TaskContext

        r = None
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                r = reduce(r, base.centred(matrix(b.column("vector").slice(a, BLOCK_ROWS), d))[0])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int64()), pa.array([r.tobytes()], type=pa.binary())], names=["part", "r"])

    def meet(pdf):
        import pandas as pd

        r = None
        for raw in pdf.sort_values("part")["r"]:
            r = reduce(r, np.frombuffer(raw).reshape(-1, d))
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN_IN], "r": [r.tobytes()]})

    level = stable(vectors.select("vector").mapInArrow(run, "part long, r binary"))
    while level.count() > 1:
        level = stable(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(meet, "part long, r binary"))
    r = np.frombuffer(level.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _identity_error(vectors: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity."""
    k = int((model.variances > 0).sum())

    def run(batches):
        total = np.zeros((k, k + 1))
        for b in batches:
            w = model.whitened(model.centred(matrix(b.column("vector"), d))[0])[:, :k]
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    made = vectors.select("vector").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k, k + 1))
    for r in made.collect():  # components squared
        total[r["i"], r["j"]] = r["v"]
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit(vectors: DataFrame, components: int, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The model of the rows of ``vectors(vector array<double>)``; None if there is no row."""
    n, d = dimension(vectors, "vector")
    if n == 0:
        return None
    model = Whitening(n, _sums(vectors, d, scale, shift), np.zeros((d, 0)), np.zeros(0), 0.0, scale, shift)
    squares, directions = singular(_triangle(vectors, d, model))
    variances = np.maximum(squares / n, 0.0)
    variances[variances <= variances[0] * (d * np.finfo(float).eps) ** 2] = 0.0
    variances[n - 1:] = 0.0  # n centred rows span n - 1 dimensions at most
    k = min(components, d)
    model.directions, model.variances, model.trace = directions[:, :k], variances[:k], float(variances.sum())
    return model


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per usable row of ``df`` and component: id, component, n, deviation, whitened, explained, identity_error."""
    vectors = clean(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector")
    kind = type_of(vectors, "id")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components, scale, shift)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d, k = model.directions.shape
    error = _identity_error(vectors, d, model)
    explained = model.variances / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                s = b.slice(a, BLOCK_ROWS)
                y, deviation = model.centred(matrix(s.column("vector"), d))
                rows = s.num_rows
                yield pa.RecordBatch.from_arrays([
                    s.column("id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), type=pa.int32()),
                    pa.array(np.full(rows * k, model.n)), pa.array(deviation, type=pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(model.whitened(y).ravel(), from_pandas=True), pa.array(np.tile(explained, rows), from_pandas=True),
                    pa.array(np.full(rows * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
