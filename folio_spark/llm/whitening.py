"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation of the centred rows, with full reorthogonalisation.

A is the matrix of centred rows. One distributed pass a step gives both products: a task forms its rows' part of
u = A v and of A'u at once, and the sums of all tasks meet by place. No vector as long as the table exists anywhere: every
earlier u is A p for a short vector p, so a task rebuilds its rows of all of them from what it reads, and the pass also
sums their products with the new u, which take what isn't orthogonal out of it. The v stay on the driver: they, the p and
the bidiagonal matrix have as many numbers as the dimension squared, however many rows there are. The singular vectors
of the small bidiagonal matrix turn the v into components; its singular values are the deviations (times sqrt(n)).
By default there are as many steps as dimensions, so components with equal deviations are found too (a step that
ends in nothing goes on from a new direction).

Entries c become whole numbers floor(scale * c) + shift; sums are exact, and a row is centred as (n x - S) / n.

Defined results: rows whose vector is null, empty or holds null or non-finite entries, or entries beyond 2^30 in size, take
no part, nor do vectors of another length than the most frequent one (of ties the longer); null and repeated ids and
repeated rows are rows of their own; a direction without deviation is no component, so equal rows, a single row and
an empty table give no rows; components of equal deviation are any orthonormal ones of their space; a sum of squares
that no long holds is null; columns beyond id and vector play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Entries of at most this size take part (a table of 2^22 such rows still has exact sums).
LARGEST = float(1 << 30)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitener:
    """components: a column each, by falling variance; explained: their shares of the whole variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in Python's integers where 64 bits don't hold it."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, int(max(map(abs, self.sums.tolist()), default=0)))
        return x * self.n - self.sums if most < 1 << 62 else x.astype(object) * self.n - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.exact(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] > LONG:
            d = d.astype(object)
        return [int(s) if s <= LONG else None for s in (d * d).sum(axis=1)]


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """The rows that take part, written as (id, x), and the length of their vectors (0: there are none)."""
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    whole = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    fit = materialize(whole.select(F.col(id_col).alias("id"), x.alias("x")), "vectors")
    found = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (fit.where(F.size("x") == found["d"]), found["d"]) if found else (fit, 0)


def _matrix(batch: pa.RecordBatch, d: int, at: int = 1) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def gathered(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """part's vectors of all batches, summed by place: within a task first, then by Spark."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = part(_matrix(b, d))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    sums = fit.mapInArrow(of_task, f"i int, x {kind}").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row for each place of a short vector
    return np.array([r["x"] for r in sorted(sums, key=lambda r: r["i"])])


class Bidiagonal:
    """The steps: v, w = A'u and p (u = A p) as columns, alpha and beta. step(p) gives A'u, the products of the earlier u with
    u, and u'u, of u = A p."""

    def __init__(self, d: int, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], seed: int = 1):
        self.d, self.step, self.random = d, step, np.random.default_rng(seed)
        self.v, self.w, self.p = (np.zeros((d, 0)) for _ in range(3))
        self.alpha: list[float] = []
        self.beta: list[float] = []  # beta[j] stands right of alpha[j]
        self.largest = 0.0

    def _apart(self, x: np.ndarray) -> np.ndarray:
        """x without its part along the v so far; twice is enough."""
        for _ in range(2):
            x = x - self.v @ (self.v.T @ x)
        return x

    def _fresh(self) -> np.ndarray:
        x = self._apart(self.random.standard_normal(self.d))
        return x / np.linalg.norm(x)

    def run(self, steps: int) -> None:
        v = self._fresh()
        for j in range(steps):
            self.v = np.column_stack([self.v, v])
            p = v - (self.beta[-1] * self.p[:, -1] if j else 0)
            for _ in range(2):
                w, with_earlier, square = self.step(p, self.p)
                p, w = p - self.p @ with_earlier, w - self.w @ with_earlier
                left = square - with_earlier @ with_earlier
                if left > 0.5 * square:  # else most of u was along the earlier ones: once more
                    break
            alpha = float(np.sqrt(max(left, 0.0)))
            self.largest = max(self.largest, alpha)
            if alpha <= self.d * np.finfo(float).eps * self.largest:
                alpha, p, w = 0.0, np.zeros(self.d), np.zeros(self.d)
            else:
                p, w = p / alpha, w / alpha
            self.alpha.append(alpha)
            self.p, self.w = np.column_stack([self.p, p]), np.column_stack([self.w, w])
            if j + 1 == steps:
                return
            rest = self._apart(w - alpha * v)
            beta = float(np.linalg.norm(rest))
            self.largest = max(self.largest, beta)
            if beta <= self.d * np.finfo(float).eps * self.largest:
                beta, v = 0.0, self._fresh()
            else:
                v = rest / beta
            self.beta.append(beta)

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Right singular vectors (columns) and singular values of A, by falling value."""
        b = np.diag(self.alpha) + np.diag(self.beta, 1)
        _, values, q = np.linalg.svd(b)
        return self.v @ q.T, values


def fit_whitener(fit: DataFrame, d: int, k: int = 8, steps: int | None = None) -> Whitener | None:
    """The first k components of the rows of fit (id, x). steps: fewer than d where only far-apart leading components are
    wanted of long vectors."""
    if not d:
        return None
    sums = gathered(fit, d, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = int(sums[-1]), sums[:-1]
    centre = Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))

    def step(p: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(x: np.ndarray) -> np.ndarray:
            a = centre.centred(x)
            u = a @ p
            return np.concatenate([a.T @ u, (a @ earlier).T @ u, [u @ u]])

        got = gathered(fit, d, part)
        return got[:d], got[d:-1], float(got[-1])

    lanczos = Bidiagonal(d, step)
    lanczos.run(min(d, steps or d))
    components, values = lanczos.components()
    variances = values**2 / n
    total = float(gathered(fit, d, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]) / n
    found = int((values > d * np.finfo(float).eps * lanczos.largest).sum()) if total > 0 else 0
    kept = min(k, found)
    components, variances = components[:, :kept], variances[:kept]
    lead = np.abs(components).argmax(axis=0) if kept else np.zeros(0, int)
    components = components * np.sign(components[lead, np.arange(kept)])
    return Whitener(n, sums, components, variances, variances / total if kept else np.zeros(0))


def identity_error(fit: DataFrame, d: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; their mean is zero, as n x - S adds up to 0."""
    k = len(w.variances)

    def part(x: np.ndarray) -> np.ndarray:
        z = w.whitened(x)
        return (z.T @ z).ravel()

    return float(np.abs(gathered(fit, d, part).reshape(k, k) / w.n - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    fit, d = prepared(rows, id_col, vector_col, scale, shift)
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit_whitener(fit, d, k)
    if w is None or not len(w.variances):
        return rows.sparkSession.createDataFrame([], schema)
    error, found = identity_error(fit, d, w), len(w.variances)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, d)
            at = pa.array(np.repeat(np.arange(len(x)), found))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * found, w.n, np.int64)),
                    pa.array(w.deviation(x), pa.int64()).take(at),
                    pa.array(w.whitened(x).ravel()),
                    pa.array(np.tile(w.explained, len(x))),
                    pa.array(np.full(len(x) * found, error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.mapInArrow(each, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
