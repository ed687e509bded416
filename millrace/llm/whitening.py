"""Whitening of embeddings by principal components from a matrix-free Jacobi-Davidson iteration.

Entries become integers ``floor(64 * c) + 1000000``, so means and deviations are exact. The fit list holds each distinct vector
once and is written packed, as blocks of rows. The covariance is never formed: a product with it is one pass over the blocks, in
which each task multiplies its centred rows with a block of vectors, transposes back and returns one small matrix.

The iteration keeps an orthonormal search space and the products of its vectors. Each round it takes the Ritz pairs of the space
(Rayleigh-Ritz), locks the leading ones whose residuals are at double precision, and widens the space by one correction per
unlocked wanted pair: the correction equation, projected against locked and current Ritz vectors, is solved for all pairs in
lockstep by MINRES, a distributed product per inner step. A space beyond ``SPACE`` times the wanted number is restarted from
its best Ritz vectors. At the end the locked vectors are multiplied afresh and taken through a last Rayleigh-Ritz step.

What reaches the driver is bounded by the dimension: sums, and products of dimension times block width per task, added up by Spark.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; of several lengths the most
frequent one counts, the longer of equally frequent ones, and rows of other lengths are dropped; equal vectors and repeated rows each
get their result, but count once in the fit; components with no variance (e at most 1e-12 of the largest) are not returned, so a fit
list of one vector gives no rows; equal eigenvalues leave the choice of vectors within their space to the start, which is fixed; a
deviation beyond 64 bits is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Vectors beyond the wanted ones in the first space, and the largest space as a multiple of the wanted number.
SPARE, SPACE = 4, 4
INNER_STEPS, MOST_ROUNDS, SEED = 5, 60, 5
#: Rows of one packed block.
BLOCK_ROWS = 4_096
#: Components below this share of the largest eigenvalue have no variance.
NO_VARIANCE = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


# -- Jacobi-Davidson ------------------------------------------------------------------------------


def minres(apply: Product, shifts: np.ndarray, project: Product, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of ``P (A - shift) P x = right``, one column each, in lockstep.

    A column stops once its residual has fallen to the share ``enough``, or when its Krylov space is exhausted.
    """
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    x, v, v_old = np.zeros_like(right), right / start, np.zeros_like(right)
    w = w_old = np.zeros_like(right)
    eta, live = beta.copy(), beta > 0
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    coupling = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        at = np.flatnonzero(live)
        u = np.zeros_like(v)
        u[:, at] = apply(v[:, at])
        u = project(u - v * shifts)
        alpha = (v * u).sum(axis=0)
        u = u - v * alpha - v_old * coupling
        following = np.linalg.norm(u, axis=0)
        diagonal = c * alpha - c_old * s * coupling
        first = np.sqrt(diagonal**2 + following**2)
        second, third = s * alpha + c_old * c * coupling, s_old * coupling
        live &= first > 0
        safe = np.where(first > 0, first, 1.0)
        w_new = (v - w_old * third - w * second) / safe
        c_new, s_new = diagonal / safe, following / safe
        x = x + np.where(live, c_new * eta, 0.0) * w_new
        eta = np.where(live, -s_new * eta, eta)
        live &= (np.abs(eta) > enough * beta) & (following > 1e-14 * start)
        v_old, v = v, u / np.where(following > 0, following, 1.0)
        w_old, w, c_old, c, s_old, s, coupling = w, w_new, c, c_new, s, s_new, following
    return x


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to the bases and to each other; those that add nothing are left out."""
    kept = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in (*bases, kept):
                column = column - basis @ (basis.T @ column)
        rest = np.linalg.norm(column)
        if rest > 1e-10:
            column = column / rest
            for basis in (*bases, kept):
                column = column - basis @ (basis.T @ column)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept


def jacobi_davidson(apply: Product, size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator and their unit vectors, falling.

    Residuals end at ``4 * size * eps`` times the largest eigenvalue. If rounding in the products keeps them from it, the
    iteration ends once the whole space has been searched or after ``MOST_ROUNDS`` rounds with what it has.
    """
    wanted = min(wanted, size)
    rng = np.random.default_rng(SEED)
    locked, locked_products = np.zeros((size, 0)), np.zeros((size, 0))
    space = _orthonormal(rng.normal(size=(size, min(size, wanted + SPARE))))
    products = apply(space)
    for _ in range(MOST_ROUNDS):
        small = space.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        space, products = space @ turns, products @ turns
        largest = max(abs(values[0]) if len(values) else 0.0, *np.abs((locked * locked_products).sum(axis=0)), 0.0)
        aim = 4 * size * np.finfo(float).eps * largest
        open_pairs = min(wanted - locked.shape[1], len(values))
        residuals = products[:, :open_pairs] - space[:, :open_pairs] * values[:open_pairs]
        residuals -= locked @ (locked.T @ residuals)
        fine = np.linalg.norm(residuals, axis=0) <= aim
        done = open_pairs if fine.all() else int(np.argmin(fine))
        locked, locked_products = np.column_stack([locked, space[:, :done]]), np.column_stack([locked_products, products[:, :done]])
        space, products, values, residuals = space[:, done:], products[:, done:], values[done:], residuals[:, done:]
        open_pairs -= done
        if not open_pairs:
            break
        if space.shape[1] + open_pairs > max(SPACE * wanted, wanted + SPARE):  # restart from the best Ritz vectors
            keep = open_pairs + wanted
            space, products, values = space[:, :keep], products[:, :keep], values[:keep]
        ritz = np.column_stack([locked, space[:, :open_pairs]])

        def project(x: np.ndarray, ritz: np.ndarray = ritz) -> np.ndarray:
            x = x - ritz @ (ritz.T @ x)
            return x - ritz @ (ritz.T @ x)

        corrections = minres(apply, values[:open_pairs], project, -project(residuals), INNER_STEPS, 1e-3)
        new = _orthonormal(corrections, locked, space)
        if not new.shape[1]:  # the corrections lie in the space: the whole space, or one whose rounding is reached
            new = _orthonormal(rng.normal(size=(size, open_pairs)), locked, space)
            if not new.shape[1]:
                locked = np.column_stack([locked, space[:, :open_pairs]])
                break
        space, products = np.column_stack([space, new]), np.column_stack([products, apply(new)])
    else:
        locked = np.column_stack([locked, space[:, : wanted - locked.shape[1]]])
    basis = _orthonormal(locked)
    small = basis.T @ apply(basis)
    values, turns = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ turns)[:, ::-1]


# -- over Spark -----------------------------------------------------------------------------------


def integer_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``x`` of the rows that take part, on built-in functions."""
    whole = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(vector_col, lambda c: (F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(OFFSET)).cast("long"))
    rows = table.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(whole)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def usual_length(vectors: DataFrame) -> int:
    sizes = vectors.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.orderBy(F.desc("rows"), F.desc("length")).first()
    return found.length if found else 0


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def packed(vectors: DataFrame, dimension: int) -> DataFrame:
    """The fit list: each distinct vector once, as blocks of rows of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dimension)
            blocks = [x[i : i + BLOCK_ROWS].astype("<i8").tobytes() for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["rows"])

    return materialise(vectors.select("x").distinct().mapInArrow(run, "rows binary"))


class FitList:
    """Distributed passes over the packed fit list."""

    def __init__(self, blocks: DataFrame, dimension: int):
        self.blocks, self.dimension = blocks, dimension
        sums = self._summed(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), exact=True)
        self.n, self.sums = (int(sums[0]), [int(s) for s in sums[1:]]) if len(sums) else (0, [])

    def _summed(self, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
        """Sum over all blocks of a small array each; a task adds up its own, Spark those of the tasks.

        The driver's share is bounded by dimension times block width. Integers are summed as such.
        """
        dimension, kind = self.dimension, "bigint" if exact else "double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for rows in batch.column(0):
                    own = part(np.frombuffer(rows.as_buffer(), dtype="<i8").reshape(-1, dimension))
                    total = own if total is None else total + own
            if total is not None:
                flat = total.reshape(-1)
                columns = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "value"])

        parts = self.blocks.mapInArrow(run, f"place int, value {kind}")
        value = F.sum(F.col("value").cast("decimal(38,0)")) if exact else F.sum("value")
        found = {r.place: r.value for r in parts.groupBy("place").agg(value.alias("value")).collect()}
        return np.array([found[i] for i in range(len(found))], dtype=object if exact else float)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows minus the mean: the exact integer n * x - S, divided by n."""
        n, sums = self.n, self.sums
        # Per dimension the mean is split into a whole part and a rest below n, so nothing large is multiplied.
        whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
        return lambda x: (x - whole) - rest / n

    def product(self) -> Product:
        centred, n = self.centred(), self.n

        def apply(vectors: np.ndarray) -> np.ndarray:
            if not vectors.shape[1]:
                return np.zeros_like(vectors)

            def part(x: np.ndarray) -> np.ndarray:
                y = centred(x)
                return y.T @ (y @ vectors)

            return self._summed(part).reshape(vectors.shape) / n

        return apply

    def trace(self) -> float:
        centred = self.centred()
        return float(self._summed(lambda x: (centred(x) ** 2).sum(axis=0)).sum()) / self.n

    def identity_error(self, turn: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
        centred, k = self.centred(), turn.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ turn
            return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

        found = self._summed(part) / self.n
        mean, square = found[:k], found[k:].reshape(k, k)
        return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


_SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double"
)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: its whitened coordinate, the component's share of the trace, and the exact deviation."""
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vector_col)
    dimension = usual_length(vectors)
    vectors = vectors.filter(F.size("x") == dimension)
    if not dimension:
        return spark.createDataFrame([], _SCHEMA)
    fit = FitList(packed(vectors, dimension), dimension)
    trace = fit.trace()
    if not trace > 0:
        return spark.createDataFrame([], _SCHEMA)
    values, axes = jacobi_davidson(fit.product(), dimension, components)
    kept = values > NO_VARIANCE * values[0]
    values, axes = values[kept], axes[:, kept]
    turn = axes / np.sqrt(values)
    error, k = fit.identity_error(turn), len(values)
    n, sums, centred = fit.n, fit.sums, fit.centred()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            rows = len(x)
            y = centred(x)
            whitened = y @ turn
            deviation = exact_deviation(x, y)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, dtype=np.int64)),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                pa.array(whitened.reshape(-1)),
                pa.array(np.tile(values / trace, rows)),
                pa.array(np.full(rows * k, error)),
                pa.array(np.tile(values, rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

    def exact_deviation(x: np.ndarray, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2: in 64 bits where it fits by far, else in whole numbers of any size."""
        rough = (y**2).sum(axis=1) * float(n) ** 2
        largest = max(float(np.abs(x).max(initial=0)) * n, float(max(map(abs, sums))))
        if largest < 2**62 and rough.max(initial=0) < 2**62:
            return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [d if d < 2**63 else None for d in exact]

    return vectors.mapInArrow(run, _SCHEMA)
