"""Embedding whitening by shifted CholeskyQR (operator 12).

The centred vectors are the rows of a tall matrix A. Each pass sums the Gram matrix of the rows over the cluster, a
d x d matrix whose Cholesky factor R makes the rows nearly orthonormal by a triangular solve. The first pass adds a
small shift to the diagonal, so that the factor exists whatever the condition of A; later passes add one only where
the factor does not exist. Passes go on until the Gram matrix is the identity to ``NEAR``, mostly two. The product of
the factors is the R of A, found without ever squaring its condition: the singular values of R, squared and divided by
n, are the eigenvalues of the covariance, its right singular vectors the components. A shift multiplies eigenvalues
by 1 + 1e-12 or so and leaves the eigenvectors as they are.

Rows are integers (a fixed-point grid), so sums and centred rows n * x - S are exact. A task adds up one d x d matrix
for all rows it reads and gives it away as d rows; those are added by row number, ``MERGE`` tasks at a time, so neither
a task nor the driver ever sees more than d x d numbers of some hundred tasks (d at most ``MAX_DIM``, else it raises).

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; repeated rows and null ids
count and are returned like any other. Vectors of different lengths raise, and so do entries outside of the grid's 53
bits. Directions in which the rows do not vary (an eigenvalue below ``NULL`` of the largest) are no components, so one
row, equal rows, vectors without entries and an empty table give no components and an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MAX_DIM = 4096
MERGE = 256
NEAR, NULL, PASSES = 1e-6, 1e-22, 6
UNIT = np.finfo(float).eps / 2
PARTIAL = "i int, part int, line binary"


@dataclass(frozen=True)
class Whitening:
    """Fitted components: ``vectors`` are the columns, unit length; ``variances`` their eigenvalues, falling."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.variances]


def on_grid(embeddings: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(vec_id, x) of the rows that remain, x on the integer grid; their number and their length."""
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    far = F.exists("embedding", lambda c: F.abs(c.cast("double")) * SCALE > float(2**52))
    x = F.when(far, F.raise_error(F.lit("an entry lies outside of the grid"))).otherwise(whole)
    rows, seen = scratch.save_counted(
        embeddings.select("vec_id", "embedding").filter(fine).select("vec_id", x.cast("array<bigint>").alias("x")), "grid",
        F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"))
    if seen["n"] and seen["least"] != seen["most"]:
        raise ValueError(f"vectors of {seen['least']} and of {seen['most']} entries")
    if seen["n"] and seen["most"] > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} entries")
    return rows, seen["n"], seen["most"] or 0


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums_of(rows: DataFrame, d: int) -> np.ndarray:
    """The exact sum of each dimension; raises if one does not fit 64 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            # below 2^53 each, so some hundred rows at a time fit 64 bits
            x = matrix(batch, d)
            for at in range(0, len(x), 512):
                total = [a + int(b) for a, b in zip(total, x[at:at + 512].sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "total": pa.array(total, pa.int64())})

    found = rows.select("x").mapInArrow(run, "i int, total long").groupBy("i").agg(F.sum("total").alias("total"))
    return np.array([r["total"] for r in found.orderBy("i").collect()], dtype=np.int64)  # d rows


def exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in 64 bits where that is safe and else as Python integers."""
    reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    return n * x - sums if reach < 2**62 else n * x.astype(object) - sums.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return exact(x, n, sums).astype(float) / n


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows q with q R = a, by forward substitution over the columns of the upper triangular factor."""
    q = rows.copy(order="F")
    for j in range(factor.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ factor[:j, j]
        q[:, j] /= factor[j, j]
    return q


def gram(rows: DataFrame, d: int, width: int, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix (width x width) of all rows after ``change``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch, d)
            for at in range(0, len(x), 4096):
                a = change(x[at:at + 4096])
                total += a.T @ a
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width), pa.int32()), "part": pa.array([part] * width, pa.int32()),
            "line": pa.array([line.tobytes() for line in total], pa.binary())})

    def add(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("part")  # so that reruns add in the same order
        total = np.zeros(width)
        for line in lines["line"]:
            total += np.frombuffer(line)
        return pd.DataFrame({"i": lines["i"].iloc[:1], "part": lines["part"].iloc[:1], "line": [total.tobytes()]})

    lines = rows.select("x").mapInArrow(run, PARTIAL)
    lines = lines.groupBy("i", F.floor(F.col("part") / MERGE).alias("some")).applyInPandas(add, PARTIAL)
    lines = lines.groupBy("i").applyInPandas(add, PARTIAL).orderBy("i").collect()  # width rows
    found = np.array([np.frombuffer(r["line"]) for r in lines]).reshape(-1, width)
    return (found + found.T) / 2 if len(found) else np.zeros((width, width))


def upper_factor(g: np.ndarray, shifted: bool) -> np.ndarray:
    """The upper triangular R with R'R = g, plus a shift on the diagonal if asked for or needed."""
    d = len(g)
    shift = 11 * d * (d + 1) * UNIT * max(np.linalg.eigvalsh(g)[-1], np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(rows: DataFrame, n: int, d: int, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of all ``rows`` (vec_id, x)."""
    sums = sums_of(rows, d) if n and d else np.zeros(d, dtype=np.int64)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    if not n or not d:
        return none
    factors: list[np.ndarray] = []

    def change(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, sums)
        for factor in factors:
            q = solve_rows(q, factor)
        return q

    while True:
        g = gram(rows, d, d, change)
        if not factors and not np.trace(g) > 0:
            return none  # all rows are equal
        values = np.linalg.eigvalsh(g)
        # a direction that four shifted passes have not lifted to length 1 has no length
        ready = np.abs(values - 1) <= NEAR
        ready = ready.all() or (len(factors) >= 4 and (ready | (values <= NEAR)).all())
        factors.append(upper_factor(g, shifted=not factors))
        if factors[1:] and ready:
            break
        if len(factors) > PASSES:
            raise ArithmeticError(f"not orthonormal after {PASSES} passes")
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    _, lengths, right = np.linalg.svd(r)
    variances = lengths**2 / n
    kept = int((variances > NULL * variances[0]).sum())
    kept = min(kept, components)
    vectors = right[:kept].T
    # the sign is free: the largest entry of a component is positive, so that reruns agree
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return Whitening(n, sums, vectors * sign, variances[:kept], float(variances.sum()), len(factors))


def project(model: Whitening, x: np.ndarray) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.vectors / np.sqrt(model.variances))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, over all rows."""
    d, k = model.vectors.shape
    if not k:
        return 0.0

    def change(x: np.ndarray) -> np.ndarray:
        return np.hstack([project(model, x), np.ones((len(x), 1))])

    g = gram(rows, d, k + 1, change) / model.n
    return float(np.abs(g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): the squared length of n * x - S, exact, and the row's whitened components."""
    d = model.vectors.shape[0]
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, d)
            off = exact(x, model.n, model.sums)
            if d * int(np.abs(off).max(initial=0)) ** 2 >= 2**62:
                off = off.astype(object)  # Python integers; what does not fit 64 bits raises below
            y = project(model, x)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], pa.array((off * off).sum(axis=1).tolist(), pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(y.shape[1], 1), dtype=np.int32), y.ravel())], schema=schema)

    if not model.vectors.shape[1]:
        return rows.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("deviation"),
                                    F.array().cast("array<double>").alias("whitened"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(embeddings: DataFrame) -> DataFrame:
    """A row for each remaining vector (vec_id, embedding) and component: the whitened value beside what the model says."""
    scratch = Scratch(embeddings.sparkSession)
    rows, n, d = on_grid(embeddings, scratch)
    model = fit(rows, n, d)
    error = identity_error(rows, model)
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
