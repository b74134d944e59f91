"""Whitening of embeddings with eigenvectors refined from single precision.

One pass adds up the integer vectors exactly, one adds up the products of the
centred vectors inside the tasks that hold them; what reaches the driver is one
matrix of the vectors' width. Its eigenvectors are found in float32 and corrected
by the matrix-multiplication iteration of Ogita and Aishima in extended precision.
Eigenvalues that the present error bound cannot tell apart form a cluster; its
subspace is solved on its own, shifted by the cluster's centre, before the
iteration goes on. A last map projects every row.

Rows whose vector is null or holds null or non-finite components are left out;
every other row counts, also with a null or repeated id. A shorter vector counts
as ending in zeros; entries times ``scale`` must fit a long. Components with an
eigenvalue that is zero within rounding are not returned (constant or dependent
dimensions, a single row), so an empty or constant table gives an empty result.
Other columns are not read. The driver holds a few square matrices of the
vectors' width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.knn import matrix, usable
from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

#: Rounds of refinement at most; the error is squared in each, so a few suffice.
ROUNDS = 30


@dataclass(frozen=True)
class Fit:
    """Row count, exact sums, covariance, and all eigenpairs by falling eigenvalue (vectors in columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def rank(self) -> int:
        """Number of eigenvalues above zero, within rounding."""
        return int((self.values > len(self.values) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)).sum())


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``id`` and ``v``: floor(scale * entry) + shift of every usable vector, all of one width."""
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")) + F.lit(shift))
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), whole.alias("v"))
    width = rows.agg(F.max(F.size("v"))).head()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("v"))))


def exact_sums(rows: DataFrame, column: str = "v") -> list[int]:
    """The column sums of integer vectors, by position."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                small = int(np.abs(v).max(initial=0)) < (1 << 62) // batch.num_rows
                added = v.sum(axis=0).tolist() if small else v.astype(object).sum(axis=0).tolist()
                total = [a + b for a, b in zip(total, added, strict=True)] if total else added
        if total:
            sums = pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), sums], names=["pos", "s"])

    parts = rows.select(column).mapInArrow(partial, "pos int, s decimal(38,0)")
    return [int(r["s"]) for r in sorted(parts.groupBy("pos").agg(F.sum("s").alias("s")).collect())]  # a row per dimension


def centred(v: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """Rows minus the mean, as doubles; the mean's whole part is taken off in integers first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (v - whole).astype(float) - rest


def summed_products(rows: DataFrame, column: str, sums: list[int] | None, n: int) -> np.ndarray:
    """Sum over rows of d d' divided by n, d being a row of integers less its mean, or as it is without ``sums``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                d = v if sums is None else centred(v, sums, n)
                total = d.T @ d + (0.0 if total is None else total)
        if total is not None:
            at = pa.array(range(len(total)), pa.int32())
            yield pa.record_batch([at, pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select(column).mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    cells = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # width x width
    size = 1 + max((c["i"] for c in cells), default=-1)
    out = np.zeros((size, size))
    for c in cells:
        out[c["i"], c["j"]] = c["x"] / n
    return (out + out.T) / 2


def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues, each within ``width`` of the next one by size."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refined_eigenpairs(v: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix: float32 start, extended-precision refinement."""
    size, scale = len(v), float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(size), np.eye(size)
    a = v.astype(np.longdouble) / np.longdouble(scale)
    one = np.eye(size, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm, tiny = float(np.linalg.norm(a.astype(float), 2)), 8 * size * float(np.finfo(np.longdouble).eps)
    values = np.zeros(size, np.longdouble)
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding must not reach the symmetric part of the step, which is r
        values = np.diag(s) / (1 - np.diag(r))
        away = s - np.diag(values)
        width = 2 * (float(np.linalg.norm(away.astype(float))) + norm * float(np.linalg.norm(r.astype(float))))
        mixed = [c for c in clusters(values, width) if np.abs(away[np.ix_(c, c)]).max() > tiny * norm]
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > width
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ step
        for c in mixed:
            part = x[:, c]
            centre = values[c].mean()
            inner = part.T @ (a @ part) - centre * (part.T @ part)
            inner = (inner + inner.T) / 2
            unit = np.abs(inner).max()
            if unit > 0:
                x[:, c] = part @ np.linalg.eigh((inner / unit).astype(float))[1].astype(np.longdouble)
        if not mixed and max(float(np.abs(r).max()), float(np.abs(away).max()) / norm) <= tiny:
            break
    for _ in range(3):  # eigenvalues that differ by little more than rounding turn their vectors in every round: make them orthogonal at the end
        x = x + x @ (one - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * np.longdouble(scale)).astype(float), x[:, order].astype(float)


def fit(rows: DataFrame) -> Fit:
    """The eigenpairs of the covariance of integer vectors ``v``."""
    n = rows.count()
    sums = exact_sums(rows) if n else []
    covariance = summed_products(rows, "v", sums, n) if sums else np.zeros((0, 0))
    return Fit(n, sums, covariance, *refined_eigenpairs(covariance))


def deviations(v: np.ndarray, model: Fit) -> pa.Array:
    """Sum over dimensions of (n * x - sum)**2 of every row, exact."""
    largest = max((abs(s) for s in model.sums), default=0) + model.n * int(np.abs(v).max(initial=0))
    kind = np.int64 if v.shape[1] * largest**2 < 1 << 63 else object
    d = model.n * v.astype(kind) - np.array(model.sums, kind)
    return pa.array([Decimal(int(x)) for x in (d * d).sum(axis=1)], pa.decimal128(38, 0))


def whiten(
    vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000
) -> tuple[DataFrame, Fit, float]:
    """Per usable row: id, ``deviation`` and ``whitened`` (an array, one entry per component); the fit; the identity error.

    The identity error is the largest entry of the whitened rows' covariance less the identity, measured on the rows.
    """
    rows = write_stage(integers(vectors, id_col, vector_col, scale, shift), "whitening-rows")
    model = fit(rows)
    k = min(components, model.rank)
    axes = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1)).reshape(batch.num_rows, -1)
                white = centred(v, model.sums, model.n) @ axes
                columns = [batch.column(0), deviations(v, model), pa.array(white.tolist(), pa.list_(pa.float64()))]
                yield pa.record_batch(columns, names=["id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["id"]
    out = write_stage(rows.mapInArrow(projected, f"id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    error = float(np.abs(summed_products(out, "whitened", None, model.n) - np.eye(k)).max()) if k else 0.0
    return out.withColumnRenamed("id", id_col), model, error


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, folder: str) -> DataFrame:
    """The first eight whitened components of every usable vector; ``deviation`` must fit a long."""
    rows, model, error = whiten(table(spark, folder, "embeddings"))
    total = float(np.trace(model.covariance))
    share = [float(e) / total for e in model.values[: min(8, model.rank)]]
    shares = F.array(*[F.lit(x) for x in share]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
