"""Matrix operators over rows of feature vectors: scaling, principal and independent components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.keyed import free_name
from millrace.sources.workspace import materialize


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of each position."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """Replaces the vector by (x - mean) / std; no shuffle, the parameters are literals (one pair a feature)."""
        spread = [s or 1.0 for s in self.std]
        centred = F.zip_with(F.col(vector).cast("array<double>"), _literal(self.mean), lambda x, m: x - m)
        return df.withColumn(vector, F.zip_with(centred, _literal(spread), lambda x, s: x / s))


def fit_scaler(df: DataFrame, vector: str) -> Scaler:
    """Each position over the values it has: null vectors and null components do not count."""
    rows = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    stats = rows.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    return Scaler(tuple(r.m for r in stats), tuple(r.s for r in stats))


def moments(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance. Tasks emit one sum of outer products each; dim * dim values are summed.

    That is a row for each pair of positions and task, which suits some hundreds of positions, not many thousands. Vectors that are null, of another length or hold a null component are left out.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, dim)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    known = df.select(F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    sums = known.mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in sums:
        total[r.i] = r.x
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    return int(total[0, 0]), mean, total[1:, 1:] / n - np.outer(mean, mean)


@dataclass(frozen=True)
class Components:
    """Principal components, largest variance first; of each, the largest loading in absolute value is positive."""

    mean: np.ndarray
    loadings: np.ndarray
    ratio: np.ndarray

    def needed(self, share: float) -> int:
        """The least number of components that explain more than ``share`` of the variance."""
        return int(min(1 + (np.cumsum(self.ratio) <= share).sum(), len(self.ratio)))

    def transform(self, df: DataFrame, vector: str, k: int, out: str = "components") -> DataFrame:
        """Adds the first k components of every row; literals and array functions, no shuffle."""
        centred = F.zip_with(F.col(vector).cast("array<double>"), _literal(self.mean), lambda x, m: x - m)

        own = free_name(df, "centred", [out])

        def dot(row: np.ndarray) -> Column:
            products = F.zip_with(own, _literal(row), lambda x, y: x * y)
            return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

        return df.withColumn(own, centred).withColumn(out, F.array(*[dot(r) for r in self.loadings[:k]])).drop(own)

    def variance(self, spark: SparkSession) -> DataFrame:
        """(component from 1, ratio)."""
        return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(self.ratio)], "component int, ratio double")

    def loading_rows(self, spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
        """(component, pos, feature, loading): the transposed loading matrix in long form."""
        names = names or [f"f{i}" for i in range(self.loadings.shape[1])]
        rows = [(f"PC{c + 1}", p, names[p], float(x)) for c, row in enumerate(self.loadings) for p, x in enumerate(row)]
        return spark.createDataFrame(rows, "component string, pos int, feature string, loading double")


def fit_components(df: DataFrame, vector: str, dim: int) -> Components:
    """All principal components, from the covariance that the tasks sum up; only dim * dim numbers reach the driver."""
    _, mean, cov = moments(df, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    loadings, values = vectors[:, order].T, np.maximum(values[order], 0)
    loadings = loadings * np.sign(loadings[np.arange(dim), np.abs(loadings).argmax(axis=1)])[:, None]
    return Components(mean, loadings, values / max(values.sum(), np.finfo(float).tiny))


@dataclass(frozen=True)
class Sources:
    """Independent components: sources = unmixing @ (x - mean)."""

    mean: np.ndarray
    unmixing: np.ndarray
    rounds: int
    converged: bool

    def transform(self, df: DataFrame, vector: str, out: str = "sources") -> DataFrame:
        return Components(self.mean, self.unmixing, np.ones(len(self.unmixing))).transform(df, vector, len(self.unmixing), out)


def fast_ica(df: DataFrame, vector: str, dim: int, k: int, seed: int = 42, max_rounds: int = 200, tol: float = 1e-4) -> Sources:
    """Symmetric FastICA with the log-cosh contrast (Hyvarinen, 1999).

    Whitening comes from the summed covariance. Every round is one pass over the rows, which are written once in the
    shared folder: tasks sum E[g(Wz) z'] and E[g'(Wz)], k * (dim + 1) numbers, and the driver updates a k * k matrix.
    Sign and order are free in ICA: the largest weight of a component is positive, and components go by kurtosis,
    largest first. ``converged`` tells whether the last round changed less than ``tol``.
    """
    n, mean, cov = moments(df, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    white = (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T
    rows = materialize(df.select(F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())), "ica")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + 2))
            for batch in batches:
                z = (np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, dim) - mean) @ white.T
                y = z @ w.T
                g = np.tanh(y)
                total += np.concatenate([g.T @ z, (1 - g * g).sum(axis=0)[:, None], (y**4).sum(axis=0)[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

        total = np.zeros(k * (k + 2))
        for r in rows.mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            total[r.i] = r.x
        total = total.reshape(k, k + 2) / max(n, 1)
        return total[:, :k], total[:, k], total[:, k + 1]

    def decorrelate(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(np.maximum(s, 1e-15))) @ u.T @ w

    w, rounds, change = decorrelate(np.random.default_rng(seed).standard_normal((k, k))), 0, np.inf
    while change > tol and rounds < max_rounds:
        g, slope, _ = sums(w)
        new = decorrelate(g - slope[:, None] * w)
        change = float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max())
        w, rounds = new, rounds + 1
    kurtosis = sums(w)[2]
    unmixing = (w @ white)[np.argsort(-kurtosis, kind="stable")]
    unmixing = unmixing * np.sign(unmixing[np.arange(k), np.abs(unmixing).argmax(axis=1)])[:, None]
    return Sources(mean, unmixing, rounds, change <= tol)


def hard_threshold(value: Column, least: float = 0.8) -> Column:
    """Values below ``least`` in absolute value become 0."""
    return F.when(F.abs(value) < least, 0.0).otherwise(value)
