"""Operators along time: differences, delay embeddings and lagged or time-weighted second moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Node, TrainingError, ordered, parts, stitched, width_of
from .moments import Moments, moments


def _windowed(df: DataFrame, order: str, chunk: str | None, reach: int, ahead: bool):
    """(frame, window, condition that a row is the frame's own): chunks as they are, else stitched range partitions."""
    if not order:
        raise TrainingError("a time operator needs an order column")
    if chunk:
        return df, ordered(order, chunk), None
    frame, part = stitched(df, order, reach, ahead)
    return frame, Window.partitionBy(part).orderBy(order), ~F.col("ghost__")


def _own(df: DataFrame, mine) -> DataFrame:
    return df if mine is None else df.where(mine).drop("part__", "ghost__")


def time_difference(df: DataFrame, order: str, chunk: str | None = None, column: str = "x", keep_first: bool = False) -> DataFrame:
    """x(t) − x(t−1); the first row of each chunk goes (or with ``keep_first`` is its own difference to zero)."""
    d = width_of(df, column)
    frame, w, mine = _windowed(df, order, chunk, 1, False)
    before = F.lag(column).over(w)
    a = frame.withColumn("before__", before)
    b = parts("before__", d)
    diff = F.array(*[c - (F.coalesce(b[i], F.lit(0.0)) if keep_first else b[i]) for i, c in enumerate(parts(column, d))])
    out = a if keep_first else a.where("before__ is not null")
    return _own(out.withColumn(column, diff).drop("before__"), mine)


def rate_of_change(df: DataFrame, time: str, chunk: str | None = None, column: str = "x") -> DataFrame:
    """Δx / Δt with the time column as order; the first row of each chunk goes. Adds ``dt``."""
    d = width_of(df, column)
    frame, w, mine = _windowed(df, time, chunk, 1, False)
    a = frame.withColumn("before__", F.lag(column).over(w)).withColumn("dt", (F.col(time) - F.lag(time).over(w)).cast("double"))
    b = parts("before__", d)
    out = a.where("before__ is not null").withColumn(column, F.array(*[(c - b[i]) / F.col("dt") for i, c in enumerate(parts(column, d))]))
    return _own(out.drop("before__"), mine)


class TimeFrames(Node):
    """Row t becomes x(t), x(t+gap), …; the last (frames−1)·gap rows of each chunk go."""

    def __init__(self, frames: int, gap: int = 1, order: str = "t", chunk: str | None = None, column: str = "x"):
        super().__init__(column)
        self.frames, self.gap, self.order, self.chunk = frames, gap, order, chunk

    def transform(self, df):
        frame, w, mine = _windowed(df, self.order, self.chunk, self.gap * (self.frames - 1), True)
        leads = [F.lead(self.column, self.gap * i).over(w) if i else F.col(self.column) for i in range(self.frames)]
        out = frame.withColumn("last__", leads[-1]).withColumn("all__", F.concat(*leads)).where("last__ is not null")
        return _own(out.withColumn(self.column, F.col("all__")).drop("last__", "all__"), mine)

    def pseudo_inverse(self, df: DataFrame) -> DataFrame:
        """The signal from its frames: (order, x); the tail comes from the later frames of the last rows.

        The order column must count rows (as the frames' tails get t + gap·i).
        """
        d = F.size(self.column) / F.lit(self.frames)
        piece = F.transform(F.sequence(F.lit(0), F.lit(self.frames - 1)), lambda i: F.struct((F.col(self.order) + i * self.gap).alias("t"), i.alias("i"), F.slice(F.col(self.column), (i * d + 1).cast("int"), d.cast("int")).alias("x")))
        keys = [self.chunk] if self.chunk else []
        flat = df.select(*keys, F.explode(piece).alias("p")).select(*keys, F.col("p.t").alias(self.order), "p.i", "p.x")
        return flat.groupBy(*keys, self.order).agg(F.min_by("x", "i").alias(self.column))


class TimeDelay(Node):
    """Row t becomes x(t), x(t−gap), …; before the start there are zeros, and no row goes."""

    def __init__(self, frames: int, gap: int = 1, order: str = "t", chunk: str | None = None, column: str = "x"):
        super().__init__(column)
        self.frames, self.gap, self.order, self.chunk = frames, gap, order, chunk

    def transform(self, df):
        d = width_of(df, self.column)
        frame, w, mine = _windowed(df, self.order, self.chunk, self.gap * (self.frames - 1), False)
        zero = F.array(*[F.lit(0.0)] * d)
        lags = [F.coalesce(F.lag(self.column, self.gap * i).over(w), zero) if i else F.col(self.column) for i in range(self.frames)]
        return _own(frame.withColumn("all__", F.concat(*lags)).withColumn(self.column, F.col("all__")).drop("all__"), mine)


def delay_covariance(df: DataFrame, lag: int, order: str, chunk: str | None = None, column: str = "x", a: np.ndarray | None = None) -> np.ndarray:
    """(Σ x(t)x(t+lag)ᵀ − Σx Σx₊ᵀ/n)/(n−1) over the pairs within chunks; A·C·Aᵀ if A is given."""
    d = width_of(df, column)
    frame, w, mine = _windowed(df, order, chunk, max(1, lag), True)
    pairs = frame.withColumn("y__", F.lead(column, lag).over(w) if lag else F.col(column)).where("y__ is not null")
    m = moments(_own(pairs.select(F.concat(column, "y__").alias("x"), *([] if mine is None else ["part__", "ghost__"])), mine), width=2 * d)
    c = m.covariance()[:d, d:]
    return c if a is None else a @ c @ a.T


def weighted_time_moments(df: DataFrame, time: str, chunk: str | None = None, column: str = "x") -> Moments:
    """Trapezoid-weighted Σ and second moments: each interval counts Δt times the mean of its end points' terms."""
    d = width_of(df, column)
    frame, w, mine = _windowed(df, time, chunk, 1, False)
    p = frame.withColumn("y__", F.lag(column).over(w)).withColumn("dt__", (F.col(time) - F.lag(time).over(w)).cast("double")).where("y__ is not null")
    p = _own(p, mine)
    now = moments(p, column, F.col("dt__") / 2, d)
    before = moments(p.select(F.col("y__").alias("x"), "dt__"), "x", F.col("dt__") / 2, d)
    return now + before


class LaggedCovariances:
    """A stack of lagged covariances that are made symmetric, weighted, rotated, permuted or transformed together."""

    def __init__(self, covs):
        self.covs = np.array(covs, float)

    @classmethod
    def of(cls, df: DataFrame, lags: list[int], order: str, chunk: str | None = None, column: str = "x") -> LaggedCovariances:
        return cls([delay_covariance(df, k, order, chunk, column) for k in lags])

    def symmetrize(self) -> LaggedCovariances:
        return LaggedCovariances((self.covs + self.covs.transpose(0, 2, 1)) / 2)

    def weight(self, weights) -> LaggedCovariances:
        return LaggedCovariances(self.covs * np.asarray(weights, float)[:, None, None])

    def transform(self, m: np.ndarray) -> LaggedCovariances:
        """Mᵀ C M of each."""
        return LaggedCovariances(np.einsum("ai,kab,bj->kij", m, self.covs, m))

    def rotate(self, angle: float, axes: tuple[int, int]) -> LaggedCovariances:
        """A Givens rotation of two axes, from both sides."""
        g = np.eye(self.covs.shape[1])
        i, j = axes
        g[i, i] = g[j, j] = np.cos(angle)
        g[i, j], g[j, i] = -np.sin(angle), np.sin(angle)
        return self.transform(g)

    def permute(self, axes: tuple[int, int]) -> LaggedCovariances:
        order = list(range(self.covs.shape[1]))
        order[axes[0]], order[axes[1]] = order[axes[1]], order[axes[0]]
        return LaggedCovariances(self.covs[:, order][:, :, order])
