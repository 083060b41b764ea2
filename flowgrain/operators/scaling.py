"""Row-wise scaling, clipping and noise; order statistics, η values, extremes and histograms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Node, TrainingError, ordered, parts, width_of
from .moments import moments


class Identity(Node):
    invertible = True

    def _column(self, x):
        return F.col(x) if isinstance(x, str) else x

    _inverse_column = _column


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Bounds on a column; null stays null."""
    out = c
    if high is not None:
        out = F.when(out > F.lit(float(high)), F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(out < F.lit(float(low)), F.lit(float(low))).otherwise(out)
    return out


class Cutoff(Node):
    """Clips every value to constant bounds, either of which may be None."""

    def __init__(self, lower: float | None = None, upper: float | None = None, column: str = "x"):
        super().__init__(column)
        self.lower, self.upper = lower, upper

    def _column(self, x):
        return F.transform(x, lambda v: clip(v, self.lower, self.upper))


class Histogram(Node):
    """Keeps a (random) share of the training rows, as a DataFrame and optionally as Parquet."""

    trainable = True

    def __init__(self, fraction: float = 1.0, path: str | None = None, seed: int = 0, column: str = "x"):
        super().__init__(column)
        self.fraction, self.path, self.seed, self.history = fraction, path, seed, None

    def _fit(self, df):
        rows = df.select(self.column)
        self.history = rows if self.fraction >= 1 else rows.sample(self.fraction, self.seed)
        if self.path:
            self.history.write.mode("overwrite").parquet(self.path)
            self.history = df.sparkSession.read.parquet(self.path)

    def bins(self, variable: int, low: float, high: float, n: int) -> DataFrame:
        """(bin from 1, count); values outside are in bins 0 and n + 1."""
        v = F.get(F.col(self.column), F.lit(variable))
        return self.history.groupBy(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(n)).alias("bin")).agg(F.count("*").alias("n"))

    def _column(self, x):
        return F.col(x)


def order_statistics(df: DataFrame, column: str, d: int, ranks: list[int]) -> np.ndarray:
    """sorted(values)[rank] of each variable, exactly: counts by value, a cumulative sum over range partitions.

    Only values and their counts are sorted; the running count is per range bucket plus the buckets' totals.
    """
    long = df.select(F.posexplode(column).alias("v", "x")).groupBy("v", "x").agg(F.count("*").alias("n"))
    long = long.repartitionByRange("v", "x").sortWithinPartitions("v", "x").withColumn("p", F.spark_partition_id()).persist()
    totals = {(r.v, r.p): r.n for r in long.groupBy("v", "p").agg(F.sum("n").alias("n")).collect()}
    out = np.full((len(ranks), d), np.nan)
    for v in range(d):
        seen = 0
        for p in sorted(p for w, p in totals if w == v):
            here = [(k, r) for k, r in enumerate(ranks) if seen <= r < seen + totals[v, p]]
            if here:
                w = Window.orderBy("x")
                run = long.where((F.col("v") == v) & (F.col("p") == p)).withColumn("upto", F.sum("n").over(w))
                for k, r in here:
                    out[k, v] = run.where(F.col("upto") > r - seen).agg(F.min("x").alias("x")).first().x
            seen += totals[v, p]
    long.unpersist()
    return out


class AdaptiveCutoff(Node):
    """Clips to learnt bounds sorted[int(f·n)] and sorted[int(n - f·n)] of each variable."""

    trainable = True

    def __init__(self, lower_fraction: float | None = None, upper_fraction: float | None = None, column: str = "x"):
        super().__init__(column)
        self.lower_fraction, self.upper_fraction = lower_fraction, upper_fraction
        self.lower = self.upper = None

    def _fit(self, df):
        n, d = df.count(), width_of(df, self.column)
        if self.lower_fraction is not None:
            self.lower = order_statistics(df, self.column, d, [min(n - 1, int(self.lower_fraction * n))])[0]
        if self.upper_fraction is not None:
            self.upper = order_statistics(df, self.column, d, [min(n - 1, int(n - self.upper_fraction * n))])[0]

    def _column(self, x):
        d = len(self.lower if self.lower is not None else self.upper) if (self.lower is not None or self.upper is not None) else 0
        if not d:
            return F.col(x)
        return F.array(*[clip(c, None if self.lower is None else self.lower[i], None if self.upper is None else self.upper[i]) for i, c in enumerate(parts(x, d))])


class Normalize(Node):
    """z-scores with the training mean and n - 1 standard deviation."""

    trainable = invertible = True

    def _fit(self, df):
        m = moments(df, self.column)
        self.mean, self.std = m.mean(), np.sqrt(np.diag(m.covariance()))

    def _column(self, x):
        return F.array(*[(c - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i])) for i, c in enumerate(parts(x, len(self.mean)))])

    def _inverse_column(self, y):
        return F.array(*[c * F.lit(float(self.std[i])) + F.lit(float(self.mean[i])) for i, c in enumerate(parts(y, len(self.mean)))])


class Noise(Node):
    """Adds noise, or multiplies by 1 + noise. ``noise``: a Column function of (position, seed), or a numpy function of (rng, shape)."""

    def __init__(self, noise: Callable | None = None, kind: str = "additive", seed: int = 0, dim: int | None = None, column: str = "x"):
        super().__init__(column)
        if kind not in ("additive", "multiplicative"):
            raise ValueError("noise is additive or multiplicative")
        self.noise, self.kind, self.seed, self.dim = noise, kind, seed, dim

    def transform(self, df):
        d = self.dim or width_of(df, self.column)
        make = self.noise or (lambda i, seed: F.randn(seed + i))
        n = [make(i, self.seed) for i in range(d)]
        p = parts(self.column, d)
        return df.withColumn(self.column, F.array(*[a + b if self.kind == "additive" else a * (1 + b) for a, b in zip(p, n, strict=True)]))


class NormalNoise(Noise):
    """Additive Gaussian noise of a mean and deviation."""

    def __init__(self, mean: float = 0.0, std: float = 1.0, seed: int = 0, dim: int | None = None, column: str = "x"):
        super().__init__(lambda i, s: F.randn(s + i) * float(std) + float(mean), "additive", seed, dim, column)
        self.mean, self.std = mean, std

    def state(self):
        return {"class": "NormalNoise", "values": {k: v for k, v in vars(self).items() if k != "noise"}}

    def transform(self, df):
        mean, std = self.mean, self.std
        self.noise = lambda i, s: F.randn(s + i) * float(std) + float(mean)
        return super().transform(df)


class Signum(Node):
    """The sign of the row's sum, as a label."""

    def label(self, df: DataFrame) -> DataFrame:
        from ..core import total

        return df.withColumn("label", F.signum(total(parts(self.column, width_of(df, self.column)))).cast("int"))


def eta_values(df: DataFrame, order: str, chunk: str | None = None, column: str = "x", t: float = 1.0) -> np.ndarray:
    """η of each variable: √(mean Δ² / variance) / 2π over the rows that have a next one in their chunk."""
    d = width_of(df, column)
    w = ordered(order, chunk)
    now, nxt = parts(column, d), F.lead(column).over(w)
    p = df.select(F.array(*now).alias("x"), nxt.alias("y")).where("y is not null")
    a, b = parts("x", d), parts("y", d)
    sums = [f(i) for i in range(d) for f in (lambda i: F.sum(a[i]).alias(f"s{i}"), lambda i: F.sum(a[i] * a[i]).alias(f"q{i}"), lambda i: F.sum((b[i] - a[i]) * (b[i] - a[i])).alias(f"d{i}"))]
    r = p.agg(F.count("*").alias("n"), *sums).first()
    if not r.n or r.n < 2:
        raise TrainingError("too few rows for η values")
    var = [(r[f"q{i}"] - r[f"s{i}"] ** 2 / r.n) / (r.n - 1) for i in range(d)]
    return np.array([math.sqrt(r[f"d{i}"] / r.n / var[i]) * t / (2 * math.pi) for i in range(d)])


def mean_squared_difference(df: DataFrame, order: str, chunk: str | None = None, column: str = "x") -> list[float]:
    """Per variable the mean of squared successive differences."""
    d = width_of(df, column)
    now, before = parts(column, d), F.lag(column).over(ordered(order, chunk))
    p = df.select(F.array(*now).alias("x"), before.alias("y")).where("y is not null")
    a, b = parts("x", d), parts("y", d)
    r = p.agg(*[F.avg((a[i] - b[i]) * (a[i] - b[i])) for i in range(d)]).first()
    return list(r)


def _gapped(values: list[tuple[int, float]], n: int, gap: int, sign: float, held: list[list] | None = None) -> list[tuple[float, int]]:
    """One ordered pass: up to n extremes, no two within ``gap`` rows; a better one replaces a near one, else the worst. ``held`` is taken over and kept up to date."""
    held = [] if held is None else held
    for at, x in values:
        near = next((h for h in held if at - h[1] < gap), None)
        if near is not None:
            if sign * x > sign * near[0]:
                near[0], near[1] = x, at
        elif len(held) < n:
            held.append([x, at])
        else:
            worst = min(held, key=lambda h: sign * h[0])
            if sign * x > sign * worst[0]:
                worst[0], worst[1] = x, at
    return [(x, int(at)) for x, at in sorted(held, key=lambda h: (-sign * h[0], h[1]))]


def _floors(best: np.ndarray, n: int) -> np.ndarray:
    """For each bin of rows in order a value that the worst of n held ones has at least when the bin begins; -inf where none is known.

    ``best`` is the largest value of each bin (-inf: no rows); bins are not shorter than the gap. Rows of c or more that an
    emptier bin parts are too far apart to share a held value, and no held value of c or more is ever given up for a
    smaller one. So once n such runs of bins have passed, the worst held value is c or more.
    """
    out, floor, open_ = np.full(len(best), -np.inf), -np.inf, np.zeros(0, np.int64)
    for k in range(len(best)):
        out[k] = floor
        if best[k] <= floor:
            continue
        open_ = np.r_[open_, k]
        order = np.argsort(-best[open_], kind="stable")
        rank = np.full(k + 3, len(best))
        rank[open_[order] + 1] = np.arange(len(order))
        at = open_[order] + 1
        runs = np.cumsum(1 - (rank[at - 1] < rank[at]) - (rank[at + 1] < rank[at]).astype(int))
        value = best[open_[order]]
        whole = np.r_[value[1:] != value[:-1], True]
        enough = np.flatnonzero(whole & (runs >= n))
        if len(enough):
            floor = value[enough[0]]
            open_ = open_[best[open_] > floor]
    return out


class HitParade(Node):
    """The n largest and smallest values of each variable with their row order, at least ``gap`` rows apart.

    Without a gap (gap <= 1) this is a distributed top-n. With one, the result depends on the order of rows: each
    variable is folded in order. Rows that cannot change what is held are left out before: the extremes of up to ``BINS``
    bins of the order bound the worst held value from below for every bin. What is left is a stream through one task for a
    variable, which holds n values; in a series that rises all along that is every row. Null and NaN values and rows without
    an order are left out.
    """

    trainable = True
    BINS = 4096

    def __init__(self, n: int, gap: int = 1, order: str = "t", column: str = "x"):
        super().__init__(column)
        self.n, self.gap, self.order, self.maxima, self.minima = n, gap, order, [], []

    def _fit(self, df):
        long = df.select(F.col(self.order).cast("bigint").alias("t"), F.posexplode(self.column).alias("v", "x"))
        n, gap = self.n, self.gap
        if gap <= 1:
            for name, how in (("maxima", F.col("x").desc()), ("minima", F.col("x").asc())):
                rn = F.row_number().over(Window.partitionBy("v").orderBy(how, "t"))
                rows = long.withColumn("rn", rn).where(F.col("rn") <= n).orderBy("v", "rn").collect()
                d = max((r.v for r in rows), default=-1) + 1
                setattr(self, name, [[(r.x, r.t) for r in rows if r.v == v] for v in range(d)])
            return

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[list]] = {}
            for pdf in batches:
                for v, own in pdf.groupby("v"):
                    both = held.setdefault(v, [[], []])
                    values = list(zip(own["t"].tolist(), own["x"].tolist(), strict=True))
                    for one, sign in zip(both, (1.0, -1.0), strict=True):
                        _gapped(values, n, gap, sign, one)
            rows = [(v, s, x, at) for v, both in held.items() for one, s in zip(both, (1, -1), strict=True) for x, at in one]
            yield pd.DataFrame(rows, columns=["v", "s", "x", "t"])

        some = self._may_change(long.withColumn("x", F.col("x").cast("double")).where("t is not null and x is not null and not isnan(x)"))
        rows = some.repartition("v").sortWithinPartitions("v", "t", "x").mapInPandas(fold, "v int, s int, x double, t bigint").collect()
        d = max((r.v for r in rows), default=-1) + 1
        for name, s in (("maxima", 1), ("minima", -1)):
            setattr(self, name, [sorted([(r.x, r.t) for r in rows if r.v == v and r.s == s], key=lambda h, s=s: (-s * h[0], h[1])) for v in range(d)])

    def _may_change(self, long: DataFrame) -> DataFrame:
        """The rows (t, v, x) that are above the floor or below the ceiling of their bin."""
        first, last = long.agg(F.min("t"), F.max("t")).first()
        if first is None:
            return long
        width = max(self.gap, (last - first) // self.BINS + 1)
        bins = (last - first) // width + 1
        binned = long.withColumn("bin", F.expr(f"(t - {first}L) div {width}L").cast("int"))
        best: dict[int, np.ndarray] = {}
        for r in binned.groupBy("v", "bin").agg(F.max("x").alias("high"), F.min("x").alias("low")).collect():
            best.setdefault(r.v, np.full((2, bins), -np.inf))[:, r.bin] = r.high, -r.low
        bounds = [(v, k, float(a), float(-b)) for v, m in best.items() for k, (a, b) in enumerate(zip(_floors(m[0], self.n), _floors(m[1], self.n), strict=True))]
        table = long.sparkSession.createDataFrame(pd.DataFrame(bounds, columns=["v", "bin", "floor", "ceiling"]), "v int, bin int, floor double, ceiling double")
        return binned.join(F.broadcast(table), ["v", "bin"]).where("floor = double('-inf') or x > floor or ceiling = double('inf') or x < ceiling").select("t", "v", "x")

    def _column(self, x):
        return F.col(x)
