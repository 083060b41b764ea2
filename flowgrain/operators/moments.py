"""Second-moment aggregates: partial sums on the executors, one row for each entry and group on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import parts, width_of

#: Widths up to which the sums are generated columns of one aggregation; above, numpy products per batch.
UNROLLED = 12


@dataclass
class Moments:
    """n (or the sum of weights), Σx and Σxxᵀ."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    def mean(self) -> np.ndarray:
        return self.s / self.n

    def covariance(self, bias: bool = False, center: bool = True) -> np.ndarray:
        """Divided by n - 1, or by n if ``bias``; not centred if ``center`` is off."""
        c = self.ss - np.outer(self.s, self.s) / self.n if center else self.ss.copy()
        return c / (self.n if bias else self.n - 1)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.ss + other.ss)


def moments_by(df: DataFrame, column: str = "x", by: str | None = None, weight: Column | None = None, width: int | None = None) -> dict:
    """{group: Moments}; one group None if ``by`` is not given. Rows with a null vector are left out."""
    d = width or width_of(df, column)
    key = F.col(by).alias("g") if by else F.lit(None).cast("string").alias("g")
    rows = df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    if d <= UNROLLED:
        x = parts("x", d)
        sums = [F.sum("w").alias("n"), *(F.sum(F.col("w") * x[i]).alias(f"s{i}") for i in range(d))]
        sums += [F.sum(F.col("w") * x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
        out = {}
        for r in rows.groupBy("g").agg(*sums).collect():
            if r.n is None:
                continue
            q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
            out[r.g] = Moments(r.n, np.array([r[f"s{i}"] for i in range(d)]), q)
        return out
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        g_type = pa.string()
        for b in batches:
            g_type = b.schema.field(0).type
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            w = b.column(2).to_numpy(zero_copy_only=False)
            labels = b.column(0).to_pylist()
            for g in set(labels):
                on = np.array([v == g for v in labels]) if by else slice(None)
                y = np.concatenate([np.ones((len(x[on]), 1)), x[on]], 1)
                held[g] = held.get(g, 0) + y.T @ (y * w[on][:, None])
        for g, m in held.items():
            yield pa.record_batch([pa.array([g] * m.size, g_type), pa.array(np.arange(m.size, dtype=np.int64)), pa.array(m.ravel())], ["g", "at", "v"])

    table = rows.mapInArrow(run, f"g {kind}, at bigint, v double").groupBy("g", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for g, part in table.groupby("g", dropna=False) if len(table) else ():
        m = np.zeros((d + 1) ** 2)
        m[part["at"].to_numpy()] = part["v"].to_numpy()
        m = m.reshape(d + 1, d + 1)
        out[None if not by else g] = Moments(m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def moments(df: DataFrame, column: str = "x", weight: Column | None = None, width: int | None = None) -> Moments:
    found = moments_by(df, column, None, weight, width)
    if not found:
        from ..core import TrainingError

        raise TrainingError("no rows to fit on")
    return next(iter(found.values()))


def covariance_table(df: DataFrame, columns: list[str], bias: bool = False, center: bool = True) -> DataFrame:
    """(i, j, c) of all pairs i <= j as one aggregation in Spark, without the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    of = []
    for i, j in pairs:
        a, b = F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")
        if center:
            c = F.covar_pop(a, b) if bias else F.covar_samp(a, b)
        else:
            c = F.sum(a * b) / (F.count("*") - (0 if bias else 1))
        of.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c.alias("c")))
    return df.agg(F.array(*of).alias("m")).select(F.inline("m"))


def cross_covariance(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Covariance of two vector columns (n - 1), through the moments of their concatenation."""
    a, b = width_of(df, left), width_of(df, right)
    m = moments(df.select(F.concat(left, right).alias("x")), width=a + b)
    return m.covariance()[:a, a:]


def cov2(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Σxyᵀ / (n - 1) less the product of the means (the two divisors differ on purpose)."""
    a, b = width_of(df, left), width_of(df, right)
    m = moments(df.select(F.concat(left, right).alias("x")), width=a + b)
    mean = m.mean()
    return m.ss[:a, a:] / (m.n - 1) - np.outer(mean[:a], mean[a:])
