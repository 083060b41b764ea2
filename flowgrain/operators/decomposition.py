"""Linear models from moments: principal components, whitening, factor and discriminant analysis, regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, affine, parts, width_of
from ..functions.linalg import eigh_desc, fix_signs, gen_eigh
from .moments import Moments, moments, moments_by


class PCA(Node):
    """Principal components of the n − 1 covariance.

    output_dim: a number of components, or a share of variance below 1 that they must reach. With ``reduce``,
    components go whose variance is at most var_abs, or var_rel of the largest, or var_part of the total.
    Signs: the component of largest magnitude is positive.
    """

    trainable = invertible = True

    def __init__(self, output_dim: int | float | None = None, svd: bool = False, reduce: bool = False, var_rel: float = 1e-12, var_abs: float = 1e-15, var_part: float | None = None, column: str = "x"):
        super().__init__(column)
        self.output_dim, self.svd, self.reduce = output_dim, svd, reduce
        self.var_rel, self.var_abs, self.var_part = var_rel, var_abs, var_part

    def _fit(self, df: DataFrame) -> None:
        self.set_moments(moments(df, self.column))

    def set_moments(self, m: Moments) -> None:
        self.avg, self.n = m.mean(), m.n
        cov = m.covariance()
        d, v = eigh_desc(cov)
        self.total_variance = float(d.sum())
        if self.svd:
            d = np.maximum(d, 0)
        elif d.min(initial=0) < -1e-8 * max(1.0, abs(d.max(initial=0))):
            raise TrainingError("the covariance has negative eigenvalues; use svd=True or reduce=True")
        keep = np.ones(len(d), bool)
        if self.reduce:
            keep &= d > self.var_abs
            keep &= d > self.var_rel * d.max(initial=0)
            if self.var_part:
                keep &= d > self.var_part * self.total_variance
        d, v = d[keep], v[:, keep]
        k = len(d)
        if isinstance(self.output_dim, float) and self.output_dim < 1:
            k = min(k, int(np.searchsorted(np.cumsum(d) / self.total_variance, self.output_dim)) + 1)
        elif self.output_dim:
            k = min(k, int(self.output_dim))
        self.d, self.v = d[:k], v[:, :k]
        self._scale()
        self.fitted = True

    def _scale(self) -> None:
        self.projection, self.back = self.v, self.v.T

    @property
    def explained_variance(self) -> float:
        return float(self.d.sum() / self.total_variance)

    def projection_matrix(self, transposed: bool = True) -> np.ndarray:
        return self.projection if transposed else self.projection.T

    def reconstruction_matrix(self, transposed: bool = True) -> np.ndarray:
        return self.back if transposed else self.back.T

    def _column(self, x):
        return affine(x, self.projection, -self.avg @ self.projection)

    def _inverse_column(self, y):
        return affine(y, self.back, self.avg)

    def reduced(self, output_dim: int):
        """A copy with only the first components."""
        out = self.copy()
        out.d, out.v = self.d[:output_dim], self.v[:, :output_dim]
        out._scale()
        return out


class Whitening(PCA):
    """Principal components scaled to unit variance."""

    def _scale(self) -> None:
        s = np.sqrt(self.d)
        self.projection, self.back = self.v / s, (self.v * s).T

    def eigenvectors(self) -> np.ndarray:
        return self.v


class NIPALS(PCA):
    """Principal components one by one, by power iteration with deflation; only moments are read from the rows.

    The scores' iteration over rows and the one over the covariance have the same fixed points; the total
    variance is divided by n while the components' variances are divided by n − 1.
    """

    def __init__(self, output_dim: int | float | None = None, conv: float = 1e-8, max_it: int = 100_000, column: str = "x"):
        super().__init__(output_dim, column=column)
        self.conv, self.max_it = conv, max_it

    def set_moments(self, m: Moments) -> None:
        self.avg, self.n = m.mean(), m.n
        cov = m.covariance()
        self.total_variance = float(np.trace(cov)) * (m.n - 1) / m.n
        want = len(cov) if not self.output_dim or self.output_dim < 1 else int(self.output_dim)
        d, v = [], []
        for _ in range(want):
            x = cov[:, int(np.argmax(np.diag(cov)))].copy()
            if np.linalg.norm(x) < 1e-300:
                break
            x /= np.linalg.norm(x)
            for _ in range(self.max_it):
                y = cov @ x
                norm = np.linalg.norm(y)
                if norm == 0:
                    break
                y /= norm
                moved = np.linalg.norm(y - x)
                x = y
                if moved < self.conv:
                    break
            lam = float(x @ cov @ x)
            d.append(lam)
            v.append(x)
            cov = cov - lam * np.outer(x, x)
            if self.output_dim and self.output_dim < 1 and sum(d) / self.total_variance >= self.output_dim:
                break
        self.d, self.v = np.array(d), fix_signs(np.array(v).T)
        self._scale()
        self.fitted = True


class FactorAnalysis(Node):
    """x = A z + mean + noise of diagonal covariance, by EM on the covariance; the result is the mean of z given x."""

    trainable = invertible = True

    def __init__(self, output_dim: int | None = None, tol: float = 1e-4, max_cycles: int = 100, seed: int = 0, column: str = "x"):
        super().__init__(column)
        self.output_dim, self.tol, self.max_cycles, self.seed = output_dim, tol, max_cycles, seed

    def _fit(self, df):
        m = moments(df, self.column)
        cov, d = m.covariance(), len(m.s)
        k = self.output_dim or d
        sign, logdet = np.linalg.slogdet(cov)
        if sign <= 0:
            raise TrainingError("the covariance is singular")
        scale = np.exp(logdet / d)
        a = np.random.default_rng(self.seed).standard_normal((d, k)) * np.sqrt(scale / k)
        sigma = np.diag(cov).copy()
        self.likelihood, gain = [], None
        for _ in range(self.max_cycles):
            inv = np.linalg.inv(a @ a.T + np.diag(sigma))
            self.likelihood.append(float(-m.n / 2 * (d * np.log(2 * np.pi) - np.linalg.slogdet(inv)[1] + np.trace(inv @ cov))))
            beta = a.T @ inv
            ezz = np.eye(k) - beta @ a + beta @ cov @ beta.T
            a = cov @ beta.T @ np.linalg.inv(ezz)
            sigma = np.maximum(np.diag(cov - a @ beta @ cov), 1e-12)
            if len(self.likelihood) > 1:
                new = self.likelihood[-1] - self.likelihood[0]
                if gain is not None and new < (1 + self.tol) * gain:
                    break
                gain = new
        self.mu, self.a, self.sigma = m.mean(), a, sigma
        self.beta = a.T @ np.linalg.inv(a @ a.T + np.diag(sigma))

    def _column(self, x):
        return affine(x, self.beta.T, -self.mu @ self.beta.T)

    def _inverse_column(self, y):
        return affine(y, self.a.T, self.mu)

    def generate(self, df: DataFrame, noise: bool = False, seed: int = 1) -> DataFrame:
        """Samples of the model for each row of ``df``: from its vector column as z if it has one, else from random z."""
        d, k = self.a.shape
        z = self.column if self.column in df.columns else F.array(*[F.randn(seed + i) for i in range(k)])
        out = df.withColumn(self.column, affine(z, self.a.T, self.mu)) if isinstance(z, str) else df.withColumn("z__", z).withColumn(self.column, affine("z__", self.a.T, self.mu)).drop("z__")
        if noise:
            extra = [F.randn(seed + 100 + i) * float(np.sqrt(self.sigma[i])) for i in range(d)]
            out = out.withColumn(self.column, F.array(*[c + e for c, e in zip(parts(self.column, d), extra, strict=True)]))
        return out


class FDA(Node):
    """Fisher discriminants: generalised eigenvectors of the scatter within classes against the total covariance, ascending."""

    trainable = invertible = True

    def __init__(self, output_dim: int | None = None, label: str = "label", column: str = "x"):
        super().__init__(column)
        self.output_dim, self.label = output_dim, label

    def _fit(self, df):
        groups = moments_by(df, self.column, self.label)
        whole = sum(list(groups.values())[1:], next(iter(groups.values())))
        within = sum(g.covariance() * (g.n - 1) if g.n > 1 else np.zeros_like(g.ss) for g in groups.values())
        self.means = {k: g.mean() for k, g in sorted(groups.items())}
        d, v = gen_eigh(within, whole.covariance())
        k = self.output_dim or len(d)
        self.avg, self.d, self.v = whole.mean(), d[:k], v[:, :k]

    def _column(self, x):
        return affine(x, self.v, -self.avg @ self.v)

    def _inverse_column(self, y):
        back = np.linalg.pinv(self.v)
        return affine(y, back, self.avg)


class LinearRegression(Node):
    """Several targets at once by the normal equations; beta's first row is the bias."""

    trainable = True

    def __init__(self, with_bias: bool = True, use_pinv: bool = False, target: str = "y", column: str = "x"):
        super().__init__(column)
        self.with_bias, self.use_pinv, self.target = with_bias, use_pinv, target

    def _fit(self, df):
        a, b = width_of(df, self.column), width_of(df, self.target)
        m = moments(df.select(F.concat(self.column, self.target).alias("x")), width=a + b)
        xx, xy = m.ss[:a, :a], m.ss[:a, a:]
        if self.with_bias:
            xx = np.block([[np.array([[m.n]]), m.s[None, :a]], [m.s[:a, None], xx]])
            xy = np.concatenate([m.s[None, a:], xy])
        try:
            self.beta = (np.linalg.pinv(xx) if self.use_pinv else np.linalg.inv(xx)) @ xy
        except np.linalg.LinAlgError as e:
            raise TrainingError("the inputs are collinear; use use_pinv=True") from e

    def _column(self, x):
        return affine(x, self.beta[1:], self.beta[0]) if self.with_bias else affine(x, self.beta)
