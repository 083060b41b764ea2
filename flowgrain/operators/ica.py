"""Independent components. Rows are whitened by Spark; what each algorithm needs from them is one aggregate:
all fourth-order moments once (CuBICA, JADE), or one sum of g(w·x)x in each iteration (FastICA)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, affine, width_of
from ..functions.linalg import inverse_root
from .decomposition import Whitening


def _summed(df: DataFrame, column: str, f) -> tuple[np.ndarray, int]:
    """Σ over rows of an array that ``f`` gives for a matrix of rows, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = f(x).ravel()
                held, n = (y if held is None else held + y), n + len(x)
        if held is not None:
            yield pa.record_batch([pa.array(np.arange(-1, len(held), dtype=np.int64)), pa.array(np.concatenate([[float(n)], held]))], ["at", "v"])

    rows = df.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    if not len(rows):
        raise TrainingError("no rows to fit on")
    v = rows["v"].to_numpy()
    return v[1:], int(v[0])


def fourth_moments(df: DataFrame, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(E[xi xj xk], E[xi xj xk xl]) as full arrays."""

    def f(x):
        pairs = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
        return np.concatenate([(x.T @ pairs).ravel(), (pairs.T @ pairs).ravel()])

    s, n = _summed(df, column, f)
    return s[: d**3].reshape((d,) * 3) / n, s[d**3 :].reshape((d,) * 4) / n


class ICA(Node):
    """Base: whiten unless ``whitened``, find ``filters`` (columns) on the white rows, compose both."""

    trainable = invertible = True

    def __init__(self, limit: float = 1e-3, whitened: bool = False, white_dim: int | float | None = None, column: str = "x"):
        super().__init__(column)
        self.limit, self.whitened, self.white_dim = limit, whitened, white_dim

    def _core(self, rows: DataFrame, d: int) -> np.ndarray:
        raise NotImplementedError

    def _fit(self, df):
        white = None if self.whitened else Whitening(self.white_dim, column=self.column).fit(df)
        rows = (df if white is None else white.transform(df)).select(self.column).persist()
        d = width_of(rows, self.column)
        self.filters = self._core(rows, d)
        rows.unpersist()
        if white is None:
            self.w, self.b, self.back, self.back_b = self.filters, np.zeros(self.filters.shape[1]), self.filters.T, np.zeros(d)
        else:
            self.w, self.b = white.projection @ self.filters, -white.avg @ white.projection @ self.filters
            self.back, self.back_b = self.filters.T @ white.back, white.avg

    def projection_matrix(self) -> np.ndarray:
        return self.w

    def reconstruction_matrix(self) -> np.ndarray:
        return self.back

    def _column(self, x):
        return affine(x, self.w, self.b)

    def _inverse_column(self, y):
        return affine(y, self.back, self.back_b)


def _cumulants4(m4: np.ndarray) -> np.ndarray:
    """Fourth cumulants of white, centred rows."""
    e = np.eye(len(m4))
    return m4 - np.einsum("ij,kl->ijkl", e, e) - np.einsum("ik,jl->ijkl", e, e) - np.einsum("il,jk->ijkl", e, e)


def _turn(t: np.ndarray, g: np.ndarray) -> np.ndarray:
    for axis in range(t.ndim):
        t = np.moveaxis(np.tensordot(t, g, (axis, 0)), -1, axis)
    return t


class CuBICA(ICA):
    """Maximises the squared diagonal third and fourth cumulants by rotations of pairs of axes, on the moment tensors."""

    def _core(self, rows, d):
        c3, m4 = fourth_moments(rows, self.column, d)
        c4, q = _cumulants4(m4), np.eye(d)

        def gain(i: int, j: int, a: np.ndarray) -> np.ndarray:
            """The contrast of the pair at angles a: its two diagonal entries of each order."""
            c, s = np.cos(a), np.sin(a)
            out = 0.0
            for u in (np.stack([c, s]), np.stack([-s, c])):
                k3 = np.einsum("abc,an,bn,cn->n", c3[np.ix_([i, j], [i, j], [i, j])], u, u, u)
                k4 = np.einsum("abcd,an,bn,cn,dn->n", c4[np.ix_([i, j], [i, j], [i, j], [i, j])], u, u, u, u)
                out = out + k3**2 / 6 + k4**2 / 24
            return out

        for _ in range(2 + round(math.sqrt(d)) * 4):
            largest = 0.0
            for i in range(d):
                for j in range(i + 1, d):
                    center, width = 0.0, math.pi / 4
                    while width > 1e-10:
                        grid = center + np.linspace(-width, width, 33)
                        center, width = float(grid[np.argmax(gain(i, j, grid))]), width / 12
                    if gain(i, j, np.array([center]))[0] <= gain(i, j, np.zeros(1))[0] + 1e-15:
                        continue
                    g = np.eye(d)
                    g[i, i] = g[j, j] = math.cos(center)
                    g[j, i], g[i, j] = math.sin(center), -math.sin(center)
                    c3, c4, q = _turn(c3, g), _turn(c4, g), q @ g
                    largest = max(largest, abs(center))
            if largest <= self.limit:
                break
        return q


class JADE(ICA):
    """Joint diagonalisation of the fourth-cumulant matrices by Jacobi rotations in closed form; components by energy."""

    def __init__(self, limit: float = 1e-3, max_it: int = 1000, whitened: bool = False, white_dim=None, column: str = "x"):
        super().__init__(limit, whitened, white_dim, column)
        self.max_it = max_it

    def _core(self, rows, d):
        n = rows.count()
        c4 = _cumulants4(fourth_moments(rows, self.column, d)[1])
        mats = [c4[:, :, i, j] * (1.0 if i == j else math.sqrt(2.0)) for i in range(d) for j in range(i, d)]
        m, v = np.stack(mats), np.eye(d)
        threshold = self.limit**2 / math.sqrt(n)
        for _ in range(self.max_it):
            turned = False
            for p in range(d):
                for q in range(p + 1, d):
                    h = np.stack([m[:, p, p] - m[:, q, q], m[:, p, q] + m[:, q, p]])
                    g = h @ h.T
                    on, off = g[0, 0] - g[1, 1], g[0, 1] + g[1, 0]
                    a = 0.5 * math.atan2(off, on + math.hypot(on, off))
                    if abs(a) > threshold:
                        turned = True
                        r = np.eye(d)
                        r[p, p] = r[q, q] = math.cos(a)
                        r[p, q], r[q, p] = -math.sin(a), math.sin(a)
                        m, v = np.einsum("ai,kab,bj->kij", r, m, r), v @ r
            if not turned:
                break
        # Most energetic first: white rows share their energy, so by the kurtosis that each carries.
        order = np.argsort(-np.abs(np.einsum("abcd,ai,bi,ci,di->i", c4, v, v, v, v)), kind="stable")
        v = v[:, order]
        s = np.sign(v[0])
        return v * np.where(s == 0, 1, s)


def _nonlinearity(g: str, a: float):
    """(g(u), g'(u)) of a FastICA nonlinearity."""
    if g == "pow3":
        return lambda u: u**3, lambda u: 3 * u**2
    if g == "tanh":
        return lambda u: np.tanh(a * u), lambda u: a * (1 - np.tanh(a * u) ** 2)
    if g == "gaus":
        return lambda u: u * np.exp(-a * u**2 / 2), lambda u: (1 - a * u**2) * np.exp(-a * u**2 / 2)
    if g == "skew":
        return lambda u: u**2, lambda u: 0 * u
    raise ValueError(f"unknown nonlinearity {g}")


class FastICA(ICA):
    """Fixed-point iteration, one component after the other (``defl``) or all at once (``symm``), with fine-tuning.

    Each iteration is one pass of Spark over the persisted white rows; ``sample_size`` below 1 uses that share.
    """

    def __init__(self, approach: str = "defl", g: str = "pow3", fine_g: str | None = "pow3", mu: float = 1.0, fine_mu: float = 1.0, fine_tanh: float = 1.0, fine_gaus: float = 1.0, sample_size: float = 1.0, max_it: int = 500, max_it_fine: int = 100, failures: int = 5, limit: float = 1e-3, guess: np.ndarray | None = None, seed: int = 0, whitened: bool = False, white_dim=None, column: str = "x"):
        super().__init__(limit, whitened, white_dim, column)
        self.approach, self.g, self.fine_g, self.mu, self.fine_mu = approach, g, fine_g, mu, fine_mu
        self.fine_tanh, self.fine_gaus, self.sample_size = fine_tanh, fine_gaus, sample_size
        self.max_it, self.max_it_fine, self.failures, self.guess, self.seed = max_it, max_it_fine, failures, guess, seed

    def _step(self, rows: DataFrame, w: np.ndarray, g: str, mu: float) -> np.ndarray:
        f, df_ = _nonlinearity(g, self.fine_tanh if g == "tanh" else self.fine_gaus)
        d, k = w.shape

        def sums(x):
            u = x @ w
            return np.concatenate([(x.T @ f(u)).ravel(), df_(u).sum(0), (u * f(u)).sum(0)])

        s, n = _summed(rows, self.column, sums)
        xg, dg, ug = s[: d * k].reshape(d, k) / n, s[d * k : d * k + k] / n, s[d * k + k :] / n
        if mu == 1:
            return xg - w * dg
        return w - mu * (xg - w * ug) / np.where(np.abs(dg - ug) < 1e-12, 1e-12, dg - ug)

    def _core(self, rows, d):
        if self.sample_size < 1:
            rows = rows.sample(self.sample_size, self.seed)
        start = self.guess if self.guess is not None else np.linalg.qr(np.random.default_rng(self.seed).standard_normal((d, d)))[0]
        phases = [(self.g, self.mu, self.max_it)] + ([(self.fine_g, self.fine_mu, self.max_it_fine)] if self.fine_g and self.fine_g != self.g else [])
        if self.approach == "symm":
            q = start
            for g, mu, most in phases:
                for _ in range(most):
                    new = self._step(rows, q, g, mu)
                    new = new @ inverse_root(new.T @ new)
                    done = 1 - np.abs(np.diag(new.T @ q)).min() < self.limit
                    q = new
                    if done:
                        break
            return q
        rng, found, tries = np.random.default_rng(self.seed + 1), np.zeros((d, 0)), 0
        while found.shape[1] < d:
            w = start[:, found.shape[1]] if not tries else rng.standard_normal(d)
            ok = True
            for g, mu, most in phases:
                ok = False
                for _ in range(most):
                    w = w - found @ (found.T @ w)
                    w /= np.linalg.norm(w)
                    new = self._step(rows, w[:, None], g, mu)[:, 0]
                    new = new - found @ (found.T @ new)
                    new /= np.linalg.norm(new)
                    ok = min(np.linalg.norm(new - w), np.linalg.norm(new + w)) < self.limit
                    w = new
                    if ok:
                        break
            if not ok and tries < self.failures and found.shape[1] < d - 1:
                tries += 1
                continue
            tries, found = 0, np.concatenate([found, w[:, None]], 1)
        return found
