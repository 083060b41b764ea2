"""Locally linear embeddings. The training rows are collected, and their neighbours, weights and the eigenproblem, which
has one row and column for each of them, are solved on the driver, so their number is limited (``most_rows``). Any
number of rows can then be transformed, each by its nearest training rows, in parallel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, batch_udf


def _regular(q: np.ndarray, r: float | None, d: int) -> np.ndarray:
    """Q + r·trace(Q)·I; without r an estimate from the discarded eigenvalues of the row's own Q."""
    t = np.trace(q)
    if r is None:
        s = np.linalg.eigvalsh(q)[::-1]
        r = float((s[d:] ** 2).sum() / max(1e-300, (s**2).sum()))
    return q + (r * t if t > 0 else r or 1e-12) * np.eye(len(q))


class LLE(Node):
    trainable = True

    def __init__(self, k: int, output_dim: int | float = 2, r: float | None = 1e-3, most_rows: int = 5000, column: str = "x"):
        super().__init__(column)
        self.k, self.output_dim, self.r, self.most_rows = k, output_dim, r, most_rows

    def _rows(self, df: DataFrame) -> np.ndarray:
        n = df.count()
        if n > self.most_rows:
            raise TrainingError(f"{n} rows; the embedding solves an n × n eigenproblem on the driver, at most {self.most_rows}")
        return np.array([r[0] for r in df.select(self.column).collect()], float)

    def _neighbours(self, x: np.ndarray) -> np.ndarray:
        d2 = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
        np.fill_diagonal(d2, np.inf)
        return np.argsort(d2, 1, kind="stable")[:, : self.k]

    def _dims(self, x: np.ndarray, near: np.ndarray) -> int:
        if self.output_dim >= 1:
            return int(self.output_dim)
        need = []
        for i, ids in enumerate(near):
            s = np.linalg.svd(x[ids] - x[i], compute_uv=False) ** 2
            need.append(int(np.searchsorted(np.cumsum(s) / s.sum(), self.output_dim)) + 1)
        return int(np.ceil(np.mean(need)))

    def _fit(self, df):
        x = self._rows(df)
        near = self._neighbours(x)
        d = self._dims(x, near)
        w = np.zeros((len(x), len(x)))
        for i, ids in enumerate(near):
            m = x[ids] - x[i]
            v = np.linalg.solve(_regular(m @ m.T, self.r, d), np.ones(self.k))
            w[i, ids] = v / v.sum()
        # In place: each n × n matrix counts.
        np.negative(w, out=w)
        w.flat[:: len(x) + 1] += 1
        a = w.T @ w
        del w
        _, v = np.linalg.eigh(a)
        self.train, self.embedding = x, v[:, 1 : d + 1] * np.sqrt(len(x))

    def _column(self, c):
        x, y, k, r = self.train, self.embedding, self.k, self.r

        def run(m: np.ndarray) -> np.ndarray:
            out = np.empty((len(m), y.shape[1]))
            for i, row in enumerate(m):
                ids = np.argsort(((x - row) ** 2).sum(1), kind="stable")[:k]
                z = x[ids] - row
                v = np.linalg.solve(_regular(z @ z.T, r, y.shape[1]), np.ones(k))
                out[i] = v / v.sum() @ y[ids]
            return out

        return batch_udf(run)(F.col(c))


class HLLE(LLE):
    """Hessian variant: local tangent coordinates give Hessian estimators whose common null space is the embedding."""

    def _fit(self, df):
        x = self._rows(df)
        near = self._neighbours(x)
        d = self._dims(x, near)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        if self.k < 1 + d + len(pairs):
            raise TrainingError(f"k must be at least {1 + d + len(pairs)} for {d} dimensions")
        h = np.zeros((len(x), len(x)))
        for ids in near:
            m = x[ids] - x[ids].mean(0)
            u = np.linalg.svd(m, full_matrices=False)[0][:, :d]
            design = np.concatenate([np.ones((self.k, 1)), u, np.stack([u[:, i] * u[:, j] for i, j in pairs], 1)], 1)
            q = np.linalg.qr(design)[0][:, 1 + d :]
            s = q.sum(0)
            q = q / np.where(np.abs(s) < 1e-4, 1.0, s)
            h[np.ix_(ids, ids)] += q @ q.T
        _, v = np.linalg.eigh(h)
        y = v[:, 1 : d + 1]
        g = y.T @ y
        e, b = np.linalg.eigh(g)
        self.train, self.embedding = x, y @ (b / np.sqrt(e)) @ b.T * np.sqrt(len(x))
