"""Small dense solvers on the driver (numpy only); their inputs are moments, never rows."""

from __future__ import annotations

import numpy as np


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) with their component of largest magnitude positive."""
    if not v.size:
        return v
    at = np.argmax(np.abs(v), axis=0)
    s = np.sign(v[at, np.arange(v.shape[1])])
    return v * np.where(s == 0, 1.0, s)


def eigh_desc(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a symmetric matrix, largest first, with fixed signs."""
    d, v = np.linalg.eigh((a + a.T) / 2)
    return d[::-1].copy(), fix_signs(v[:, ::-1])


def gen_eigh(a: np.ndarray, b: np.ndarray | None = None, deficit: str = "none", threshold: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Ascending pairs with A v = d B v and vᵀ B v = 1.

    deficit says what to do where B has lost rank: ``none`` raises; ``pca`` (also ``auto`` and ``ldl``) and ``svd``
    work in the span of B; ``reg`` adds ``threshold`` to its diagonal and drops the directions that come from it.
    """
    if b is None:
        d, v = np.linalg.eigh((a + a.T) / 2)
        return d, fix_signs(v)
    a, b = (a + a.T) / 2, (b + b.T) / 2
    if deficit == "reg":
        noise = threshold * max(1.0, float(np.trace(b)) / len(b))
        s, u = np.linalg.eigh(b + noise * np.eye(len(b)))
    elif deficit == "svd":
        u, s, _ = np.linalg.svd(b)
    else:
        s, u = np.linalg.eigh(b)
    keep = s > threshold * max(float(s.max(initial=0.0)), 1e-300)
    if deficit == "none" and not keep.all():
        raise np.linalg.LinAlgError("the second matrix is not positive definite; choose a rank deficit method")
    w = u[:, keep] / np.sqrt(s[keep])
    d, v = np.linalg.eigh(w.T @ a @ w)
    v = w @ v
    if deficit == "reg":
        true = np.einsum("ij,ik,kj->j", v, b, v) > 0.5
        d, v = d[true], v[:, true]
    return d, fix_signs(v)


def nongeneral_svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values ascending with the matching left vectors."""
    u, s, _ = np.linalg.svd(a)
    return s[::-1].copy(), u[:, ::-1]


def sqrtm(a: np.ndarray) -> np.ndarray:
    d, v = np.linalg.eigh(a)
    return (v * np.sqrt(np.maximum(d, 0))) @ v.T


def inverse_root(a: np.ndarray) -> np.ndarray:
    d, v = np.linalg.eigh(a)
    return (v / np.sqrt(d)) @ v.T


def random_rotation(dim: int, seed: int) -> np.ndarray:
    """Haar-distributed rotation with determinant one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    q *= np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def random_symmetric(dim_or_values: int | np.ndarray, seed: int) -> np.ndarray:
    """A random symmetric matrix, of a size or with given eigenvalues."""
    if np.ndim(dim_or_values) == 0:
        a = np.random.default_rng(seed).uniform(-1, 1, (int(dim_or_values),) * 2)
        return (a + a.T) / 2
    d = np.asarray(dim_or_values, float)
    q = random_rotation(len(d), seed)
    return (q * d) @ q.T


def givens(mat: np.ndarray, angle: float, columns: tuple[int, int] = (0, 1), units: str = "radians") -> np.ndarray:
    """The matrix with two columns rotated by an angle."""
    if units == "degrees":
        angle = np.deg2rad(angle)
    i, j = columns
    out = mat.astype(float).copy()
    out[:, i] = np.cos(angle) * mat[:, i] + np.sin(angle) * mat[:, j]
    out[:, j] = -np.sin(angle) * mat[:, i] + np.cos(angle) * mat[:, j]
    return out


def permuted(x: np.ndarray, indices: tuple[int, int] = (0, 0), rows: bool = False, cols: bool = True) -> np.ndarray:
    """The matrix with two rows and/or columns exchanged."""
    out = x.copy()
    i, j = indices
    if rows:
        out[[i, j], :] = out[[j, i], :]
    if cols:
        out[:, [i, j]] = out[:, [j, i]]
    return out


def mult_diag(d: np.ndarray, m: np.ndarray, left: bool = True) -> np.ndarray:
    return d[:, None] * m if left else m * d


def covariance_maxima(cov: np.ndarray) -> list[float]:
    """Greedy: the largest magnitude, without its row and column, and so on."""
    c, out = np.abs(cov).copy(), []
    while c.size:
        i, j = np.unravel_index(np.argmax(c), c.shape)
        out.append(float(c[i, j]))
        c = np.delete(np.delete(c, i, 0), j, 1)
    return out


def gabor(size: tuple[int, int], alpha: float, phi: float, freq: float, sgm: tuple[float, float], x0=None, res: float = 1, ampl: float = 1.0) -> np.ndarray:
    """A Gabor patch: a cosine wave of direction alpha under a Gaussian."""
    rows, cols = size
    cx, cy = x0 if x0 is not None else ((rows - 1) / 2, (cols - 1) / 2)
    i, j = np.meshgrid((np.arange(rows) - cx) / res, (np.arange(cols) - cy) / res, indexing="ij")
    along, across = np.cos(alpha) * i + np.sin(alpha) * j, -np.sin(alpha) * i + np.cos(alpha) * j
    return ampl * np.exp(-0.5 * ((along / sgm[0]) ** 2 + (across / sgm[1]) ** 2)) * np.cos(2 * np.pi * freq * along + phi)


class QuadraticForm:
    """½ xᵀHx + fᵀx + c: values, extrema on a sphere, and second derivatives along the sphere."""

    def __init__(self, h: np.ndarray, f: np.ndarray | None = None, c: float = 0.0):
        self.h = (np.asarray(h, float) + np.asarray(h, float).T) / 2
        self.f = np.zeros(len(self.h)) if f is None else np.asarray(f, float)
        self.c = float(c)

    def value(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        return 0.5 * np.einsum("ni,ij,nj->n", x, self.h, x) + x @ self.f + self.c

    def extrema(self, norm: float, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
        """(x at the maximum, x at the minimum) of the form on the sphere of radius ``norm``."""
        return self._maximum(self.h, self.f, norm, tol), self._maximum(-self.h, -self.f, norm, tol)

    @staticmethod
    def _maximum(h: np.ndarray, f: np.ndarray, norm: float, tol: float) -> np.ndarray:
        d, v = np.linalg.eigh(h)
        g = v.T @ f
        top = d[-1]
        if np.allclose(g, 0, atol=tol):
            return norm * v[:, -1]
        size = lambda lam: np.sqrt(((g / (lam - d)) ** 2).sum())
        low, high = top + 1e-14 * max(1.0, abs(top)), top + np.linalg.norm(g) / norm + 1.0
        if size(low) < norm:  # no part of f along the top direction: fill up along it
            x = v[:, :-1] @ (g[:-1] / (top - d[:-1] + 1e-300))
            return x + np.sqrt(max(norm**2 - x @ x, 0)) * v[:, -1]
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if size(mid) > norm else (low, mid)
            if high - low < tol * max(1.0, abs(high)):
                break
        return v @ (g / ((low + high) / 2 - d))

    def invariances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(directions as columns, second derivatives) on the sphere through an extremum, flattest first."""
        norm = np.linalg.norm(x)
        base = np.linalg.svd(np.asarray(x, float)[None, :] / norm)[2][1:].T
        curve = base.T @ self.h @ base - (x @ (self.h @ x + self.f)) / norm**2 * np.eye(base.shape[1])
        d, v = np.linalg.eigh(curve)
        order = np.argsort(np.abs(d))
        return base @ v[:, order], d[order]
