"""Feature expansions as generated columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, batch_udf, opaque, parts, total, width_of


def monomials_of_degree(degree: int, variables: int) -> int:
    return comb(variables + degree - 1, degree)


def expanded_size(degree: int, variables: int) -> int:
    """Number of monomials of degree 1 to ``degree``."""
    return comb(variables + degree, degree) - 1


class _Wide(Node):
    """Expansions need the input width before the columns can be generated."""

    def __init__(self, input_dim: int | None = None, column: str = "x"):
        super().__init__(column)
        self.input_dim = input_dim

    def transform(self, df: DataFrame) -> DataFrame:
        if self.input_dim is None:
            self.input_dim = width_of(df, self.column)
        return super().transform(df)

    def fit(self, df: DataFrame):
        if self.input_dim is None:
            self.input_dim = width_of(df, self.column)
        return super().fit(df)


class PolynomialExpansion(_Wide):
    """All monomials up to a degree, graded: all of degree 1, then of degree 2, and so on."""

    def __init__(self, degree: int, input_dim: int | None = None, column: str = "x"):
        super().__init__(input_dim, column)
        self.degree = degree

    def terms(self) -> list[tuple[int, ...]]:
        return [t for d in range(1, self.degree + 1) for t in combinations_with_replacement(range(self.input_dim), d)]

    def _column(self, x):
        terms = self.terms()
        if len(terms) > 400:
            return batch_udf(lambda m: np.stack([np.prod(m[:, list(t)], axis=1) for t in terms], 1))(x)
        p = parts(x, self.input_dim)
        made: dict[tuple[int, ...], Column] = {}
        for t in terms:
            made[t] = p[t[0]] if len(t) == 1 else made[t[:-1]] * p[t[-1]]
        return opaque([made[t] for t in terms])


class QuadraticExpansion(PolynomialExpansion):
    """x1 … xn, x1x1, x1x2, … xnxn."""

    def __init__(self, input_dim: int | None = None, column: str = "x"):
        super().__init__(2, input_dim, column)


class RBFExpansion(Node):
    """Gaussians around centres: exp(-d²/2s) for a size s, or exp(-½ dᵀS⁻¹d) for a covariance matrix S."""

    def __init__(self, centers: np.ndarray, sizes, column: str = "x"):
        super().__init__(column)
        self.centers = np.asarray(centers, float)
        sizes = np.asarray(sizes, float)
        self.full = sizes.ndim == 3 or (sizes.ndim == 2 and sizes.shape == (self.centers.shape[1],) * 2 and len(self.centers) != 1)
        n = len(self.centers)
        self.sizes = (sizes if sizes.ndim == 3 else np.tile(sizes, (n, 1, 1))) if self.full else np.broadcast_to(sizes.ravel(), (n,)).copy()

    def _column(self, x):
        p = parts(x, self.centers.shape[1])
        out = []
        for i, c in enumerate(self.centers):
            d = [a - F.lit(float(b)) for a, b in zip(p, c, strict=True)]
            if self.full:
                inv = np.linalg.inv(self.sizes[i])
                q = total([F.lit(float(inv[a, b])) * d[a] * d[b] for a in range(len(d)) for b in range(len(d))])
            else:
                q = total([v * v for v in d]) / F.lit(float(self.sizes[i]))
            out.append(F.exp(F.lit(-0.5) * q))
        return F.array(*out)


class GeneralExpansion(_Wide):
    """The outputs of several functions, one after the other; each maps the list of input columns to a list of columns."""

    def __init__(self, functions: Sequence[Callable[[list[Column]], list[Column]]], input_dim: int | None = None, column: str = "x"):
        super().__init__(input_dim, column)
        self.functions = list(functions)

    def output_sizes(self) -> list[int]:
        zero = [F.lit(0.0)] * self.input_dim
        return [len(f(zero)) for f in self.functions]

    def _column(self, x):
        p = parts(x, self.input_dim)
        return F.array(*[c for f in self.functions for c in f(p)])


def pseudo_inverse(df: DataFrame, functions: Sequence[Callable[[np.ndarray], np.ndarray]], input_dim: int, column: str = "x", hint: str | None = None, rounds: int = 50, pull: float = 0.0) -> DataFrame:
    """Adds ``inverse``: per row the least-squares x with functions(x) ≈ the expanded row, by damped Gauss-Newton.

    functions map a matrix of rows (n × d) to one of outputs; ``hint`` names a vector column to start from,
    towards which ``pull`` draws the solution.
    """

    def value(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.asarray(f(x)) for f in functions], 1)

    def solve(y: np.ndarray, start: np.ndarray) -> np.ndarray:
        x, damp = start.copy(), np.full(len(y), 1e-3)
        cost = lambda z: ((value(z) - y) ** 2).sum(1) + pull**2 * ((z - start) ** 2).sum(1)
        now = cost(x)
        for _ in range(rounds):
            r = value(x) - y
            step = 1e-6
            jac = np.stack([(value(x + step * np.eye(input_dim)[i]) - value(x - step * np.eye(input_dim)[i])) / (2 * step) for i in range(input_dim)], 2)
            a = np.einsum("nki,nkj->nij", jac, jac) + (pull**2 + damp)[:, None, None] * np.eye(input_dim)
            g = np.einsum("nki,nk->ni", jac, r) + pull**2 * (x - start)
            new = x - np.linalg.solve(a, g[..., None])[..., 0]
            then = cost(new)
            better = then < now
            x = np.where(better[:, None], new, x)
            damp = np.where(better, damp / 3, damp * 5)
            now = np.where(better, then, now)
        return x

    @F.pandas_udf("array<double>")
    def run(y: pd.Series, start: pd.Series) -> pd.Series:
        if not len(y):
            return pd.Series([], dtype=object)
        return pd.Series(list(solve(np.stack(list(y)), np.stack(list(start)).astype(float))))

    begin = F.col(hint) if hint else F.array(*[F.lit(0.1)] * input_dim)
    return df.withColumn("inverse", run(F.col(column), begin))


def _standard(x: Column, n: int) -> list[Column]:
    out = [x]
    for _ in range(n - 1):
        out.append(out[-1] * x)
    return out


def _legendre(x: Column, n: int) -> list[Column]:
    p = [F.lit(1.0), x]
    for k in range(2, n + 1):
        p.append((F.lit(2.0 * k - 1) * x * p[-1] - F.lit(k - 1.0) * p[-2]) / F.lit(float(k)))
    return p[1 : n + 1]


def _legendre_rational(x: Column, n: int) -> list[Column]:
    return _legendre((x - 1) / (x + 1), n)


def _chebyshev(x: Column, n: int) -> list[Column]:
    t = [F.lit(1.0), x]
    for _ in range(2, n + 1):
        t.append(F.lit(2.0) * x * t[-1] - t[-2])
    return t[1 : n + 1]


#: name: (terms of degree 1 to n of one variable, domain low, domain high)
RECURRENCES: dict[str, tuple[Callable, float, float]] = {
    "standard_poly": (_standard, -np.inf, np.inf),
    "legendre_poly": (_legendre, -1.0, 1.0),
    "legendre_rational": (_legendre_rational, 0.0, np.inf),
    "chebyshev_poly": (_chebyshev, -1.0, 1.0),
}


class RecursiveExpansion(_Wide):
    """Tensor products of a recurrence in each variable, of total degree up to ``degree``; ``with0`` adds the constant 1.

    Order: graded, within a degree by variable as in :class:`PolynomialExpansion`. With ``check``, a row
    outside the recurrence's domain fails the query.
    """

    def __init__(self, degree: int = 1, recurrence: str = "standard_poly", check: bool = False, with0: bool = True, input_dim: int | None = None, column: str = "x"):
        super().__init__(input_dim, column)
        if recurrence not in RECURRENCES:
            raise ValueError(f"unknown recurrence {recurrence}")
        self.degree, self.recurrence, self.check, self.with0 = degree, recurrence, check, with0

    def _inputs(self, x) -> list[Column]:
        return parts(x, self.input_dim)

    def _column(self, x):
        f, low, high = RECURRENCES[self.recurrence]
        p = self._inputs(x)
        if self.check:
            p = [F.when((c >= low) & (c <= high), c).otherwise(F.raise_error(F.lit(f"value outside the domain of {self.recurrence}")).cast("double")) for c in p]
        single = [f(c, self.degree) for c in p]
        out = [F.lit(1.0)] if self.with0 else []
        for d in range(1, self.degree + 1):
            for term in combinations_with_replacement(range(self.input_dim), d):
                factors = [single[v][term.count(v) - 1] for v in sorted(set(term))]
                c = factors[0]
                for g in factors[1:]:
                    c = c * g
                out.append(c)
        return opaque(out)


class NormalizingRecursiveExpansion(RecursiveExpansion):
    """As above, after an affine map of each variable's training range onto the domain (0 to 1 for half-open domains)."""

    trainable = True

    def __init__(self, degree: int = 1, recurrence: str = "standard_poly", check: bool = True, with0: bool = True, input_dim: int | None = None, column: str = "x"):
        super().__init__(degree, recurrence, check, with0, input_dim, column)
        self.low = self.high = None

    def _fit(self, df):
        p = parts(self.column, self.input_dim)
        r = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(p)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(p)]).first()
        if r is None or r[0] is None:
            raise TrainingError("no rows to fit on")
        self.low = np.array([r[f"a{i}"] for i in range(len(p))])
        self.high = np.array([r[f"b{i}"] for i in range(len(p))])

    def _inputs(self, x):
        _, a, b = RECURRENCES[self.recurrence]
        if not np.isfinite(b):
            a, b = (0.0, 1.0) if a == 0 else (-1.0, 1.0)
        out = []
        for c, low, high in zip(parts(x, self.input_dim), self.low, self.high, strict=True):
            span = (high - low) or 1.0
            y = (c - F.lit(float(low))) / F.lit(float(span)) * F.lit(b - a) + F.lit(a)
            out.append(F.greatest(F.lit(a), F.least(F.lit(b), y)) if self.check else y)
        return out
