"""Slow feature analysis and its relatives; every variant is one set of moments and one generalised eigenproblem."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Node, TrainingError, affine, ordered, parts, width_of
from ..functions.linalg import QuadraticForm, gen_eigh
from .decomposition import PCA, Whitening
from .expansions import QuadraticExpansion
from .moments import Moments, moments
from .timeops import delay_covariance, rate_of_change, time_difference, weighted_time_moments


class SFA(Node):
    """Slowest directions: uncentred covariance of Δx against the covariance of x, eigenvalues ascending.

    include_last_sample: whether the last row of each chunk counts for the covariance of x.
    """

    trainable = invertible = True

    def __init__(self, output_dim: int | None = None, order: str = "t", chunk: str | None = None, include_last_sample: bool = True, rank_deficit: str = "none", column: str = "x"):
        super().__init__(column)
        self.output_dim, self.order, self.chunk = output_dim, order, chunk
        self.include_last_sample, self.rank_deficit = include_last_sample, rank_deficit

    def _moments(self, df: DataFrame) -> tuple[Moments, Moments]:
        diff = time_difference(df, self.order, self.chunk, self.column)
        rows = df
        if not self.include_last_sample:
            rows = df.withColumn("next__", F.lead(self.column).over(ordered(self.order, self.chunk))).where("next__ is not null")
        return moments(rows, self.column), moments(diff, self.column)

    def _fit(self, df):
        x, dx = self._moments(df)
        self.solve(dx.covariance(center=False), x.covariance(), x.mean())

    def solve(self, dcov: np.ndarray, cov: np.ndarray, mean: np.ndarray) -> None:
        d, v = gen_eigh(dcov, cov, self.rank_deficit)
        k = self.output_dim or len(d)
        self.d, self.sf, self.avg = d[:k], v[:, :k], mean
        self.fitted = True

    def eta_values(self, t: float = 1.0) -> np.ndarray:
        return t / (2 * math.pi) * np.sqrt(np.maximum(self.d, 0))

    def _column(self, x):
        return affine(x, self.sf, -self.avg @ self.sf)

    def _inverse_column(self, y):
        return affine(y, np.linalg.pinv(self.sf), self.avg)

    def reduced(self, output_dim: int):
        out = self.copy()
        out.d, out.sf = self.d[:output_dim], self.sf[:, :output_dim]
        return out


class VartimeSFA(SFA):
    """SFA on unevenly spaced rows: Δx/Δt weighted by Δt, trapezoid-weighted covariance; ``order`` is the time in numbers."""

    def _moments(self, df):
        x = weighted_time_moments(df, self.order, self.chunk, self.column)
        rate = rate_of_change(df, self.order, self.chunk, self.column)
        return x, moments(rate, self.column, F.col("dt"))

    def _fit(self, df):
        x, dx = self._moments(df)
        self.solve(dx.ss / dx.n, x.covariance(bias=True), x.mean())


class SFA2(SFA):
    """SFA on the quadratic expansion; each output is a quadratic form of the input."""

    def _expand(self, df: DataFrame) -> DataFrame:
        self.input_dim = getattr(self, "input_dim", None) or width_of(df, self.column)
        return QuadraticExpansion(self.input_dim, self.column).transform(df)

    def _fit(self, df):
        super()._fit(self._expand(df))

    def transform(self, df):
        self._ready()
        return super().transform(self._expand(df))

    def inverse_transform(self, df):
        raise TrainingError("SFA2 has no inverse")

    def quadratic_form(self, nr: int) -> QuadraticForm:
        n, w = self.input_dim, self.sf[:, nr]
        h, at = np.zeros((n, n)), n
        for i in range(n):
            for j in range(i, n):
                h[i, j] += w[at]
                h[j, i] += w[at]
                at += 1
        return QuadraticForm(h, w[:n], float(-self.avg @ w))


def _offdiagonal(c: np.ndarray) -> float:
    return float((c**2).sum() - (np.diag(c) ** 2).sum())


def joint_rotation(covs: list[np.ndarray], limit: float, sweeps: int, score) -> np.ndarray:
    """Givens sweeps over pairs of axes, each to the best angle of a coarse-to-fine search of ``score`` (smaller is better)."""
    n, q = len(covs[0]), np.eye(len(covs[0]))

    def turned(i: int, j: int, a: float) -> list[np.ndarray]:
        g = np.eye(n)
        g[i, i] = g[j, j] = math.cos(a)
        g[i, j], g[j, i] = -math.sin(a), math.sin(a)
        return [g.T @ c @ g for c in covs], g

    for _ in range(sweeps):
        largest = 0.0
        for i in range(n):
            for j in range(i + 1, n):
                center, width = 0.0, math.pi / 4
                while width > limit / 10:
                    grid = center + np.linspace(-width, width, 9)
                    center = float(min(grid, key=lambda a: score(turned(i, j, a)[0])))
                    width /= 4
                if score(turned(i, j, center)[0]) < score(covs) - 1e-15 and abs(center) > limit / 100:
                    covs, g = turned(i, j, center)
                    q = q @ g
                    largest = max(largest, abs(center))
        if largest <= limit:
            break
    return q


class ISFA(Node):
    """Independent slow features: after whitening, a rotation that makes lagged covariances diagonal (weight b_ica)
    and the outputs slow (weight b_sfa: large squared lagged autocovariances of the first ``output_dim`` axes)."""

    trainable = invertible = True

    def __init__(self, lags: int | list[int] = 1, output_dim: int | None = None, sfa_ica: tuple[float, float] = (1.0, 1.0), order: str = "t", chunk: str | None = None, whitened: bool = False, limit: float = 1e-6, max_sweeps: int = 100, column: str = "x"):
        super().__init__(column)
        self.lags = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
        self.output_dim, self.sfa_ica, self.order, self.chunk = output_dim, sfa_ica, order, chunk
        self.whitened, self.limit, self.max_sweeps = whitened, limit, max_sweeps

    def _fit(self, df):
        self.white = None if self.whitened else Whitening(column=self.column).fit(df)
        rows = df if self.white is None else self.white.transform(df)
        rows = rows.persist()
        covs = [delay_covariance(rows, k, self.order, self.chunk, self.column) for k in self.lags]
        rows.unpersist()
        covs = [(c + c.T) / 2 for c in covs]
        n = len(covs[0])
        k, (b_sfa, b_ica) = self.output_dim or n, self.sfa_ica

        def score(cs):
            return sum(b_ica * _offdiagonal(c[:k, :k]) - b_sfa * (np.diag(c)[:k] ** 2).sum() for c in cs)

        # Start from the slowest directions first, so that the first k axes are the ones to keep.
        d, v = np.linalg.eigh(sum(covs))
        v = v[:, ::-1]
        q = v @ joint_rotation([v.T @ c @ v for c in covs], self.limit, self.max_sweeps, score)
        self.rotation = q[:, :k]
        self._compose()

    def _compose(self) -> None:
        if self.white is None:
            self.w, self.b, self.back, self.back_b = self.rotation, np.zeros(self.rotation.shape[1]), self.rotation.T, np.zeros(len(self.rotation))
        else:
            self.w = self.white.projection @ self.rotation
            self.b = -self.white.avg @ self.w
            self.back, self.back_b = self.rotation.T @ self.white.back, self.white.avg

    def _column(self, x):
        return affine(x, self.w, self.b)

    def _inverse_column(self, y):
        return affine(y, self.back, self.back_b)


class TDSEP(ISFA):
    """Blind separation from lagged covariances alone: ISFA with the coefficients (0, 1)."""

    def __init__(self, lags: int | list[int] = 1, order: str = "t", chunk: str | None = None, whitened: bool = False, limit: float = 1e-5, max_sweeps: int = 100, column: str = "x"):
        super().__init__(lags, None, (0.0, 1.0), order, chunk, whitened, limit, max_sweeps, column)


class Projection(Node):
    """Takes out of the columns ``x`` their projection on the sources' expansion ``s``: x − s·C, C the cross-covariance."""

    trainable = True

    def __init__(self, sources: str = "s", column: str = "x"):
        super().__init__(column)
        self.sources = sources

    def _fit(self, df):
        from .moments import cross_covariance

        self.c = cross_covariance(df, self.sources, self.column)

    def transform(self, df):
        self._ready()
        d = self.c.shape[1]
        out = df.withColumn("p__", affine(self.sources, self.c))
        q = parts("p__", d)
        return out.withColumn(self.column, F.array(*[c - q[i] for i, c in enumerate(parts(self.column, d))])).drop("p__")


class XSFA(Node):
    """Sources one by one: expand, take the slowest output, remove from the rest what a (whitened, normalised)
    expansion of the sources so far explains, and go on."""

    trainable = True

    def __init__(self, n_sources: int, basic_degree: int = 2, intern_degree: int = 2, order: str = "t", chunk: str | None = None, column: str = "x"):
        super().__init__(column)
        self.n_sources, self.basic_degree, self.intern_degree, self.order, self.chunk = n_sources, basic_degree, intern_degree, order, chunk

    def _expanded(self, degree: int, column: str):
        from .expansions import PolynomialExpansion

        return PolynomialExpansion(degree, column=column)

    def _fit(self, df):
        self.basic = self._expanded(self.basic_degree, self.column)
        rows = self.basic.fit(df).transform(df)
        self.first = Whitening(reduce=True, var_rel=1e-9, column=self.column).fit(rows)
        rows = self.first.transform(rows).withColumn("s", F.array().cast("array<double>"))
        self.steps = []
        for k in range(self.n_sources):
            rows = rows.persist()
            sfa = SFA(1, self.order, self.chunk, rank_deficit="pca", column=self.column).fit(rows)
            rows = rows.withColumn("s", F.concat("s", sfa._column(self.column)))
            step = {"sfa": sfa}
            if k + 1 < self.n_sources:
                intern = self._expanded(self.intern_degree, "e").fit(rows.withColumn("e", F.col("s")))
                exp = intern.transform(rows.withColumn("e", F.col("s")))
                white = Whitening(reduce=True, var_rel=1e-9, column="e").fit(exp)
                exp = white.transform(exp)
                out = Projection("e", self.column).fit(exp)
                left = out.transform(exp)
                rest = Whitening(reduce=True, var_rel=1e-7, column=self.column).fit(left)
                rows = rest.transform(left).drop("e")
                step |= {"intern": intern, "white": white, "out": out, "rest": rest}
            self.steps.append(step)

    def transform(self, df):
        self._ready()
        rows = self.first.transform(self.basic.transform(df)).withColumn("s", F.array().cast("array<double>"))
        for step in self.steps:
            rows = rows.withColumn("s", F.concat("s", step["sfa"]._column(self.column)))
            if "out" in step:
                rows = step["white"].transform(step["intern"].transform(rows.withColumn("e", F.col("s"))))
                rows = step["rest"].transform(step["out"].transform(rows)).drop("e")
        return rows.withColumn(self.column, F.col("s")).drop("s")


class GraphMoments:
    """Σw, Σw x, Σw xxᵀ of samples and Σw, Σw ΔΔᵀ of differences; both are divided by their own weights, not n − 1."""

    def __init__(self, d: int):
        self.x = Moments(0.0, np.zeros(d), np.zeros((d, d)))
        self.n_diffs, self.dd = 0.0, np.zeros((d, d))

    def add_samples(self, m: Moments, weight: float = 1.0) -> None:
        self.x = Moments(self.x.n + weight * m.n, self.x.s + weight * m.s, self.x.ss + weight * m.ss)

    def add_diffs(self, dd: np.ndarray, n: float, weight: float = 1.0) -> None:
        self.dd, self.n_diffs = self.dd + weight * dd, self.n_diffs + weight * n

    def merge(self, other: GraphMoments, weight: float = 1.0, own_weight: float = 1.0) -> None:
        x = self.x
        self.x = Moments(own_weight * x.n + weight * other.x.n, own_weight * x.s + weight * other.x.s, own_weight * x.ss + weight * other.x.ss)
        self.dd, self.n_diffs = own_weight * self.dd + weight * other.dd, own_weight * self.n_diffs + weight * other.n_diffs

    def fix(self, center: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covariance of x, mean, covariance of differences)."""
        mean = self.x.s / self.x.n
        cov = self.x.ss / self.x.n - (np.outer(mean, mean) if center else 0)
        if not self.n_diffs:
            raise TrainingError("the training graph has no edges")
        return cov, mean, self.dd / self.n_diffs


def graph_moments(df: DataFrame, mode: str, order: str = "t", column: str = "x", weight: float = 1.0, half: int = 2, block: str | None = None, block_size: int | None = None, edges: DataFrame | None = None, node_weight: str | None = None, self_loops: bool = True) -> GraphMoments:
    """The moments of one training graph over the rows of ``df``.

    modes: ``unlabeled`` (samples only), ``regular`` (neighbours in order), ``window``, ``mirror_window`` and
    ``truncate_window`` (all pairs up to ``half`` apart, with ramps, mirrored or cut ends), ``clustered`` (all pairs
    within a block), ``serial`` (all pairs of rows of neighbouring blocks), ``graph`` (``edges``: src, dst, w on ``order``).
    ``block`` names a column; without it blocks are ``block_size`` rows in order.
    """
    d = width_of(df, column)
    g = GraphMoments(d)
    w = Window.orderBy(order)
    if mode == "unlabeled":
        g.add_samples(moments(df, column), weight)
    elif mode == "regular":
        g.add_samples(moments(df, column), weight)
        m = moments(time_difference(df, order, None, column), column)
        g.add_diffs(m.ss, m.n, weight)
    elif mode in ("window", "truncate_window", "mirror_window"):
        rows = df.withColumn("i__", F.row_number().over(w) - 1).select("i__", F.col(column).alias("x"))
        n = df.count()
        if mode == "mirror_window":
            left = rows.where((F.col("i__") >= 1) & (F.col("i__") <= half)).select((-F.col("i__")).alias("i__"), "x")
            right = rows.where((F.col("i__") <= n - 2) & (F.col("i__") >= n - 1 - half)).select((F.lit(2 * (n - 1)) - F.col("i__")).alias("i__"), "x")
            padded = rows.unionByName(left).unionByName(right)
            g.add_samples(moments(rows, "x"), weight * 2 * half)
        else:
            padded = rows
            i = F.col("i__")
            ramp = F.least(i, F.lit(half)) + F.least(F.lit(n - 1) - i, F.lit(half))
            g.add_samples(moments(rows, "x", ramp if mode == "window" else F.lit(2.0 * half)), weight)
        order_w = Window.orderBy("i__")
        for k in range(1, half + 1):
            pair = padded.select("i__", "x", F.lead("x", k).over(order_w).alias("y")).where("y is not null")
            if mode == "mirror_window":
                inside = ((F.col("i__") >= 0) & (F.col("i__") < n)).cast("int") + ((F.col("i__") + k >= 0) & (F.col("i__") + k < n)).cast("int")
                pair = pair.withColumn("w__", inside.cast("double")).where("w__ > 0")
            else:
                pair = pair.withColumn("w__", F.lit(2.0))
            a, b = parts("x", d), parts("y", d)
            m = moments(pair.select(F.array(*[b[i] - a[i] for i in range(d)]).alias("x"), "w__"), "x", F.col("w__"), d)
            g.add_diffs(m.ss, m.n, weight)
    elif mode in ("clustered", "serial"):
        from .moments import moments_by

        rows = df if block else df.withColumn("block__", F.floor((F.row_number().over(w) - 1) / F.lit(block_size)))
        groups = {k: m for k, m in sorted(moments_by(rows, column, block or "block__").items())}
        if mode == "clustered":
            for m in groups.values():
                g.add_samples(m, weight)
                # Σ over all ordered pairs of a block of (xj−xi)(xj−xi)ᵀ = 2 (n Σxxᵀ − ΣxΣxᵀ), scaled to n rows of weight.
                pairs = m.n**2 if self_loops else m.n * (m.n - 1)
                if pairs > 0:
                    dd = 2 * (m.n * m.ss - np.outer(m.s, m.s))
                    g.add_diffs(dd * (m.n / pairs), m.n, weight)
        else:
            blocks = list(groups.values())
            for k, m in enumerate(blocks):
                g.add_samples(m, weight * (1.0 if k in (0, len(blocks) - 1) else 2.0))
            for p, q in zip(blocks[:-1], blocks[1:], strict=True):
                cross = np.outer(p.s, q.s)
                dd = q.n * p.ss + p.n * q.ss - cross - cross.T
                scale = (p.n + q.n) / (2 * p.n * q.n)
                g.add_diffs(dd * scale, p.n * q.n * scale, weight)
    elif mode == "graph":
        nodes = df.select(F.col(order).alias("id"), F.col(column).alias("x"), (F.col(node_weight) if node_weight else F.lit(1.0)).alias("v"))
        g.add_samples(moments(nodes, "x", F.col("v"), d), weight)
        a = nodes.select(F.col("id").alias("src"), F.col("x").alias("a__"))
        b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("b__"))
        pair = edges.join(a, "src").join(b, "dst")
        p, q = parts("a__", d), parts("b__", d)
        m = moments(pair.select(F.array(*[q[i] - p[i] for i in range(d)]).alias("x"), "w"), "x", F.col("w"), d)
        g.add_diffs(m.ss, m.n, weight)
    else:
        raise ValueError(f"unknown training graph {mode}")
    return g


class GSFA(SFA):
    """Graph-based slow feature analysis; ``fit`` takes one mode or a list of (mode, arguments) that add up."""

    def __init__(self, mode="regular", output_dim: int | None = None, order: str = "t", rank_deficit: str = "none", column: str = "x", **how):
        super().__init__(output_dim, order, None, True, rank_deficit, column)
        self.mode, self.how = mode, how

    def _graph(self, df: DataFrame, mode, how: dict) -> GraphMoments:
        if mode == "classification":  # all pairs of rows of a label
            return graph_moments(df, "clustered", self.order, self.column, block=how.get("label", "label"), weight=how.get("weight", 1.0))
        if mode == "serial_regression":  # rows by label, in n equal blocks
            ranked = df.withColumn("b__", F.ntile(how["blocks"]).over(Window.orderBy(how.get("label", "label"), self.order)))
            return graph_moments(ranked, "serial", self.order, self.column, block="b__", weight=how.get("weight", 1.0))
        if mode == "mixed":
            size, n = how["block_size"], df.count()
            g = graph_moments(df, "serial", self.order, self.column, block_size=size)
            i = F.row_number().over(Window.orderBy(self.order)) - 1
            ends = df.withColumn("b__", F.floor(i / F.lit(size))).where((F.col("b__") == 0) | (F.col("b__") == (n - 1) // size))
            g.merge(graph_moments(ends, "clustered", self.order, self.column, block="b__"), 2.0)
            return g
        if mode == "dual_serial":  # serial by order, and with the second pass's weight serial by label
            g = graph_moments(df, "serial", self.order, self.column, block_size=how["block_size"])
            if how.get("label_weight", 0.0):
                by = df.withColumn("b__", F.ntile(how["blocks"]).over(Window.orderBy(how.get("label", "label"), self.order)))
                g.merge(graph_moments(by, "serial", self.order, self.column, block="b__"), how["label_weight"])
            return g
        if mode == "ignore_data":
            return GraphMoments(width_of(df, self.column))
        if mode == "compact_classes":  # each bit of the row's block number is a two-class problem
            n = df.count()
            size = how["block_size"]
            classes = max(1, n // size)
            if classes & (classes - 1):
                raise ValueError("the number of classes must be a power of two")
            rows = df.withColumn("c__", F.floor((F.row_number().over(Window.orderBy(self.order)) - 1) / F.lit(size)).cast("int"))
            out = None
            for j in range(how.get("features", classes.bit_length() - 1)):
                g = graph_moments(rows.withColumn("b__", F.shiftright("c__", j).bitwiseAND(1)), "clustered", self.order, self.column, block="b__")
                out = g if out is None else out
                if out is not g:
                    out.merge(g)
            return out
        return graph_moments(df, mode, self.order, self.column, **how)

    def _fit(self, df):
        modes = self.mode if isinstance(self.mode, list) else [(self.mode, self.how)]
        df = df.persist()
        whole = None
        for mode, how in modes:
            g = self._graph(df, mode, how)
            if whole is None:
                whole = g
            else:
                whole.merge(g)
        df.unpersist()
        cov, mean, dcov = whole.fix()
        self.solve(dcov, cov, mean)


def graph_delta_values(df: DataFrame, edges: DataFrame, order: str = "t", column: str = "x") -> np.ndarray:
    """Σ w (yj − yi)² / Σ w of each variable."""
    g = graph_moments(df, "graph", order, column, edges=edges)
    return np.diag(g.dd) / g.n_diffs


class IGSFA(Node):
    """Slow part and principal part: GSFA outputs slower than ``delta_threshold`` (or a fixed number), scaled by their
    effect on the input, then principal components fill up to ``output_dim``.

    With ``reconstruct`` the principal part is taken of what is left after the slow part's linear reconstruction;
    by default of the input as it is. scaling: None, ``data_dependent``, ``QR_decomposition`` or ``sensitivity_based``.
    """

    trainable = invertible = True

    def __init__(self, output_dim: int, delta_threshold: float | int = 1.999, scaling: str | None = None, reconstruct: bool = False, expansion=None, order: str = "t", mode="regular", column: str = "x", **how):
        super().__init__(column)
        self.output_dim, self.delta_threshold, self.scaling, self.reconstruct = output_dim, delta_threshold, scaling, reconstruct
        self.expansion, self.order, self.mode, self.how = expansion, order, mode, how

    def _expand(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("e__", F.col(self.column))
        return rows if self.expansion is None else self.expansion.transform(rows)

    def _fit(self, df):
        from .decomposition import LinearRegression

        if self.expansion is not None:
            self.expansion.column = "e__"
        rows = self._expand(df).persist()
        self.gsfa = GSFA(self.mode, None, self.order, "pca", "e__", **self.how).fit(rows)
        slow = self.delta_threshold if isinstance(self.delta_threshold, int) else int((self.gsfa.d <= self.delta_threshold).sum())
        slow = max(0, min(slow, self.output_dim, len(self.gsfa.d)))
        self.gsfa = self.gsfa.reduced(slow)
        rows = self.gsfa.transform(rows)
        left = rows
        self.scale, self.regression = np.eye(slow), None
        if slow:
            self.regression = LinearRegression(target=self.column, column="e__").fit(rows)
            effect = self.regression.beta[1:]
            if self.scaling == "data_dependent":
                self.scale = np.eye(slow) * np.linalg.norm(effect, axis=1)
            elif self.scaling == "QR_decomposition":
                self.scale = np.linalg.qr(effect.T)[1].T
            elif self.scaling == "sensitivity_based":
                self.scale = np.diag(np.sqrt((effect**2).sum(1)))
            if self.reconstruct:
                back = affine("e__", effect, self.regression.beta[0])
                d = effect.shape[1]
                r = parts("r__", d)
                left = rows.withColumn("r__", back).withColumn(self.column, F.array(*[c - r[i] for i, c in enumerate(parts(self.column, d))]))
        self.pca = PCA(self.output_dim - slow, column=self.column).fit(left) if self.output_dim > slow else None
        rows.unpersist()
        self.slow = slow

    def transform(self, df):
        self._ready()
        rows = self.gsfa.transform(self._expand(df))
        left = rows
        if self.reconstruct and self.slow:
            d = self.regression.beta.shape[1]
            r = parts("r__", d)
            left = rows.withColumn("r__", self.regression._column("e__")).withColumn(self.column, F.array(*[c - r[i] for i, c in enumerate(parts(self.column, d))])).drop("r__")
        fill = self.pca._column(self.column) if self.pca else F.array().cast("array<double>")
        return left.withColumn(self.column, F.concat(affine("e__", self.scale), fill)).drop("e__")

    def _inverse_column(self, y):
        k = self.slow
        out = None
        if self.pca:
            w = np.concatenate([np.zeros((k, self.pca.back.shape[1])), self.pca.back])
            out = (w, self.pca.avg)
        if k and (self.reconstruct or not self.pca):
            effect = np.linalg.inv(self.scale) @ self.regression.beta[1:]
            w = np.zeros((self.output_dim if self.pca else k, effect.shape[1]))
            w[:k] = effect
            out = (w, self.regression.beta[0]) if out is None else (w + out[0], out[1] + self.regression.beta[0])
        return affine(y, *out)
