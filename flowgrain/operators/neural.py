"""Restricted Boltzmann machines and neural gases. Their updates are sequential by nature: rows are folded in order by
one task for each epoch (or mini-batches are summed in Spark, for the machines' gradients)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, affine, batch_udf, parts, total, width_of
from .ica import _summed


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class RBM(Node):
    """Binary visible and hidden units by contrastive divergence; each update is one aggregate over the batch's rows."""

    trainable = True

    def __init__(self, hidden: int, n_updates: int = 1, epochs: int = 1, rate: float = 0.1, decay: float = 0.0, momentum: float = 0.0, seed: int = 0, column: str = "x"):
        super().__init__(column)
        self.hidden, self.n_updates, self.epochs, self.rate, self.decay, self.momentum, self.seed = hidden, n_updates, epochs, rate, decay, momentum, seed
        self.w = None

    def _visible(self, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        p = _sigmoid(h @ self.w.T + self.bv)
        return (rng.random(p.shape) < p).astype(float)

    def _fit(self, df):
        rows = df.select(self.column).persist()
        v = width_of(rows, self.column)
        rng = np.random.default_rng(self.seed)
        if self.w is None:
            self.w, self.bv, self.bh = rng.standard_normal((v, self.hidden)) * 0.1, np.zeros(v), np.zeros(self.hidden)
            self.dw, self.dbv, self.dbh = np.zeros_like(self.w), np.zeros(v), np.zeros(self.hidden)
        for epoch in range(self.epochs):
            self._update(rows, v, epoch)
        rows.unpersist()

    def _update(self, rows: DataFrame, v: int, epoch: int) -> None:
        me, h, steps, seed = self, self.hidden, self.n_updates, self.seed

        def sums(x):
            r = np.random.default_rng([seed, epoch, int(abs(x.sum() * 1e3)) % (1 << 31), len(x)])
            p0 = _sigmoid(x @ me.w + me.bh)
            s = (r.random(p0.shape) < p0).astype(float)
            for _ in range(steps):
                y = me._visible(s, r)
                p = _sigmoid(y @ me.w + me.bh)
                s = (r.random(p.shape) < p).astype(float)
            return np.concatenate([(x.T @ p0 - y.T @ p).ravel(), (x - y).sum(0), (p0 - p).sum(0)])

        s, n = _summed(rows, self.column, sums)
        s = s / n
        self.dw = self.momentum * self.dw + self.rate * (s[: v * h].reshape(v, h) - self.decay * self.w)
        self.dbv = self.momentum * self.dbv + self.rate * s[v * h : v * h + v]
        self.dbh = self.momentum * self.dbh + self.rate * s[v * h + v :]
        self.w, self.bv, self.bh = self.w + self.dw, self.bv + self.dbv, self.bh + self.dbh

    def _column(self, x: str) -> Column:
        """Probabilities of the hidden units."""
        return F.transform(affine(x, self.w, self.bh), lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a)))

    def sample_hidden(self, df: DataFrame, seed: int = 0, name: str = "h") -> DataFrame:
        p = df.withColumn("p__", self._column(self.column))
        return p.withColumn(name, F.array(*[(F.rand(seed + i) < c).cast("double") for i, c in enumerate(parts("p__", self.hidden))])).drop("p__")

    def sample_visible(self, df: DataFrame, hidden: str = "h", seed: int = 0, name: str = "v") -> DataFrame:
        p = df.withColumn("p__", F.transform(affine(hidden, self.w.T, self.bv), lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a))))
        return p.withColumn(name, F.array(*[(F.rand(seed + i) < c).cast("double") for i, c in enumerate(parts("p__", len(self.bv)))])).drop("p__")

    def energy(self, visible: str, hidden: str) -> Column:
        """−v·bv − h·bh − vᵀWh."""
        v, h = parts(visible, len(self.bv)), parts(hidden, len(self.bh))
        terms = [-c * F.lit(float(b)) for c, b in zip(v, self.bv, strict=True)] + [-c * F.lit(float(b)) for c, b in zip(h, self.bh, strict=True)]
        return total(terms + [-a * b * F.lit(float(self.w[i, j])) for i, a in enumerate(v) for j, b in enumerate(h)])


class RBMWithLabels(RBM):
    """The last ``labels`` visible units are one-of-n and drawn from their softmax."""

    def __init__(self, hidden: int, labels: int, **kw):
        super().__init__(hidden, **kw)
        self.labels = labels

    def _visible(self, h, rng):
        a = h @ self.w.T + self.bv
        n = a.shape[1] - self.labels
        out = np.zeros_like(a)
        out[:, :n] = rng.random((len(a), n)) < _sigmoid(a[:, :n])
        z = a[:, n:] + rng.gumbel(size=(len(a), self.labels))
        out[np.arange(len(a)), n + z.argmax(1)] = 1
        return out


def _fold(df: DataFrame, column: str, order: str | Column, f, epochs: int = 1) -> dict:
    """Feed the rows in order to ``f(state, row)``, in one task that streams them; returns the final state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            for row in pdf["x"]:
                f(state, np.asarray(row, float))
        if state:
            import json

            yield pd.DataFrame({"s": [json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in state.items() if not k.startswith("_")})]})

    import json

    rows = df.select(F.col(column).alias("x"), (F.col(order) if isinstance(order, str) else order).alias("t")).coalesce(1).sortWithinPartitions("t")
    r = rows.mapInPandas(run, "s string").first()
    if r is None:
        raise TrainingError("no rows to fit on")
    return json.loads(r.s)


class GrowingNeuralGas(Node):
    """A graph that grows over ordered rows: the winner and its neighbours move, edges age, every ``every`` rows a node
    is put between the node of largest error and its worst neighbour. Transform gives the nearest node's index."""

    trainable = True

    def __init__(self, eps_b: float = 0.2, eps_n: float = 0.006, max_age: int = 50, every: int = 100, alpha: float = 0.5, d: float = 0.995, max_nodes: int = 1 << 31, start: np.ndarray | None = None, order: str = "t", seed: int = 0, column: str = "x"):
        super().__init__(column)
        self.eps_b, self.eps_n, self.max_age, self.every, self.alpha, self.d, self.max_nodes = eps_b, eps_n, max_age, every, alpha, d, max_nodes
        self.start, self.order, self.seed = start, order, seed

    def _step(self):
        eps_b, eps_n, max_age, every, alpha, decay, most, start, seed = self.eps_b, self.eps_n, self.max_age, self.every, self.alpha, self.d, self.max_nodes, self.start, self.seed

        def step(s: dict, x: np.ndarray) -> None:
            if not s:
                first = np.asarray(start, float) if start is not None else np.random.default_rng(seed).standard_normal((2, len(x)))
                s.update(pos=first, err=np.zeros(len(first)), edges={}, seen=0)
            s["seen"] += 1
            d2 = ((s["pos"] - x) ** 2).sum(1)
            a, b = (int(i) for i in np.argsort(d2, kind="stable")[:2])
            edges = s["edges"]
            mine = [k for k in edges if str(a) in k.split("-")]
            for k in mine:
                edges[k] += 1
            s["err"][a] += np.sqrt(d2[a])
            s["pos"][a] += eps_b * (x - s["pos"][a])
            for k in mine:
                o = next(int(i) for i in k.split("-") if int(i) != a)
                s["pos"][o] += eps_n * (x - s["pos"][o])
            edges[f"{min(a, b)}-{max(a, b)}"] = 0
            old = [k for k in mine if edges[k] > max_age]
            for k in old:
                del edges[k]
            if old:
                live = {int(i) for k in edges for i in k.split("-")}
                keep = [i for i in range(len(s["pos"])) if i in live]
                new = {o: n for n, o in enumerate(keep)}
                s["pos"], s["err"] = s["pos"][keep], s["err"][keep]
                s["edges"] = edges = {f"{new[int(k.split('-')[0])]}-{new[int(k.split('-')[1])]}": v for k, v in edges.items()}
            if s["seen"] % every == 0 and len(s["pos"]) < most:
                q = int(np.argmax(s["err"]))
                near = [next(int(i) for i in k.split("-") if int(i) != q) for k in edges if str(q) in k.split("-")]
                if near:
                    f = max(near, key=lambda i: s["err"][i])
                    n = len(s["pos"])
                    s["pos"] = np.concatenate([s["pos"], [(s["pos"][q] + s["pos"][f]) / 2]])
                    edges.pop(f"{min(q, f)}-{max(q, f)}", None)
                    edges[f"{min(q, n)}-{max(q, n)}"] = edges[f"{min(f, n)}-{max(f, n)}"] = 0
                    s["err"][[q, f]] *= alpha
                    s["err"] = np.concatenate([s["err"], [s["err"][q]]])
            s["err"] *= decay

        return step

    def _fit(self, df):
        s = _fold(df, self.column, self.order, self._step())
        self.nodes, self.edges = np.array(s["pos"]), [[int(i) for i in k.split("-")] for k in s["edges"]]

    def nearest(self, df: DataFrame, name: str = "node") -> DataFrame:
        """The nearest node and its distance for every row: columns ``node`` and ``distance``."""
        p = parts(self.column, self.nodes.shape[1])
        d = [F.struct(total([(c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(p, n, strict=True)]).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(self.nodes)]
        best = F.least(*d) if len(d) > 1 else d[0]
        return df.withColumn("b__", best).withColumn(name, F.col("b__.i")).withColumn("distance", F.sqrt("b__.d")).drop("b__")

    def transform(self, df):
        self._ready()
        return self.nearest(df)


class NeuralGas(GrowingNeuralGas):
    """A fixed number of nodes that all move by their rank of distance; rates fall over the epochs, rows are shuffled by
    a seeded hash in each."""

    def __init__(self, n_nodes: int = 10, start: np.ndarray | None = None, epsilon: tuple[float, float] = (0.3, 0.05), lam: tuple[float, float] = (30.0, 0.01), age: tuple[int, int] = (20, 200), epochs: int = 10, seed: int = 0, column: str = "x"):
        super().__init__(start=start, seed=seed, column=column)
        self.n_nodes, self.epsilon, self.lam, self.age, self.epochs = n_nodes, epsilon, lam, age, epochs

    def _fit(self, df):
        rows = df.select(self.column).persist()
        if self.start is None:
            self.start = np.array([r[0] for r in rows.orderBy(F.xxhash64(self.column, F.lit(self.seed))).limit(self.n_nodes).collect()], float)
        pos, ages = np.asarray(self.start, float), {}
        for epoch in range(self.epochs):
            t = epoch / self.epochs
            eps, lam, age = (a * (b / a) ** t for a, b in (self.epsilon, self.lam, self.age))

            def step(s: dict, x: np.ndarray, pos=pos, ages=ages, eps=eps, lam=lam, age=age) -> None:
                if not s:
                    s.update(pos=pos.copy(), edges=dict(ages))
                d2 = ((s["pos"] - x) ** 2).sum(1)
                order = np.argsort(d2, kind="stable")
                rank = np.empty(len(order))
                rank[order] = np.arange(len(order))
                s["pos"] += (eps * np.exp(-rank / lam))[:, None] * (x - s["pos"])
                if len(order) > 1:
                    a, b = int(order[0]), int(order[1])
                    for k in [k for k in s["edges"] if str(a) in k.split("-")]:
                        s["edges"][k] += 1
                        if s["edges"][k] > age:
                            del s["edges"][k]
                    s["edges"][f"{min(a, b)}-{max(a, b)}"] = 0

            state = _fold(rows, self.column, F.xxhash64(self.column, F.lit(self.seed + epoch)), step)
            pos, ages = np.array(state["pos"]), state["edges"]
        rows.unpersist()
        self.nodes, self.edges = pos, [[int(i) for i in k.split("-")] for k in ages]


class GrowingNeuralGasExpansion(GrowingNeuralGas):
    """Gaussians on the nodes of a trained gas; a node's size is its mean squared distance to its neighbours."""

    def __init__(self, max_nodes: int = 100, **kw):
        super().__init__(max_nodes=max_nodes, **kw)

    def _fit(self, df):
        from .expansions import RBFExpansion

        super()._fit(df)
        sizes = []
        for i, n in enumerate(self.nodes):
            near = [b if a == i else a for a, b in self.edges if i in (a, b)]
            sizes.append(np.mean([((n - self.nodes[j]) ** 2).sum() for j in near]) if near else 1.0)
        self.rbf = RBFExpansion(self.nodes, np.array(sizes), column=self.column)

    def transform(self, df):
        self._ready()
        return self.rbf.transform(df)


def gibbs(rbm: RBM, steps: int, seed: int = 0) -> Column:
    """Visible rows after some Gibbs steps, as a column function."""

    def run(m: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(steps):
            p = _sigmoid(m @ rbm.w + rbm.bh)
            m = rbm._visible((rng.random(p.shape) < p).astype(float), rng)
        return m

    return batch_udf(run)(F.col(rbm.column))
