"""Online operators: they learn for ever, row by row in order.

Each is a small state and two functions, ``learn(state, x)`` and ``apply(state, x)``, so the same code folds a bounded
table (``fold``), a stream (``on_stream``, by foreachBatch), or each key of a stream (``per_key``, with state in Spark).
Closed forms exist for running means and differences; they stay window expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Node, TrainingError, ordered, parts, width_of


class Online(Node):
    """Base of online operators; ``state_`` is a dict of numbers and arrays."""

    trainable = True

    def __init__(self, order: str = "t", column: str = "x"):
        super().__init__(column)
        self.order, self.state_ = order, {}
        self.fitted = True

    def learn(self, s: dict, x: np.ndarray) -> None:
        raise NotImplementedError

    def apply(self, s: dict, x: np.ndarray) -> np.ndarray:
        return x

    def fit(self, df: DataFrame) -> Online:
        """Go on learning from the rows of a table, in order. One task streams them: the fold isn't associative."""
        me, start = self, json.dumps(_pack(self.state_))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = _unpack(json.loads(start))
            for pdf in batches:
                for x in pdf["x"]:
                    me.learn(s, np.asarray(x, float))
            yield pd.DataFrame({"s": [json.dumps(_pack(s))]})

        rows = df.select(F.col(self.column).alias("x"), F.col(self.order).alias("t")).coalesce(1).sortWithinPartitions("t")
        self.state_ = _unpack(json.loads(rows.mapInPandas(run, "s string").first().s))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        me, s = self, self.state_

        @F.pandas_udf("array<double>")
        def run(col: pd.Series) -> pd.Series:
            return pd.Series([me.apply(s, np.asarray(x, float)) for x in col])

        return df.withColumn(self.column, run(self.column))

    def learn_and_apply(self, df: DataFrame, chunk: str | None = None) -> DataFrame:
        """Each row after the operator has learnt it; each chunk starts anew and runs in a task of its own."""
        me, kind, name, order = self, df.schema, self.column, self.order

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            s, out = {}, []
            pdf = pdf.sort_values(order)
            for x in pdf[name]:
                x = np.asarray(x, float)
                me.learn(s, x)
                out.append(me.apply(s, x))
            return pdf.assign(**{name: out})

        key = chunk or F.lit(0)
        return df.groupBy(key).applyInPandas(run, kind)

    def on_stream(self, stream: DataFrame, checkpoint: str | None = None):
        """Learn from a stream, micro-batch by micro-batch; the driver holds the state."""
        w = stream.writeStream.foreachBatch(lambda df, _: self.fit(df) and None)
        return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()

    def per_key(self, stream: DataFrame, key: str) -> DataFrame:
        """One state for each key of a stream (or table), kept by Spark: rows (key, order, x after learning)."""
        from pyspark.sql.streaming.state import GroupStateTimeout

        me, order, name = self, self.order, self.column

        def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            s = _unpack(json.loads(state.get[0])) if state.exists else {}
            for pdf in frames:
                pdf, out = pdf.sort_values(order), []
                for x in pdf[name]:
                    x = np.asarray(x, float)
                    me.learn(s, x)
                    out.append(me.apply(s, x))
                yield pd.DataFrame({key: [k[0]] * len(pdf), order: pdf[order].to_numpy(), name: out})
            state.update((json.dumps(_pack(s)),))

        kinds = dict(stream.dtypes)
        schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {name} array<double>"
        return stream.select(key, order, name).groupBy(key).applyInPandasWithState(run, schema, "s string", "append", GroupStateTimeout.NoTimeout)


def _pack(s: dict) -> dict:
    return {k: {"a": v.tolist()} if isinstance(v, np.ndarray) else _pack(v) | {"__d": 1} if isinstance(v, dict) else v for k, v in s.items()}


def _unpack(s: dict) -> dict:
    return {k: np.array(v["a"]) if isinstance(v, dict) and "a" in v and "__d" not in v else _unpack({a: b for a, b in v.items() if a != "__d"}) if isinstance(v, dict) else v for k, v in s.items()}


class OnlineCentering(Online):
    """Takes away the running mean, or an exponential one of weight 2/(avg_n + 1); the first row counts fully."""

    def __init__(self, avg_n: float | None = None, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.avg_n = avg_n

    def learn(self, s, x):
        n = s.get("n", 0)
        a = 1.0 if n == 0 else 1 / (n + 1) if self.avg_n is None else 2 / (self.avg_n + 1)
        s["avg"], s["n"] = (1 - a) * s.get("avg", 0 * x) + a * x, n + 1

    def apply(self, s, x):
        return x - s["avg"] if s.get("n", 0) > 1 else x


def running_mean(df: DataFrame, order: str, chunk: str | None = None, column: str = "x") -> DataFrame:
    """Adds ``avg``: the mean of all rows up to each one, as a window aggregate."""
    d = width_of(df, column)
    w = ordered(order, chunk).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("avg", F.array(*[F.avg(c).over(w) for c in parts(column, d)]))


class OnlineTimeDiff(Online):
    """The difference to the last row learnt, zero at first."""

    def learn(self, s, x):
        s["before"], s["now"] = s.get("now", 0 * x), x

    def apply(self, s, x):
        return x - s["before"]


def _amnesic(i: int, p: tuple[float, float, float, float]) -> float:
    """The amnesic parameter after i rows: none up to n1, growing to c at n2, then slowly with i."""
    n1, n2, m, c = p
    return 0.0 if i < n1 else c * (i - n1) / (n2 - n1) if i < n2 else c + (i - n2) / m


class CCIPCA(Online):
    """Covariance-free incremental principal components with amnesic weights; rows should be centred."""

    def __init__(self, output_dim: int | None = None, amnesic: tuple = (20, 200, 2000, 3), seed: int = 0, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.output_dim, self.amnesic, self.seed = output_dim, tuple(amnesic), seed

    def learn(self, s, x):
        k = self.output_dim or len(x)
        if "v" not in s:
            s["v"] = 0.1 * np.linalg.qr(np.random.default_rng(self.seed).standard_normal((len(x), len(x))))[0][:k]
            s["n"] = 0
        s["n"] += 1
        i = s["n"]
        forget = min(_amnesic(i, self.amnesic), max(0.0, i - 1.0))
        keep, new = (i - 1 - forget) / i, (1 + forget) / i
        r = x.copy()
        for j in range(k):
            if i <= k and j >= i - 1:  # a component begins as what the first ones leave of its row
                if j == i - 1 and np.linalg.norm(r) > 1e-12:
                    s["v"][j] = r
                break
            v = s["v"][j]
            norm = np.linalg.norm(v)
            v = keep * v + new * (r @ v) / max(norm, 1e-300) * r
            s["v"][j] = v
            u = v / max(np.linalg.norm(v), 1e-300)
            r = r - (r @ u) * u

    def components(self, s: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(variances, directions as rows), largest first."""
        v = (self.state_ if s is None else s)["v"]
        d = np.linalg.norm(v, axis=1)
        return d, v / np.maximum(d, 1e-300)[:, None]

    def reduced_dimension(self, share: float = 1.0) -> int:
        d, _ = self.components()
        return int(np.searchsorted(np.cumsum(d) / d.sum(), share - 1e-12)) + 1

    def apply(self, s, x):
        return self.components(s)[1] @ x


class CCIPCAWhitening(CCIPCA):
    """Scaled to unit variance."""

    def apply(self, s, x):
        d, u = self.components(s)
        return (u @ x) / np.sqrt(np.maximum(d, 1e-300))


class MCA(Online):
    """Incremental minor components, one after the other in the space left by those before."""

    def __init__(self, output_dim: int | None = None, eps: float = 0.1, gamma: float = 1.0, normalize: bool = True, seed: int = 0, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.output_dim, self.eps, self.gamma, self.normalize, self.seed = output_dim, eps, gamma, normalize, seed

    def learn(self, s, x):
        k = self.output_dim or len(x)
        if "v" not in s:
            s["v"] = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((len(x), len(x))))[0][:k]
            s["d"] = np.zeros(k)
        c = np.outer(x, x)
        for j in range(k):
            eta = self.eps / (1 + 1.2 * j)
            v = s["v"][j]
            v = (1.5 - eta) * v - eta * (c @ v)
            norm = np.linalg.norm(v)
            if self.normalize and norm > 0:
                v = v / norm
            s["v"][j], s["d"][j] = v, norm
            c = c + self.gamma * np.outer(v, v) / max(v @ v, 1e-300)

    def apply(self, s, x):
        return s["v"] @ x


class IncSFA(Online):
    """Incremental slow features: centring, whitening by CCIPCA, time difference, minor components of it.

    With ``episode`` bounds given as rows that start anew (``new_episode`` in the state), no difference links them.
    """

    def __init__(self, output_dim: int | None = None, whitening_dim: int | None = None, eps: float = 0.05, remove_mean: bool = True, avg_n: float | None = None, amnesic: tuple = (20, 200, 2000, 3), seed: int = 0, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.output_dim = output_dim
        self.remove_mean = remove_mean
        self.center, self.white = OnlineCentering(avg_n), CCIPCAWhitening(whitening_dim, amnesic, seed)
        self.mca = MCA(output_dim, eps, 1.0, True, seed)

    def learn(self, s, x):
        c, w, m = s.setdefault("center", {}), s.setdefault("white", {}), s.setdefault("mca", {})
        if self.remove_mean:
            self.center.learn(c, x)
            x = self.center.apply(c, x)
        self.white.learn(w, x)
        z = self.white.apply(w, x)
        if "last" in s and not s.pop("new_episode", False):
            self.mca.learn(m, z - s["last"])
        s["last"] = z

    def apply(self, s, x):
        if self.remove_mean:
            x = self.center.apply(s["center"], x)
        z = self.white.apply(s["white"], x)
        return self.mca.apply(s["mca"], z) if s["mca"] else z


class SlidingDelay(Online):
    """Each row with the gap-th rows before it, from a buffer; zeros before the start."""

    def __init__(self, frames: int, gap: int = 1, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.frames, self.gap = frames, gap

    def learn(self, s, x):
        size = self.gap * (self.frames - 1) + 1
        b = s.get("buffer", np.zeros((size, len(x))))
        s["buffer"] = np.concatenate([x[None], b[:-1]])

    def apply(self, s, x):
        return s["buffer"][:: self.gap].ravel()


class OnlineFlow(Online):
    """A chain of online operators: each row trains one, goes through it, and trains the next."""

    def __init__(self, nodes: list[Online], order: str = "t", column: str = "x"):
        super().__init__(order, column)
        self.nodes = list(nodes)

    def learn(self, s, x):
        for i, n in enumerate(self.nodes):
            own = s.setdefault(str(i), {})
            n.learn(own, x)
            x = n.apply(own, x)

    def apply(self, s, x):
        for i, n in enumerate(self.nodes):
            x = n.apply(s[str(i)], x)
        return x


class CircularOnlineFlow(OnlineFlow):
    """The output is fed back as the next input, ``iterations`` times a row; new rows may be ignored."""

    def __init__(self, nodes: list[Online], iterations: int = 1, ignore_input: bool = False, stored: np.ndarray | None = None, order: str = "t", column: str = "x"):
        super().__init__(nodes, order, column)
        self.iterations, self.ignore_input, self.stored = iterations, ignore_input, stored

    def learn(self, s, x):
        if "stored" not in s and self.stored is not None:
            s["stored"] = np.asarray(self.stored, float)
        if self.ignore_input and "stored" in s:
            x = s["stored"]
        for _ in range(self.iterations):
            super().learn(s, x)
            x = super().apply(s, x)
        s["stored"] = x

    def apply(self, s, x):
        return super().apply(s, x)


class OnlineLayer(Online):
    """Blocks of variables to different online operators; with ``same`` all see the whole row, with ``clone`` one
    operator learns from all blocks."""

    def __init__(self, nodes: list[Online], dims: list[int] | None = None, clone: bool = False, order: str = "t", column: str = "x"):
        super().__init__(order, column)
        if not nodes:
            raise TrainingError("a layer needs operators")
        self.nodes, self.dims, self.clone = list(nodes), dims, clone

    def _blocks(self, x: np.ndarray) -> list[np.ndarray]:
        if self.dims is None:
            return [x] * len(self.nodes)
        return np.split(x, np.cumsum(self.dims)[:-1])

    def _each(self, s: dict, x: np.ndarray):
        blocks = self._blocks(x)
        for i, b in enumerate(blocks):
            k = 0 if self.clone else i
            yield self.nodes[min(k, len(self.nodes) - 1)], s.setdefault(str(k), {}), b

    def learn(self, s, x):
        for n, own, b in self._each(s, x):
            n.learn(own, b)

    def apply(self, s, x):
        return np.concatenate([n.apply(own, b) for n, own, b in self._each(s, x)])
