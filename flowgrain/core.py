"""The contract of all operators: fit over a DataFrame, then map rows through columns expressions, maybe back.

Rows carry their variables as one ``array<double>`` column (``x`` unless said otherwise); other columns pass
through. Whatever depends on time takes an ``order`` column (a total order) and optionally a ``chunk`` column
beyond which nothing is linked. Fitting aggregates in Spark; only moments reach the driver.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Products above which a projection runs as one matrix product per Arrow batch instead of unrolled columns.
UNROLL = 600
_NODES: dict[str, type] = {}


class TrainingError(Exception):
    """A node was used before it was fitted, or with data that don't fit it."""


def vector(columns: Sequence[str | Column]) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    """``df`` with the named numeric columns packed into one vector column."""
    return df.withColumn(name, vector(columns))


def width_of(df: DataFrame, column: str = "x") -> int:
    row = df.select(F.size(column).alias("n")).first()
    if row is None:
        raise TrainingError("no rows to fit on")
    return row.n


def parts(column: Column | str, n: int) -> list[Column]:
    c = F.col(column) if isinstance(column, str) else column
    return [F.get(c, F.lit(i)) for i in range(n)]


def opaque(columns: Sequence[Column]) -> Column:
    """An array that the optimizer does not look into.

    A plain array of expressions is taken apart again where the next stage reads its elements, so that the expressions of
    a chain of stages multiply; this one is computed once a row, in generated code.
    """
    columns = list(columns)
    if len(columns) < 3:
        return F.array(*columns)
    half = len(columns) // 2
    return F.concat(F.array(*columns[:half]), F.array(*columns[half:]))


def total(terms: Sequence[Column]) -> Column:
    """A balanced sum, so that wide sums don't nest deeply."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def batch_udf(f: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>"):
    """A vectorised Arrow function from a matrix of rows to rows (or to one value a row)."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        return pd.Series(list(f(np.stack([np.asarray(v, float) for v in s]))))

    return run


def affine(column: str | Column, w: np.ndarray, b: np.ndarray | None = None) -> Column:
    """x·W + b as a column: unrolled into generated code while small, else a matrix product on Arrow batches."""
    w = np.asarray(w, float)
    b = np.zeros(w.shape[1]) if b is None else np.asarray(b, float)
    if w.size <= UNROLL:
        x = parts(column, w.shape[0])
        return opaque([total([x[i] * F.lit(float(w[i, j])) for i in range(len(x))] + [F.lit(float(b[j]))]) for j in range(w.shape[1])])
    return batch_udf(lambda m: m @ w + b)(column)


def ordered(order: str | Sequence[str], chunk: str | None) -> Window:
    """The window of a time operator: within chunks, or over all rows (then in one task; see :func:`stitched`)."""
    if not order:
        raise TrainingError("a time operator needs an order column")
    keys = [order] if isinstance(order, str) else list(order)
    return (Window.partitionBy(chunk) if chunk else Window.partitionBy()).orderBy(*keys)


def stitched(df: DataFrame, order: str, reach: int, ahead: bool = False) -> tuple[DataFrame, str]:
    """Range partitions of ``df`` by ``order`` as chunks, each with ``reach`` rows of its neighbour as ghosts.

    Returns the frame with columns ``part__`` and ``ghost__``. A lag (or, with ``ahead``, a lead) of up to
    ``reach`` rows over Window.partitionBy("part__") then equals the one over all rows, for rows that are no
    ghosts, without sending all rows to one task.
    """
    spread = df.repartitionByRange(order).withColumn("part__", F.spark_partition_id()).persist()
    sizes = {r.part__: r.n for r in spread.groupBy("part__").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or min(sizes.values()) < reach:
        return df.withColumn("part__", F.lit(0)).withColumn("ghost__", F.lit(False)), "part__"
    ids = sorted(sizes)
    to = {a: b for a, b in (zip(ids[1:], ids[:-1], strict=True) if ahead else zip(ids[:-1], ids[1:], strict=True))}
    edge = Window.partitionBy("part__").orderBy(F.col(order).asc() if ahead else F.col(order).desc())
    mapping = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    ghosts = spread.withColumn("rn__", F.row_number().over(edge)).where((F.col("rn__") <= reach) & F.col("part__").isin(list(to))).drop("rn__")
    ghosts = ghosts.withColumn("part__", mapping[F.col("part__")]).withColumn("ghost__", F.lit(True))
    return spread.withColumn("ghost__", F.lit(False)).unionByName(ghosts), "part__"


class Node:
    """Base operator. Subclasses set ``_fields`` to the names of what fitting leaves behind."""

    _fields: tuple[str, ...] = ()
    trainable = False
    invertible = False

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        _NODES[cls.__name__] = cls

    def __init__(self, column: str = "x"):
        self.column = column
        self.fitted = not self.trainable

    # What subclasses give.
    def _fit(self, df: DataFrame) -> None: ...

    def _column(self, x: str | Column) -> Column:
        raise NotImplementedError

    def _inverse_column(self, y: str | Column) -> Column:
        raise TrainingError(f"{type(self).__name__} has no inverse")

    # What users call.
    def fit(self, df: DataFrame) -> Node:
        if self.trainable:
            self._fit(df)
            self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        return df.withColumn(self.column, self._column(self.column))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    __call__ = fit_transform

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._ready()
        return df.withColumn(self.column, self._inverse_column(self.column))

    def _ready(self) -> None:
        if not self.fitted:
            raise TrainingError(f"{type(self).__name__} is not fitted")

    def copy(self) -> Node:
        return copy.deepcopy(self)

    def __add__(self, other):
        from .plans.flow import Flow

        return Flow([self]) + other

    # Persistence: plain JSON, no pickles.
    def state(self) -> dict:
        return {"class": type(self).__name__, "values": {k: _plain(v) for k, v in vars(self).items()}}

    @staticmethod
    def from_state(state: dict) -> Node:
        node = object.__new__(_NODES[state["class"]])
        node.__dict__.update({k: _rich(v) for k, v in state["values"].items()})
        return node

    def save(self, path: str | None = None) -> str:
        text = json.dumps(self.state())
        if path:
            Path(path).write_text(text)
        return text

    @staticmethod
    def load(path: str) -> Node:
        return Node.from_state(json.loads(Path(path).read_text()))


def _plain(v):
    if isinstance(v, np.ndarray):
        return {"__array__": v.tolist(), "dtype": str(v.dtype), "shape": list(v.shape)}
    if isinstance(v, Node):
        return {"__node__": v.state()}
    if isinstance(v, (list, tuple)):
        return {"__list__" if isinstance(v, list) else "__tuple__": [_plain(x) for x in v]}
    if isinstance(v, dict):
        return {"__dict__": [[_plain(a), _plain(b)] for a, b in v.items()]}
    if isinstance(v, np.generic):
        return v.item()
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    raise TypeError(f"{type(v).__name__} cannot be saved")


def _rich(v):
    if isinstance(v, dict):
        if "__array__" in v:
            return np.array(v["__array__"], dtype=v["dtype"]).reshape(v["shape"])
        if "__node__" in v:
            return Node.from_state(v["__node__"])
        if "__list__" in v:
            return [_rich(x) for x in v["__list__"]]
        if "__tuple__" in v:
            return tuple(_rich(x) for x in v["__tuple__"])
        return {_rich(a): _rich(b) for a, b in v["__dict__"]}
    return v
