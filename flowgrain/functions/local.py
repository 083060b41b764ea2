"""Small helpers around arrays and columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def apply_locally(node, x: np.ndarray) -> np.ndarray:
    """The rows of a small matrix through an operator."""
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.atleast_2d(x))], f"i int, {node.column} array<double>")
    return np.array([r[1] for r in node.transform(df).select("i", node.column).orderBy("i").collect()])


def norm2(x: str | Column) -> Column:
    """Euclidean norm of a vector column."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def hamming_weight(x: str | Column) -> Column:
    return F.bit_count(x)


def bool_to_sign(x: Column) -> Column:
    return F.when(x.cast("int") > 0, F.lit(1)).otherwise(F.lit(-1))


def sign_to_bool(x: Column, zero: bool = True) -> Column:
    return x >= 0 if zero else x > 0


def rotate_pair(a: Column, b: Column, angle: float, units: str = "radians") -> tuple[Column, Column]:
    """Two columns rotated by an angle."""
    if units == "degrees":
        angle = math.radians(angle)
    c, s = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    return c * a + s * b, c * b - s * a


def repeat_leading(x: str | Column, n: int) -> Column:
    """n copies of the vector as rows."""
    return F.array_repeat(x, n)


def repeat_trailing(x: str | Column, n: int) -> Column:
    """Each element n times, as rows."""
    return F.transform(x, lambda v: F.array_repeat(v, n))


def weighted_choice(weights: dict, seed: int, normalize: bool = True) -> Column:
    """For each row a random key by weight; without ``normalize`` null where the draw exceeds the weights' sum."""
    scale = sum(weights.values()) if normalize else 1.0
    bounds, upto = [], 0.0
    for k, w in weights.items():
        upto += w / scale
        bounds.append((k, upto))
    # The array makes one draw serve all comparisons.
    return F.transform(F.array(F.rand(seed)), lambda d: _choose(d, bounds))[0]


def _choose(draw: Column, bounds: list) -> Column:
    out = F.lit(None)
    for k, b in reversed(bounds):
        out = F.when(draw < b, F.lit(k)).otherwise(out)
    return out


def orthogonal_permutations(lists: dict) -> Iterator[dict]:
    """All combinations of one value from each list."""
    for values in product(*lists.values()):
        yield dict(zip(lists, values, strict=True))


def zip_stretched(*items) -> Iterator[tuple]:
    """Zip of sequences; scalars repeat."""
    seqs = [x if isinstance(x, (list, tuple, np.ndarray)) else None for x in items]
    n = max((len(s) for s in seqs if s is not None), default=1)
    for i in range(n):
        yield tuple(x if s is None else s[i] for x, s in zip(items, seqs, strict=True))


def cast_if_needed(df, column: str, kind: str):
    return df if dict(df.dtypes)[column] == kind else df.withColumn(column, F.col(column).cast(kind))


def recursive_map(f, seq):
    return [recursive_map(f, x) if isinstance(x, (list, tuple)) else f(x) for x in seq]


def recursive_reduce(f, seq: Iterable, *start):
    out, items = (start[0] if start else None), list(seq)
    for x in items:
        v = recursive_reduce(f, x) if isinstance(x, (list, tuple)) else x
        out = v if out is None else f(out, v)
    return out


def size_in_bytes(node) -> int:
    """Bytes of what an operator saves."""
    return len(node.save())


def matmul(a: np.ndarray, b: np.ndarray, alpha: float = 1.0, beta: float = 0.0, c: np.ndarray | None = None, trans_a: bool = False, trans_b: bool = False) -> np.ndarray:
    out = alpha * ((a.T if trans_a else a) @ (b.T if trans_b else b))
    return out if c is None else out + beta * c


def pca(df, **how):
    """The rows projected on the principal components of themselves."""
    from ..operators.decomposition import PCA

    return PCA(**how).fit_transform(df)


def fastica(df, **how):
    """The rows' independent components."""
    from ..operators.ica import FastICA

    return FastICA(**how).fit_transform(df)
