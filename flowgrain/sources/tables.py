"""Reading and writing matrices as DataFrames: Parquet, ORC, JSON, CSV, NumPy arrays, and streams of Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import vector


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, kind: str = "parquet", schema=None, keep: Sequence[str] = ()) -> DataFrame:
    """A table of files; with ``columns`` those are packed into the vector ``x`` and only they and ``keep`` are read."""
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df if columns is None else df.select(*keep, vector(columns).alias("x"))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """CSV cannot hold vectors: there ``x`` becomes one column for each variable."""
    if kind == "csv" and "x" in df.columns and dict(df.dtypes)["x"].startswith("array"):
        n = df.select(F.max(F.size("x"))).first()[0] or 0
        df = df.select(*[c for c in df.columns if c != "x"], *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(n)])
    w = df.write.format(kind).mode(mode)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def from_array(spark: SparkSession, x: np.ndarray, chunk: Sequence[int] | int | None = None, **columns) -> DataFrame:
    """(t, x[, chunk][, …]) from a matrix in memory, or from several whose rows are chunks of one signal."""
    if isinstance(x, (list, tuple)) and x and np.ndim(x[0]) == 2:
        chunk = np.concatenate([np.full(len(c), i) for i, c in enumerate(x)])
        x = np.concatenate(x)
    x = np.asarray(x, float)
    if x.ndim != 2:
        raise ValueError("a matrix of rows is needed")
    data = {"t": np.arange(len(x)), "x": pa.array(list(x), pa.list_(pa.float64()))}
    if chunk is not None:
        data["chunk"] = np.broadcast_to(chunk, (len(x),)).copy()
    return spark.createDataFrame(pa.table(data | columns))


def to_array(df: DataFrame, column: str = "x", order: str = "t") -> np.ndarray:
    """The rows of a small table as a matrix, in order."""
    rows = df.select(order, column).orderBy(order).collect()
    return np.array([r[1] for r in rows], float)


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
