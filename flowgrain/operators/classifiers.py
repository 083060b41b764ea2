"""Classifiers: each adds ``label``, and where it has them ``prob`` (map) and ``rank`` (labels by probability)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Node, TrainingError, parts, total, width_of
from .moments import moments, moments_by


def ranked(prob: Column, threshold: float | None = None) -> Column:
    """Labels by probability, largest first, ties by label; only those strictly above ``threshold`` if given."""
    entries = F.map_entries(prob)
    if threshold is not None:
        entries = F.filter(entries, lambda e: e["value"] > threshold)
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.transform(keyed, lambda e: e["k"])


class Classifier(Node):
    trainable = True

    def __init__(self, label: str = "label", column: str = "x"):
        super().__init__(column)
        self.label_column = label

    def _scores(self, x: str) -> list[tuple[object, Column]]:
        """(label, log score) of each class, for those classifiers that have such."""
        raise NotImplementedError

    def prob(self, df: DataFrame, name: str = "prob") -> DataFrame:
        self._ready()
        scores = self._scores(self.column)
        top = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
        e = [F.exp(s - top) for _, s in scores]
        z = total(e)
        return df.withColumn(name, F.create_map(*[v for (k, _), p in zip(scores, e, strict=True) for v in (F.lit(k), p / z)]))

    def label(self, df: DataFrame, name: str = "label") -> DataFrame:
        """The best class; of equal ones the first in the order of labels."""
        self._ready()
        scores = self._scores(self.column)
        best, out = scores[0][1], F.lit(scores[0][0])
        for k, s in scores[1:]:
            out = F.when(s > best, F.lit(k)).otherwise(out)
            best = F.greatest(best, s)
        return df.withColumn(name, out)

    def rank(self, df: DataFrame, threshold: float | None = None, name: str = "rank") -> DataFrame:
        return self.prob(df, "prob__").withColumn(name, ranked(F.col("prob__"), threshold)).drop("prob__")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.label(df)


class Gaussian(Classifier):
    """Full-covariance Gaussian of each class with the classes' shares as priors."""

    def _fit(self, df):
        groups = moments_by(df, self.column, self.label_column)
        self.labels = sorted(groups)
        n = sum(m.n for m in groups.values())
        self.means, self.inverses, self.logs = [], [], []
        for k in self.labels:
            m = groups[k]
            if m.n < 2:
                raise TrainingError(f"class {k} has one row only")
            cov = m.covariance()
            sign, logdet = np.linalg.slogdet(cov)
            if sign <= 0 or not np.isfinite(logdet):
                raise TrainingError(f"the covariance of class {k} is singular")
            self.means.append(m.mean())
            self.inverses.append(np.linalg.inv(cov))
            self.logs.append(float(np.log(m.n / n) - 0.5 * logdet))

    def _scores(self, x):
        out = []
        p = parts(x, len(self.means[0]))
        for k, mean, inv, log in zip(self.labels, self.means, self.inverses, self.logs, strict=True):
            d = [c - F.lit(float(m)) for c, m in zip(p, mean, strict=True)]
            q = total([F.lit(float(inv[i, i])) * d[i] * d[i] for i in range(len(d))] + [F.lit(2 * float(inv[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(i + 1, len(d))])
            out.append((k, F.lit(log) - F.lit(0.5) * q))
        return out


class NearestMean(Classifier):
    """The class with the nearest mean."""

    def _fit(self, df):
        d = width_of(df, self.column)
        p = parts(self.column, d)
        rows = df.groupBy(self.label_column).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(p)]).collect()
        rows = sorted(rows, key=lambda r: r[0])
        self.labels, self.means = [r[0] for r in rows], np.array([[r[f"m{i}"] for i in range(d)] for r in rows])

    def _scores(self, x):
        p = parts(x, self.means.shape[1])
        return [(k, -total([(c - F.lit(float(m))) * (c - F.lit(float(m))) for c, m in zip(p, mean, strict=True)])) for k, mean in zip(self.labels, self.means, strict=True)]


class KMeans(Classifier):
    """Lloyd's iteration until the centroids stay; a cluster without rows keeps its centroid."""

    def __init__(self, clusters: int, max_iter: int = 100, init: np.ndarray | None = None, seed: int = 0, column: str = "x"):
        super().__init__(column=column)
        self.clusters, self.max_iter, self.seed = clusters, max_iter, seed
        self.centroids = None if init is None else np.asarray(init, float)

    def _fit(self, df):
        d = width_of(df, self.column)
        if self.centroids is None:
            rows = df.select(self.column).orderBy(F.xxhash64(self.column, F.lit(self.seed))).limit(self.clusters).collect()
            self.centroids = np.array([r[0] for r in rows], float)
        df = df.select(self.column).persist()
        self.fitted, self.iterations = True, 0
        for _ in range(self.max_iter):
            p = parts(self.column, d)
            means = self.label(df, "k__").groupBy("k__").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(p)]).collect()
            new = self.centroids.copy()
            for r in means:
                new[r.k__] = [r[f"m{i}"] for i in range(d)]
            self.iterations += 1
            if np.array_equal(new, self.centroids):
                break
            self.centroids = new
        df.unpersist()

    def _scores(self, x):
        p = parts(x, self.centroids.shape[1])
        return [(i, -total([(c - F.lit(float(m))) * (c - F.lit(float(m))) for c, m in zip(p, mean, strict=True)])) for i, mean in enumerate(self.centroids)]


class _Cells:
    """A k-d tree over some vectors: it gives every vector a cell. ``low`` and ``high`` are the exact bounds of the training rows in each."""

    def __init__(self, some: np.ndarray, leaf: int):
        self.dim, self.split, self.next, self.cells = [], [], [], 0
        todo = [(np.arange(len(some)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            node = len(self.dim)
            if parent >= 0:
                self.next[parent][side] = node
            x = some[at]
            wide = int(np.argmax(x.max(0) - x.min(0))) if len(at) > leaf else 0
            if len(at) <= leaf or not x[:, wide].max() > x[:, wide].min():
                self.dim.append(-1)
                self.split.append(float(self.cells))
                self.next.append([-1, -1])
                self.cells += 1
                continue
            v = x[:, wide]
            cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            cut = v[v < cut].max() if cut == v.max() else cut
            self.dim.append(wide)
            self.split.append(float(cut))
            self.next.append([-1, -1])
            todo += [(at[v <= cut], node, 0), (at[~(v <= cut)], node, 1)]

    def walk(self, x: np.ndarray, r2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position, cell): the cell of each row, or with ``r2`` all cells that may hold a training row within that squared distance."""
        rows, cells, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            j = self.dim[node]
            if j >= 0:
                under = x[at, j] <= self.split[node]
                both = False if r2 is None else (x[at, j] - self.split[node]) ** 2 <= r2[at]
                todo += [(self.next[node][0], at[under | both]), (self.next[node][1], at[~under | both])]
                continue
            c = int(self.split[node])
            if r2 is not None:
                # Rounded as the distances are, in the same order, so never above that of a row in the bounds.
                off = np.fmax(np.fmax(self.low[c] - x[at], x[at] - self.high[c]), 0.0)
                at = at[_squares(off.T) <= r2[at]]
            rows.append(at)
            cells.append(np.full(len(at), c))
        return np.concatenate(rows), np.concatenate(cells)


def _squares(parts) -> np.ndarray:
    """The sum of squares, added from the first part to the last."""
    out = 0.0
    for p in parts:
        out = out + p * p
    return out


class _Search:
    """The k nearest of each of the vectors ``a`` (position, squared distance, label), out of training rows that come block by block.

    A matrix product tells all squared distances of a block but for rounding. Those that may be among the nearest are computed
    again by ``_squares``, so distances and ties are the same to the last bit. Vectors with huge or no numbers are never left out.
    """

    PAIRS = 1 << 20

    def __init__(self, a: np.ndarray, k: int):
        self.a, self.k = a, k
        finite = np.isfinite(a).all(1)
        self.mid = np.median(a[finite], 0) if finite.any() else np.zeros(a.shape[1])
        c, self.norm = self._centred(a)
        self.c = np.concatenate([c, np.ones((len(a), 1))], 1)
        self.i, self.d2, self.l = np.zeros(0, np.int64), np.zeros(0), None
        self.far = np.full(len(a), np.inf)

    def _centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            c = x - self.mid
            norm = (c * c).sum(1)
        norm[~(norm < 1e200)] = np.nan
        c[np.isnan(norm)] = 0.0
        return c, norm

    def add(self, b: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        """Training vectors ``b``, of each ``sizes`` labels."""
        c, norm = self._centred(b)
        # The product and ``_squares`` are apart by less than 2.5 * width + 8 times eps and the sum of both norms; this is more.
        slack = 4 * (b.shape[1] + 8) * np.finfo(float).eps
        to = np.concatenate([-2.0 * c, (1 - slack) * norm[:, None]], 1).T
        begin, step, found = np.cumsum(sizes) - sizes, max(1, self.PAIRS // len(b)), []
        for s in range(0, len(self.a), step):
            own = slice(s, s + step)
            score = self.c[own] @ to
            near = self.far[own] - (1 - slack) * self.norm[own] + 1e-290
            unset = np.flatnonzero(~(self.far[own] < np.inf))
            if len(unset) and len(b) >= self.k:
                some = max(512, 8 * self.k)
                most = np.partition(score[unset, :some] + 2 * slack * norm[:some], self.k - 1, 1)[:, self.k - 1]
                near[unset] = np.fmin(near[unset], most + 2 * slack * self.norm[own][unset] + 1e-290)
            who, which = np.divmod(np.flatnonzero(~(score > near[:, None])), len(b))
            for at in range(0, len(who), self.PAIRS // 4):
                i, j = who[at : at + self.PAIRS // 4] + s, which[at : at + self.PAIRS // 4]
                with np.errstate(all="ignore"):
                    d2 = _squares(self.a[i, n] - b[j, n] for n in range(b.shape[1]))
                may = ~(d2 > self.far[i]) & ~(np.isnan(d2) & (self.far[i] < np.inf))
                i, j, d2 = i[may], j[may], d2[may]
                each = sizes[j]
                label = np.repeat(begin[j] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                found.append((np.repeat(i, each), np.repeat(d2, each), labels[label]))
                if sum(len(f[0]) for f in found) > self.PAIRS // 4:
                    self._merge(found)
                    found = []
        self._merge(found)

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not found:
            return
        held = [] if self.l is None else [(self.i, self.d2, self.l)]
        i, d2, label = (np.concatenate(v) for v in zip(*held, *found, strict=True))
        rank = pd.Series(label.tolist() if label.dtype == object else label).rank(method="dense", na_option="top").to_numpy()
        order = np.lexsort((rank, d2, i))
        i, d2, label = i[order], d2[order], label[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last, kept = place == self.k - 1, place < self.k
        self.far[i[last]] = d2[last]
        self.i, self.d2, self.l = i[kept], d2[kept], label[kept]


def _matrix(x: pa.ListArray, d: int) -> np.ndarray:
    if not (x.value_lengths().to_numpy(zero_copy_only=False) == d).all():
        raise ValueError(f"not all vectors have {d} numbers")
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), d)


class KNN(Classifier):
    """Majority of the k nearest training rows; ties of distance and of votes go to the smaller label.

    Exact. Where the training rows are enough to split every dimension, not all are compared with all: a k-d tree over a
    bounded sample of them deals both sides into cells. Each query first finds the k nearest in its own cell, then goes to those
    other cells whose bounds are not further away than the k-th of these. Cells hold some ``block`` / 8 training rows, queries of
    a cell are dealt into parts of ``block``. In more dimensions few cells can be left out, so there all pairs are compared, as
    matrix products: queries are dealt into parts, and the training rows stream past each part in packed blocks.

    Equal vectors count once on both sides (of training rows the k smallest labels, as no more can be among the nearest), so
    large groups of copies cost nothing.
    """

    SAMPLE = 1 << 21
    #: Numbers of the queries in a part, at most.
    PART = 1 << 21

    def __init__(self, k: int = 1, label: str = "label", block: int = 4096, column: str = "x"):
        super().__init__(label, column)
        self.k, self.block = k, block

    def _fit(self, df):
        self.rows = df.select(F.col(self.column).cast("array<double>").alias("tx"), F.col(self.label_column).alias("tl")).where("tx is not null")
        self.n, self.kind = self.rows.count(), dict(self.rows.dtypes)["tl"]
        counted = self.rows.groupBy("tx", "tl").agg(F.count("*").alias("n"))
        counted = counted.withColumn("rn", F.row_number().over(Window.partitionBy("tx").orderBy("tl"))).where(F.col("rn") <= self.k)
        labels = F.sort_array(F.collect_list(F.struct("tl", F.least("n", F.lit(self.k)).cast("int").alias("n"))))
        repeated = F.flatten(F.transform(labels, lambda s: F.array_repeat(s["tl"], s["n"])))
        self.points = counted.groupBy(F.col("tx").alias("x")).agg(F.slice(repeated, 1, self.k).alias("ls"))

    def _tree(self) -> tuple[_Cells, Callable[[str], Column]]:
        d = width_of(self.points, "x")
        leaf = max(self.block // 8, 8 * self.k)
        # Of every cell some 16 rows are in the sample, as long as it stays below SAMPLE numbers.
        every = max(1, min(leaf // 16, self.n), -(-self.n * d // self.SAMPLE))
        some = [r[0] for r in self.points.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).select("x").collect()] or [self.points.first()[0]]
        cells = _Cells(np.array(some, float), max(1, leaf // every))
        cell_of = F.pandas_udf(lambda s: pd.Series(_cell_of(cells, s)), "int")
        bounds = self.points.groupBy(cell_of("x").alias("c")).agg(*[f(F.get("x", F.lit(j))).alias(f"{n}{j}") for j in range(d) for n, f in (("a", F.min), ("b", F.max))])
        cells.low, cells.high = np.full((cells.cells, d), np.inf), np.full((cells.cells, d), -np.inf)
        for r in bounds.collect():
            cells.low[r.c], cells.high[r.c] = [r[f"a{j}"] for j in range(d)], [r[f"b{j}"] for j in range(d)]
        return cells, cell_of

    def _nearest(self, df: DataFrame) -> DataFrame:
        """(x, near) for each distinct vector of ``df``: (d2, l) of its k nearest training rows, nearest first."""
        self._ready()
        if not self.n:
            return df.sparkSession.createDataFrame([], f"x array<double>, near array<struct<d2: double, l: {self.kind}>>")
        queries = df.select(F.col(self.column).cast("array<double>").alias("x")).where("x is not null").distinct()
        d = width_of(self.rows, "tx")
        return self._over_blocks(queries, d) if self.n < max(self.block // 8, 8 * self.k) << d else self._over_cells(queries)

    def _over_blocks(self, queries: DataFrame, d: int) -> DataFrame:
        """All pairs: each task holds a part of the queries and reads all training rows, block by block."""
        k, kind, n = self.k, self.kind, queries.count()
        parts = max(1, -(-n * d // self.PART), min(queries.sparkSession.sparkContext.defaultParallelism, n // 1024))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, step = _matrix(batch.column(0), d), max(1, min(4096, (1 << 18) // d))
                for i in range(0, len(x), step):
                    some, ls = x[i : i + step], batch.column(1).slice(i, step)
                    with np.errstate(all="ignore"):
                        short = some.astype(np.float32)
                    body = short if np.array_equal(short, some, equal_nan=True) else some  # no number is changed
                    sizes, labels = ls.value_lengths(), ls.flatten()
                    lists = [pa.ListArray.from_arrays([0, len(v)], v) for v in (sizes, labels)]
                    yield pa.RecordBatch.from_arrays([pa.array([body.tobytes()], pa.binary()), *lists], ["body", "sizes", "labels"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, search, part, labels = [], None, set(), None
            for batch in batches:
                part.update(batch.column("p").to_pylist())
                if len(part) > 1:
                    raise RuntimeError("two parts of the queries came to one task")
                rows = batch.filter(pc.is_valid(batch.column("x")))
                if len(rows):
                    held.append(rows.column("x"))
                for row in range(len(rows), len(batch)) if held else ():
                    search = search or _Search(np.concatenate([_matrix(x, d) for x in held]), k)
                    body, sizes, labels = batch.column("body")[row].as_py(), batch.column("sizes")[row].values.to_numpy(), batch.column("labels")[row].values
                    b = np.frombuffer(body, np.float32 if len(body) == 4 * d * len(sizes) else float).astype(float).reshape(len(sizes), d)
                    flat = pa.types.is_integer(labels.type) and not labels.null_count
                    search.add(b, sizes.astype(np.int64), labels.to_numpy() if flat else np.array([*labels.to_pylist(), None], object)[:-1])
            if search is None:
                return
            x, ends = pa.concat_arrays(held), np.searchsorted(search.i, np.arange(len(search.a) + 1))
            for i in range(0, len(x), 4096):
                at = ends[i : i + 4097]
                near = pa.StructArray.from_arrays([pa.array(search.d2[at[0] : at[-1]]), pa.array(search.l[at[0] : at[-1]], labels.type)], ["d2", "l"])
                yield pa.RecordBatch.from_arrays([x.slice(i, 4096), pa.ListArray.from_arrays((at - at[0]).astype(np.int32), near)], ["x", "near"])

        packed = self.points.select("x", "ls").mapInArrow(pack, f"body binary, sizes array<int>, labels array<{kind}>")
        packed = packed.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(1).alias("side"), F.lit(None).cast("array<double>").alias("x"), "*")
        asked = queries.select(F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("p"), F.lit(0).alias("side"), "x")
        dealt = asked.unionByName(packed, allowMissingColumns=True).repartitionById(parts, "p").sortWithinPartitions("side")
        return dealt.mapInArrow(run, f"x array<double>, near array<struct<d2: double, l: {kind}>>")

    def _over_cells(self, queries: DataFrame) -> DataFrame:
        k, kind, block = self.k, self.kind, self.block
        schema = f"x array<double>, d2 double, l {kind}"
        cells, cell_of = self._tree()
        queries = queries.select("x", cell_of("x").alias("c"), F.lit(float("inf")).alias("r2"))

        def meet(rows: DataFrame, first: bool) -> DataFrame:
            """``rows`` (x, c, r2) with the training rows of their cell: (x, d2, l, c); c is null but for a cell to go to within d2."""
            counts = rows.groupBy("c").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
            none = F.lit(None).cast(f"array<{kind}>")
            left = rows.join(counts, "c").select("c", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("p"), "x", "r2", none.alias("ls"))
            right = self.points.select("x", "ls", cell_of("x").alias("c")).join(counts, "c")
            right = right.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "x", F.lit(None).cast("double").alias("r2"), "ls")

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                q, t = pdf[pdf["r2"].notna()], pdf[pdf["r2"].isna()]
                if not len(q):
                    return pd.DataFrame({"x": [], "d2": [], "l": [], "c": []})
                a, far, out = np.stack(list(q["x"])).astype(float), q["r2"].to_numpy().copy(), []
                if len(t):
                    b = np.stack(list(t["x"])).astype(float)
                    size = np.array([len(v) for v in t["ls"]])
                    label = pd.Series([v for own in t["ls"] for v in own])
                    order = np.argsort(label.rank(method="dense", na_option="top").to_numpy(), kind="stable")
                    b, label = np.repeat(b, size, 0)[order], label.to_numpy()[order]
                    step = max(1, (1 << 21) // len(b))
                    for i in range(0, len(a), step):
                        d2 = _squares(a[i : i + step, j, None] - b[None, :, j] for j in range(b.shape[1]))
                        near = np.argsort(d2, 1, kind="stable")[:, :k]
                        found = np.take_along_axis(d2, near, 1)
                        within = found <= far[i : i + step, None]
                        who, which = np.nonzero(within | np.isnan(found) & first)
                        out.append(pd.DataFrame({"x": list(a[i + who]), "d2": found[who, which], "l": label[near[who, which]]}))
                        if first and near.shape[1] == k:
                            far[i : i + step] = found[:, -1]
                if first:
                    who, other = cells.walk(a, far)
                    away = other != int(pdf["c"].iloc[0])
                    out.append(pd.DataFrame({"x": list(a[who[away]]), "d2": far[who[away]], "c": other[away]}))
                return pd.concat(out).reindex(columns=["x", "d2", "l", "c"]) if out else pd.DataFrame({"x": [], "d2": [], "l": [], "c": []})

            return left.unionByName(right).groupBy("c", "p").applyInPandas(run, schema + ", c int")

        # Read three times; kept on the executors' disks until the session ends.
        home = meet(queries, True).persist(StorageLevel.DISK_ONLY)
        asked = home.where("c is not null").select("x", "c", F.col("d2").alias("r2"))
        found = home.where("c is null").select("x", "d2", "l").unionByName(meet(asked, False).select("x", "d2", "l"))
        return found.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "l"))), 1, k).alias("near"))

    def _joined(self, df: DataFrame, found: DataFrame) -> DataFrame:
        found = found.withColumnRenamed("x", "x__")
        return df.join(found, F.col(self.column).cast("array<double>") == F.col("x__")).drop("x__")

    def neighbours(self, df: DataFrame, key: str) -> DataFrame:
        """(key, d2, l) of the k nearest training rows of each row; ``key`` names a unique column."""
        return self._joined(df.select(key, self.column), self._nearest(df)).select(key, F.inline("near"))

    def label_by(self, df: DataFrame, key: str, name: str = "label") -> DataFrame:
        ls = F.transform("near", lambda s: s["l"])
        votes = F.transform(F.array_distinct(ls), lambda v: F.struct((-F.size(F.filter(ls, lambda w: w.eqNullSafe(v)))).alias("n"), v.alias("l")))
        return self._joined(df, self._nearest(df).select("x", F.array_min(votes)["l"].alias(name)))


def _cell_of(cells: _Cells, x: pd.Series) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    if len(x):
        at, cell = cells.walk(np.stack(list(x)).astype(float))
        out[at] = cell
    return out


class SimpleMarkov(Classifier):
    """P(label | features) by counts: a table (features…, label, prob) made and joined in Spark."""

    def __init__(self, features: list[str], label: str = "label"):
        super().__init__(label)
        self.features = features

    def _fit(self, df):
        n = df.groupBy(*self.features, self.label_column).agg(F.count("*").alias("n"))
        self.table = n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*self.features)))

    def posterior(self) -> DataFrame:
        return self.table

    def prob(self, df: DataFrame, name: str = "prob") -> DataFrame:
        maps = self.table.groupBy(*self.features).agg(F.map_from_entries(F.collect_list(F.struct(self.label_column, "prob"))).alias(name))
        return df.join(maps, self.features, "left")

    def label(self, df: DataFrame, name: str = "label") -> DataFrame:
        return self.rank(df, None, "r__").withColumn(name, F.get("r__", F.lit(0))).drop("r__")


class Perceptron(Classifier):
    """Online perceptron on labels ±1: rate 0.1, weights from 1, bias from 0; rows are folded in order by one task."""

    def __init__(self, label: str = "label", order: str = "t", rate: float = 0.1, column: str = "x"):
        super().__init__(label, column)
        self.order, self.rate = order, rate

    def _fit(self, df):
        rate = self.rate

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, b = None, 0.0
            for pdf in batches:
                for x, y in zip(pdf["x"], pdf["y"], strict=True):
                    w = np.ones(len(x)) if w is None else w
                    e = y - (1.0 if x @ w + b > 0 else -1.0 if x @ w + b < 0 else 0.0)
                    w, b = w + rate * e * x, b + rate * e
            if w is not None:
                yield pd.DataFrame({"w": [w], "b": [b]})

        rows = df.select(F.col(self.column).alias("x"), F.col(self.label_column).cast("double").alias("y"), F.col(self.order).alias("t")).coalesce(1).sortWithinPartitions("t")
        r = rows.mapInPandas(fold, "w array<double>, b double").first()
        if r is None:
            raise TrainingError("no rows to fit on")
        self.w, self.b = np.array(r.w), r.b

    def label(self, df, name="label"):
        p = parts(self.column, len(self.w))
        return df.withColumn(name, F.signum(total([c * F.lit(float(v)) for c, v in zip(p, self.w, strict=True)] + [F.lit(float(self.b))])).cast("int"))


class Hopfield(Node):
    """Associative memory of boolean rows: Σ s sᵀ / d without its diagonal; recall by asynchronous sign updates."""

    trainable = True

    def __init__(self, seed: int = 0, column: str = "x"):
        super().__init__(column)
        self.seed = seed

    @staticmethod
    def signs(x: str) -> Column:
        return F.transform(x, lambda v: F.when(v.cast("int") > 0, 1.0).otherwise(-1.0))

    def _fit(self, df):
        m = moments(df.select(self.signs(self.column).alias("x")))
        self.weights, self.patterns = m.ss / len(m.ss), int(m.n)
        np.fill_diagonal(self.weights, 0.0)

    @property
    def memory_size(self) -> int:
        return len(self.weights)

    @property
    def load_parameter(self) -> float:
        return self.patterns / len(self.weights)

    def label(self, df: DataFrame, name: str = "label", threshold: float = 0.0) -> DataFrame:
        w, seed = self.weights, self.seed

        @F.pandas_udf("array<boolean>")
        def recall(col: pd.Series) -> pd.Series:
            out = []
            for row in col:
                s, rng = np.where(np.asarray(row).astype(float) > 0, 1.0, -1.0), np.random.default_rng(seed)
                for _ in range(100):
                    before = s.copy()
                    for i in rng.permutation(len(s)):
                        a = w[i] @ s - threshold
                        s[i] = s[i] if a == 0 else np.sign(a)
                    if np.array_equal(s, before):
                        break
                out.append(s > 0)
            return pd.Series(out)

        return df.withColumn(name, recall(self.column))

    transform = label


class MLAdapter(Node):
    """Any pyspark.ml estimator or transformer as an operator on the vector column.

    method: ``label`` (its prediction as column ``label``) or ``transform`` (its output as the new vector).
    """

    trainable = True

    def __init__(self, estimator, method: str = "transform", label: str = "label", column: str = "x"):
        super().__init__(column)
        self.estimator, self.method, self.label_column = estimator, method, label

    def _with(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("features__", array_to_vector(self.column))

    def _fit(self, df):
        e = self.estimator
        for name, value in (("featuresCol", "features__"), ("inputCol", "features__"), ("outputCol", "out__"), ("labelCol", self.label_column), ("predictionCol", "out__")):
            if e.hasParam(name):
                e.set(e.getParam(name), value)
        self.model = e.fit(self._with(df)) if hasattr(e, "fit") else e

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array

        self._ready()
        out = self.model.transform(self._with(df)).drop("features__")
        if self.method == "label":
            out = out.withColumn("label", F.col("out__"))
        else:
            out = out.withColumn(self.column, vector_to_array("out__"))
        return out.drop("out__", "rawPrediction", "probability")


def adapters() -> dict[str, type]:
    """All estimators of pyspark.ml that :class:`MLAdapter` can wrap, by name."""
    from pyspark.ml import classification, clustering, feature, regression
    from pyspark.ml.base import Estimator

    found = {}
    for module in (classification, clustering, feature, regression):
        for name in module.__all__:
            cls = getattr(module, name)
            if isinstance(cls, type) and issubclass(cls, Estimator):
                found[name] = cls
    return found


def normalized_labels(df: DataFrame, label: str, mode: str = "multi", name: str = "code") -> tuple[DataFrame, dict]:
    """Label codes: ``id`` as they are, ``dual`` −1 and 1, ``multi`` 0 to n − 1 in the order of labels; and the way back."""
    values = sorted(r[0] for r in df.select(label).distinct().collect())
    if mode == "dual" and len(values) > 2:
        raise ValueError("dual needs at most two labels")
    codes = {v: v if mode == "id" else (-1 if i == 0 else 1) if mode == "dual" else i for i, v in enumerate(values)}
    out = F.lit(None)
    for v, c in codes.items():
        out = F.when(F.col(label) == v, F.lit(c)).otherwise(out)
    return df.withColumn(name, out), {c: v for v, c in codes.items()}
