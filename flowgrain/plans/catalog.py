"""Named queries over the test tables, with the SQL that each must equal.

Every query goes through the operators of this package. Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import parts, vector
from ..functions import linalg, local
from ..operators import classifiers, decomposition, expansions, ica, manifold, moments, neural, routing, scaling, slow, timeops
from ..operators import graph as graphs
from ..streaming import online
from .flow import Flow

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_2d(spark, sf_dir)


# Inputs.
def items(spark: SparkSession, d: str, columns=FOUR) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("x", vector(columns))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), vector(["value"]).alias("x"), "value")


def vectors(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", "label", (x if n is None else F.slice(x, 1, n)).alias("x"))


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def outputs(df: DataFrame, n: int, keys=(), digits: int = 6, prefix: str = "y") -> DataFrame:
    """The vector as rounded columns."""
    return df.select(*keys, *[r(c, digits).alias(f"{prefix}{i}") for i, c in enumerate(parts("x", n))])


def sql_cols(exprs, digits: int = 6, prefix: str = "y") -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {prefix}{i}" for i, e in enumerate(exprs))


def matrix_rows(spark: SparkSession, m: np.ndarray, digits: int = 4) -> DataFrame:
    return spark.createDataFrame([(i, j, float(round(m[i, j], digits)) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, c double")


# Moments.
def _pairs(f: str) -> str:
    return " UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, round({f.format(a=FOUR[i], b=FOUR[j])}, 4) + 0.0 AS c FROM lineitem" for i in range(4) for j in range(i, 4))


def _cov(spark, d, **how):
    t = moments.covariance_table(spark.read.parquet(f"{d}/lineitem.parquet"), FOUR, **how)
    return t.select("i", "j", r("c", 4).alias("c"))


@query(_pairs("covar_samp({a}, {b})"))
def cov_matrix(spark, d):
    return _cov(spark, d)


@query(_pairs("covar_pop({a}, {b})"))
def cov_biased(spark, d):
    return _cov(spark, d, bias=True)


@query(_pairs("sum({a} * {b}) / (count(*) - 1)"))
def cov_uncentered(spark, d):
    return _cov(spark, d, center=False)


@query(" UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, round(covar_samp({FOUR[i]}, {FOUR[2 + j]}), 4) + 0.0 AS c FROM lineitem" for i in range(2) for j in range(2)))
def cross_cov(spark, d):
    df = items(spark, d).select(F.slice("x", 1, 2).alias("a"), F.slice("x", 3, 2).alias("b"))
    return matrix_rows(spark, moments.cross_covariance(df, "a", "b"))


@query(" UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, round(sum({FOUR[2 * i]} * {FOUR[1 + 2 * j]}) / (count(*) - 1) - avg({FOUR[2 * i]}) * avg({FOUR[1 + 2 * j]}), 4) + 0.0 AS c FROM lineitem" for i in range(2) for j in range(2)))
def cov2_mixed(spark, d):
    df = items(spark, d).select(F.array(F.get("x", F.lit(0)), F.get("x", F.lit(2))).alias("a"), F.array(F.get("x", F.lit(1)), F.get("x", F.lit(3))).alias("b"))
    return matrix_rows(spark, moments.cov2(df, "a", "b"))


@query("""WITH p AS (SELECT value AS x, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events)
SELECT 0::INTEGER AS i, 0::INTEGER AS j, round((sum(x * y) - sum(x) * sum(y) / count(*)) / (count(*) - 1), 4) + 0.0 AS c FROM p WHERE y IS NOT NULL""")
def delay_cov(spark, d):
    return matrix_rows(spark, timeops.delay_covariance(events(spark, d), 2, "us", "user_id"))


@query("""WITH p AS (SELECT value AS x, lag(value) OVER w AS y, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
m AS (SELECT sum(dt) AS n, sum(dt * (x + y) / 2) AS s, sum(dt * (x * x + y * y) / 2) AS q FROM p WHERE y IS NOT NULL)
SELECT 0::INTEGER AS i, 0::INTEGER AS j, round(q / n - (s / n) * (s / n), 4) + 0.0 AS c FROM m""")
def vartime_cov(spark, d):
    e = events(spark, d).withColumn("sec", F.col("us") / 1e6)
    return matrix_rows(spark, timeops.weighted_time_moments(e, "sec", "user_id").covariance(bias=True))


@query("SELECT l_returnflag AS g, round(count(*) * 1.0, 4) AS n, round(avg(l_quantity), 4) + 0.0 AS m0, round(avg(l_discount), 4) + 0.0 AS m1 FROM lineitem GROUP BY 1")
def label_means(spark, d):
    found = moments.moments_by(items(spark, d, ["l_quantity", "l_discount"]), "x", "l_returnflag")
    return spark.createDataFrame([(k, float(m.n), *(float(round(v, 4)) for v in m.mean())) for k, m in found.items()], "g string, n double, m0 double, m1 double")


# Row functions.
@query(f"SELECT {', '.join(KEY)}, {sql_cols(['least(greatest(l_extendedprice, 2000), 50000)', 'least(greatest(l_quantity, 2000), 50000)'])} FROM lineitem")
def cutoff(spark, d):
    return outputs(scaling.Cutoff(2000, 50000).transform(items(spark, d, ["l_extendedprice", "l_quantity"])), 2, KEY)


@query(f"""WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
b AS (SELECT max(x) FILTER (WHERE i = floor(0.1 * n)) AS lo, max(x) FILTER (WHERE i = floor(n - 0.05 * n)) AS hi FROM o)
SELECT {', '.join(KEY)}, round(least(greatest(l_extendedprice, lo), hi), 6) + 0.0 AS y0 FROM lineitem, b""")
def adaptive_cutoff(spark, d):
    return outputs(scaling.AdaptiveCutoff(0.1, 0.05).fit_transform(items(spark, d, ["l_extendedprice"])), 1, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols([FOUR[i] for i in (2, 0, 0, 3)])} FROM lineitem")
def switchboard(spark, d):
    return outputs(routing.Switchboard(4, [2, 0, 0, 3]).transform(items(spark, d)), 4, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(FOUR)} FROM lineitem")
def switchboard_inverse(spark, d):
    s = routing.Switchboard(4, [2, 0, 3, 1])
    return outputs(s.inverse_transform(s.transform(items(spark, d))), 4, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(['(l_quantity + l_discount) / 2', '0', 'l_extendedprice'])} FROM lineitem")
def mean_inverse(spark, d):
    s = routing.MeanInverseSwitchboard(3, [0, 2, 0])
    return outputs(s.inverse_transform(items(spark, d, ["l_quantity", "l_extendedprice", "l_discount"])), 3, KEY)


_FIELD = routing.Rectangular2dSwitchboard((8, 8), (4, 4), (2, 2))


@query(f"SELECT vec_id, {sql_cols([f'embedding[{c + 1}]::DOUBLE' for c in _FIELD.field(4)])} FROM embeddings")
def rect2d_fields(spark, d):
    rows = routing.Rectangular2dSwitchboard((8, 8), (4, 4), (2, 2)).transform(vectors(spark, d))
    return outputs(rows.withColumn("x", F.slice("x", 4 * 16 + 1, 16)), 16, ["vec_id"])


@query(f"SELECT vec_id, {sql_cols([f'embedding[{c + 1}]::DOUBLE' for c in routing.DoubleRect2dSwitchboard((8, 8), (4, 4)).field(2)])} FROM embeddings")
def double_rect2d_fields(spark, d):
    rows = routing.DoubleRect2dSwitchboard((8, 8), (4, 4)).transform(vectors(spark, d))
    return outputs(rows.withColumn("x", F.slice("x", 2 * 16 + 1, 16)), 16, ["vec_id"])


_QUAD = ["a", "b", "a * a", "a * b", "b * b"]
_AB = f"(SELECT {', '.join(KEY)}, l_discount AS a, l_tax AS b FROM lineitem)"


@query(f"SELECT {', '.join(KEY)}, {sql_cols(_QUAD)} FROM {_AB}")
def quad_expand(spark, d):
    return outputs(expansions.QuadraticExpansion().transform(items(spark, d, ["l_discount", "l_tax"])), 5, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols([*_QUAD, 'a * a * a', 'a * a * b', 'a * b * b', 'b * b * b'], 8)} FROM {_AB}")
def poly_expand3(spark, d):
    return outputs(expansions.PolynomialExpansion(3).transform(items(spark, d, ["l_discount", "l_tax"])), 9, KEY, 8)


@query("SELECT vec_id, " + sql_cols(["exp(-0.5 * (pow(embedding[1]::DOUBLE - 0.1, 2) + pow(embedding[2]::DOUBLE + 0.2, 2)) / 0.5)", "exp(-0.5 * (pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) / 2.0)"]) + " FROM embeddings")
def rbf_expand(spark, d):
    return outputs(expansions.RBFExpansion(np.array([[0.1, -0.2], [0.0, 0.0]]), np.array([0.5, 2.0])).transform(vectors(spark, d, 2)), 2, ["vec_id"])


_REC = {
    "standard_poly": (["a", "a*a", "a*a*a"], ["b", "b*b", "b*b*b"]),
    "legendre_poly": (["a", "(3*a*a-1)/2", "(5*a*a*a-3*a)/2"], ["b", "(3*b*b-1)/2", "(5*b*b*b-3*b)/2"]),
    "chebyshev_poly": (["a", "2*a*a-1", "4*a*a*a-3*a"], ["b", "2*b*b-1", "4*b*b*b-3*b"]),
}
_REC["legendre_rational"] = tuple([e.replace(v, f"(({v}-1)/({v}+1))") for e in es] for es, v in zip(_REC["legendre_poly"], "ab", strict=True))


def _rec_sql(name: str, source: str) -> str:
    a, b = _REC[name]
    terms = ["1.0", a[0], b[0], a[1], f"({a[0]})*({b[0]})", b[1], a[2], f"({a[1]})*({b[0]})", f"({a[0]})*({b[1]})", b[2]]
    return f"SELECT {', '.join(KEY)}, {sql_cols(terms, 9)} FROM {source}"


def _recursive(name):
    def f(spark, d):
        return outputs(expansions.RecursiveExpansion(3, name, check=True).transform(items(spark, d, ["l_discount", "l_tax"])), 10, KEY, 9)

    f.__name__ = "recursive_" + name
    return query(_rec_sql(name, _AB))(f)


for _name in _REC:
    _recursive(_name)


@query(_rec_sql("legendre_poly", f"(SELECT {', '.join(KEY)}, 2*(l_quantity-qa)/(qb-qa)-1 AS a, 2*(l_extendedprice-ea)/(eb-ea)-1 AS b FROM lineitem, (SELECT min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_extendedprice) AS ea, max(l_extendedprice) AS eb FROM lineitem))"))
def normalizing_recursive(spark, d):
    node = expansions.NormalizingRecursiveExpansion(3, "legendre_poly")
    return outputs(node.fit_transform(items(spark, d, ["l_quantity", "l_extendedprice"])), 10, KEY, 9)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(['a', 'b', 'abs(a - b)', 'sqrt(a + b)'])} FROM {_AB}")
def general_expand(spark, d):
    node = expansions.GeneralExpansion([lambda p: p, lambda p: [F.abs(p[0] - p[1])], lambda p: [F.sqrt(p[0] + p[1])]])
    return outputs(node.transform(items(spark, d, ["l_discount", "l_tax"])), 4, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols([f'({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem)' for c in FOUR], 5)} FROM lineitem")
def normalize(spark, d):
    return outputs(scaling.Normalize().fit_transform(items(spark, d)), 4, KEY, 5)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(FOUR, 5)} FROM lineitem")
def normalize_inverse(spark, d):
    node = scaling.Normalize().fit(items(spark, d))
    return outputs(node.inverse_transform(node.transform(items(spark, d))), 4, KEY, 5)


@query(f"SELECT {', '.join(KEY)}, round(0.5 * (2*a*a + 2*0.5*a*b + 4*b*b) + 0.3*a - 0.7*b + 1.5, 6) + 0.0 AS y FROM {_AB}")
def quad_form(spark, d):
    q = linalg.QuadraticForm(np.array([[2.0, 0.5], [0.5, 4.0]]), np.array([0.3, -0.7]), 1.5)
    a, b = F.col("l_discount"), F.col("l_tax")
    value = 0.5 * (q.h[0, 0] * a * a + 2 * q.h[0, 1] * a * b + q.h[1, 1] * b * b) + q.f[0] * a + q.f[1] * b + q.c
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*KEY, r(value).alias("y"))


@query(f"SELECT {', '.join(KEY)}, sign(l_quantity - 25 + l_discount)::INTEGER AS label FROM lineitem")
def signum(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("x", F.array(F.col("l_quantity") - 25, F.col("l_discount")))
    return scaling.Signum().label(df).select(*KEY, "label")


@query(f"SELECT {', '.join(KEY)}, {sql_cols(['sqrt(l_quantity*l_quantity + l_discount*l_discount)', '0.8660254037844387*l_quantity + 0.49999999999999994*l_discount', '0.8660254037844387*l_discount - 0.49999999999999994*l_quantity'])} FROM lineitem")
def norm_and_rotation(spark, d):
    df = items(spark, d, ["l_quantity", "l_discount"])
    a, b = local.rotate_pair(F.col("l_quantity"), F.col("l_discount"), 30, "degrees")
    return df.select(*KEY, r(local.norm2("x")).alias("y0"), r(a).alias("y1"), r(b).alias("y2"))


@query("SELECT o_orderkey, bit_count(o_orderkey)::INTEGER AS weight, CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END AS s FROM orders")
def hamming_and_sign(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", local.hamming_weight("o_orderkey").alias("weight"), local.bool_to_sign(F.col("o_totalprice") > 150000).alias("s"))


# Time.
@query("WITH p AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS y FROM events) SELECT event_id, round(y, 6) + 0.0 AS y0 FROM p WHERE y IS NOT NULL")
def time_diff(spark, d):
    return outputs(timeops.time_difference(events(spark, d), "us", "user_id"), 1, ["event_id"])


@query("WITH p AS (SELECT event_id, value - lag(value) OVER (ORDER BY event_id) AS y FROM events) SELECT event_id, round(y, 6) + 0.0 AS y0 FROM p WHERE y IS NOT NULL")
def time_diff_global(spark, d):
    return outputs(timeops.time_difference(events(spark, d), "event_id"), 1, ["event_id"])


@query("WITH p AS (SELECT event_id, value AS a, lead(value, 2) OVER w AS b, lead(value, 4) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, " + sql_cols(["a", "b", "c"]) + " FROM p WHERE c IS NOT NULL")
def time_frames(spark, d):
    return outputs(timeops.TimeFrames(3, 2, "us", "user_id").transform(events(spark, d)), 3, ["event_id"])


@query("SELECT event_id AS t, round(value, 6) + 0.0 AS y0 FROM events")
def time_frames_inverse(spark, d):
    node = timeops.TimeFrames(3, 2, "t")
    e = events(spark, d).select(F.col("event_id").alias("t"), "x")
    return outputs(node.pseudo_inverse(node.transform(e)), 1, ["t"])


@query("SELECT event_id, " + sql_cols(["value", "lag(value, 3, 0.0) OVER w", "lag(value, 6, 0.0) OVER w"]) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def time_delay(spark, d):
    return outputs(timeops.TimeDelay(3, 3, "us", "user_id").transform(events(spark, d)), 3, ["event_id"])


@query("SELECT event_id, " + sql_cols(["value", "lag(value, 2, 0.0) OVER w"]) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def sliding_window(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", "x")
    return outputs(online.SlidingDelay(2, 2, "us").learn_and_apply(e, "user_id"), 2, ["event_id"])


@query("""WITH p AS (SELECT value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS y FROM events)
SELECT round(sqrt(sum((y-x)*(y-x)) / count(*) / ((sum(x*x) - sum(x)*sum(x)/count(*)) / (count(*)-1))) / (2*pi()), 6) AS eta FROM p WHERE y IS NOT NULL""")
def eta(spark, d):
    return spark.createDataFrame([(float(round(scaling.eta_values(events(spark, d), "us", "user_id")[0], 6)),)], "eta double")


@query("WITH p AS (SELECT value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS y FROM events) SELECT round(avg(y*y), 4) AS delta FROM p")
def delta(spark, d):
    return spark.createDataFrame([(round(scaling.mean_squared_difference(events(spark, d), "us", "user_id")[0], 4),)], "delta double")


@query("SELECT kind, v, x, t FROM (SELECT 'max' AS kind, row_number() OVER (ORDER BY value DESC, event_id) AS v, round(value, 6) AS x, event_id AS t FROM events UNION ALL SELECT 'min', row_number() OVER (ORDER BY value, event_id), round(value, 6), event_id FROM events) WHERE v <= 5")
def hit_parade(spark, d):
    node = scaling.HitParade(5, 1, "event_id").fit(events(spark, d))
    rows = [(k, i + 1, round(x, 6), t) for k, found in (("max", node.maxima), ("min", node.minima)) for i, (x, t) in enumerate(found[0])]
    return spark.createDataFrame(rows, "kind string, v long, x double, t long")


@query()
def hit_parade_gap(spark, d):
    node = scaling.HitParade(5, 10, "event_id").fit(events(spark, d))
    rows = [(k, i + 1, round(x, 6), t) for k, found in (("max", node.maxima), ("min", node.minima)) for i, (x, t) in enumerate(found[0])]
    return spark.createDataFrame(rows, "kind string, v long, x double, t long")


@query("SELECT CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 51 THEN 11 ELSE floor((l_quantity - 1) / 5) + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return scaling.Histogram().fit(items(spark, d, ["l_quantity"])).bins(0, 1.0, 51.0, 10)


@query()
def noise(spark, d):
    return outputs(scaling.NormalNoise(0.0, 0.1, seed=3).transform(items(spark, d)), 4, KEY)


@query("SELECT count(*) AS n, true AS centred, true AS spread FROM lineitem")
def noise_limits(spark, d):
    """Over all rows the added noise has mean zero and standard deviation 0.1, within five standard errors."""
    clean = items(spark, d, ["l_quantity"]).withColumn("was", F.col("l_quantity").cast("double"))
    added = scaling.NormalNoise(0.0, 0.1, seed=3).transform(clean).select((parts("x", 1)[0] - F.col("was")).alias("e"))
    near = lambda c, want: F.abs(c - F.lit(want)) < F.lit(0.5) / F.sqrt(F.count("*"))
    return added.agg(F.count("*").alias("n"), near(F.avg("e"), 0.0).alias("centred"), near(F.stddev("e"), 0.1).alias("spread"))


# Linear models.
_EIG = """c AS (SELECT avg(l_quantity) AS ma, avg(l_discount * 100) AS mb, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS d FROM lineitem),
e AS (SELECT *, (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l1, (a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l2 FROM c),
n1 AS (SELECT *, b AS v1a, l1 - a AS v1b, sqrt(b * b + (l1 - a) * (l1 - a)) AS z1, b AS v2a, l2 - a AS v2b, sqrt(b * b + (l2 - a) * (l2 - a)) AS z2 FROM e),
n2 AS (SELECT *, v1a / z1 * sign(CASE WHEN abs(v1a) >= abs(v1b) THEN v1a ELSE v1b END) AS p1a, v1b / z1 * sign(CASE WHEN abs(v1a) >= abs(v1b) THEN v1a ELSE v1b END) AS p1b,
  v2a / z2 * sign(CASE WHEN abs(v2a) >= abs(v2b) THEN v2a ELSE v2b END) AS p2a, v2b / z2 * sign(CASE WHEN abs(v2a) >= abs(v2b) THEN v2a ELSE v2b END) AS p2b FROM n1)"""


def _two(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("x", vector([F.col("l_quantity"), F.col("l_discount") * 100]))


_PROJ = ["(l_quantity - ma) * p1a + (l_discount * 100 - mb) * p1b", "(l_quantity - ma) * p2a + (l_discount * 100 - mb) * p2b"]


@query(f"WITH {_EIG} SELECT {', '.join(KEY)}, {sql_cols(_PROJ, 4)} FROM lineitem, n2")
def pca_2d(spark, d):
    return outputs(decomposition.PCA().fit_transform(_two(spark, d)), 2, KEY, 4)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(['l_quantity', 'l_discount * 100'], 4)} FROM lineitem")
def pca_inverse(spark, d):
    node = decomposition.PCA().fit(_two(spark, d))
    return outputs(node.inverse_transform(node.transform(_two(spark, d))), 2, KEY, 4)


@query(f"WITH {_EIG} SELECT {', '.join(KEY)}, {sql_cols([f'({_PROJ[0]}) / sqrt(l1)', f'({_PROJ[1]}) / sqrt(l2)'], 4)} FROM lineitem, n2")
def whiten_2d(spark, d):
    return outputs(decomposition.Whitening().fit_transform(_two(spark, d)), 2, KEY, 4)


@query(f"WITH {_EIG} SELECT round(l1 / (l1 + l2), 5) AS share FROM n2")
def pca_explained(spark, d):
    return spark.createDataFrame([(round(decomposition.PCA(1).fit(_two(spark, d)).explained_variance, 5),)], "share double")


@query(f"WITH {_EIG} SELECT {', '.join(KEY)}, round({_PROJ[0]}, 3) + 0.0 AS y0 FROM lineitem, n2")
def nipals(spark, d):
    return outputs(decomposition.NIPALS(1, conv=1e-13).fit_transform(_two(spark, d)), 1, KEY, 3)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linreg(spark, d):
    df = items(spark, d, ["l_quantity"]).withColumn("y", vector(["l_extendedprice"]))
    b = decomposition.LinearRegression().fit(df).beta
    return spark.createDataFrame([(float(round(b[1, 0], 4)), float(round(b[0, 0], 3)))], "slope double, intercept double")


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem")
def linreg_nobias(spark, d):
    df = items(spark, d, ["l_quantity"]).withColumn("y", vector(["l_extendedprice"]))
    b = decomposition.LinearRegression(with_bias=False).fit(df).beta
    return spark.createDataFrame([(float(round(b[0, 0], 4)),)], "slope double")


def _series(spark, d):
    """Two signals of each user: the value and a running mix of it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts")
    return e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.array(F.col("value"), F.col("value") * 0.5 + F.coalesce(F.lag("value").over(w), F.lit(0.0))).alias("x"))


_SFA = """s AS (SELECT event_id, user_id, ts, value AS x, value * 0.5 + lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts) AS y FROM events),
dd AS (SELECT x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT var_samp(x) AS b11, covar_samp(x, y) AS b12, var_samp(y) AS b22 FROM s),
a AS (SELECT sum(dx*dx)/(count(*)-1) AS a11, sum(dx*dy)/(count(*)-1) AS a12, sum(dy*dy)/(count(*)-1) AS a22 FROM dd WHERE dx IS NOT NULL),
q AS (SELECT b11*b22-b12*b12 AS p, a11*b22+a22*b11-2*a12*b12 AS m, a11*a22-a12*a12 AS z FROM a, b)"""


@query(f"WITH {_SFA} SELECT i, d FROM (SELECT 0::INTEGER AS i, round((m - sqrt(m*m-4*p*z))/(2*p), 5) AS d FROM q UNION ALL SELECT 1::INTEGER, round((m + sqrt(m*m-4*p*z))/(2*p), 5) FROM q)")
def sfa_2d(spark, d):
    node = slow.SFA(order="us", chunk="user_id").fit(_series(spark, d))
    return spark.createDataFrame([(i, float(round(v, 5))) for i, v in enumerate(node.d)], "i int, d double")


@query("""WITH g AS (SELECT l_returnflag AS l, avg(l_quantity) AS ma, avg(l_discount*100) AS mb FROM lineitem GROUP BY 1),
w AS (SELECT sum((l_quantity-ma)*(l_quantity-ma)) AS a11, sum((l_quantity-ma)*(l_discount*100-mb)) AS a12, sum((l_discount*100-mb)*(l_discount*100-mb)) AS a22 FROM lineitem JOIN g ON l = l_returnflag),
b AS (SELECT var_samp(l_quantity) AS b11, covar_samp(l_quantity, l_discount*100) AS b12, var_samp(l_discount*100) AS b22 FROM lineitem),
q AS (SELECT b11*b22-b12*b12 AS p, a11*b22+a22*b11-2*a12*b12 AS m, a11*a22-a12*a12 AS z FROM w, b)
SELECT i, d FROM (SELECT 0::INTEGER AS i, round((m - sqrt(m*m-4*p*z))/(2*p), 2) AS d FROM q UNION ALL SELECT 1::INTEGER, round((m + sqrt(m*m-4*p*z))/(2*p), 2) FROM q)""")
def fda_2d(spark, d):
    node = decomposition.FDA(label="l_returnflag").fit(_two(spark, d))
    return spark.createDataFrame([(i, float(round(v, 2))) for i, v in enumerate(node.d)], "i int, d double")


# Classifiers.
@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), d AS (SELECT vec_id, m.label, sum((v - m) * (v - m)) AS d FROM e JOIN m USING (i) GROUP BY 1, 2)
SELECT vec_id, arg_min(label, (d, label)) AS label FROM (SELECT vec_id, label, round(d, 9) AS d FROM d) GROUP BY 1""")
def nearest_mean(spark, d):
    node = classifiers.NearestMean().fit(vectors(spark, d))
    return node.label(vectors(spark, d)).select("vec_id", "label")


@query(f"""WITH g AS (SELECT l_returnflag AS l, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount*100) AS mb, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount*100) AS b, var_samp(l_discount*100) AS d FROM lineitem GROUP BY 1),
p AS (SELECT *, (SELECT count(*) FROM lineitem) AS total FROM g),
s AS (SELECT {', '.join('i.' + k for k in [*KEY, 'l_extendedprice', 'l_quantity', 'l_shipdate'])}, l, ln(n * 1.0 / total) - 0.5 * ln(a*d-b*b) - 0.5 * (d*pow(l_quantity-ma,2) - 2*b*(l_quantity-ma)*(l_discount*100-mb) + a*pow(l_discount*100-mb,2)) / (a*d-b*b) AS s FROM lineitem i, p)
SELECT {', '.join(KEY)}, arg_max(l, s) AS label FROM s GROUP BY {', '.join([*KEY, 'l_extendedprice', 'l_quantity', 'l_shipdate'])}""")
def gaussian_2d(spark, d):
    node = classifiers.Gaussian("l_returnflag").fit(_two(spark, d))
    return node.label(_two(spark, d)).select(*KEY, "label")


@query(f"""WITH e AS (SELECT vec_id, label, {', '.join(f'embedding[{i}]::DOUBLE AS x{i}' for i in range(1, 65))} FROM embeddings),
r AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {'+'.join(f'pow(q.x{i}-t.x{i},2)' for i in range(1, 65))}, t.label) AS rn FROM e q, e t),
v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rn <= 5 GROUP BY 1, 2) SELECT vec_id, arg_min(label, (-n, label)) AS label FROM v GROUP BY 1""")
def knn(spark, d):
    node = classifiers.KNN(5).fit(vectors(spark, d))
    return node.label_by(vectors(spark, d).drop("label"), "vec_id").select("vec_id", "label")


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), c(k, ca, cb) AS (VALUES (0, -0.1, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1)),
n AS (SELECT vec_id, a, b, arg_min(k, (pow(a-ca,2)+pow(b-cb,2), k)) AS k FROM e, c GROUP BY ALL) SELECT k::INTEGER AS k, round(avg(a), 6) + 0.0 AS a, round(avg(b), 6) + 0.0 AS b FROM n GROUP BY 1""")
def kmeans_step(spark, d):
    node = classifiers.KMeans(3, 1, init=np.array([[-0.1, 0.0], [0.1, 0.0], [0.0, 0.1]])).fit(vectors(spark, d, 2))
    return spark.createDataFrame([(i, float(round(a, 6)) + 0.0, float(round(b, 6)) + 0.0) for i, (a, b) in enumerate(node.centroids)], "k int, a double, b double")


@query("SELECT source, lang, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS prob FROM documents GROUP BY 1, 2")
def markov(spark, d):
    node = classifiers.SimpleMarkov(["source"], "lang").fit(spark.read.parquet(f"{d}/documents.parquet"))
    return node.posterior().select("source", "lang", "n", r("prob").alias("prob"))


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, string_agg(lang, ',' ORDER BY n DESC, lang) AS rank FROM n GROUP BY 1")
def rank_labels(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "lang")
    node = classifiers.SimpleMarkov(["source"], "lang").fit(docs)
    ranked = node.prob(docs.select("source").distinct()).withColumn("rank", classifiers.ranked(F.col("prob")))
    return ranked.select("source", F.array_join("rank", ",").alias("rank"))


@query("SELECT 0::INTEGER AS i, 1::INTEGER AS j, round(sum((2*quality-1)*(2*toxic-1)) / 2.0, 6) + 0.0 AS w FROM labels")
def hopfield_weights(spark, d):
    df = spark.read.parquet(f"{d}/labels.parquet").select(F.array("quality", "toxic").alias("x"))
    return spark.createDataFrame([(0, 1, float(classifiers.Hopfield().fit(df).weights[0, 1]))], "i int, j int, w double")


@query("SELECT doc_id, round(-0.5*quality + 0.25*toxic - (0.1*quality + 0.2*toxic) - 0.3, 6) + 0.0 AS energy FROM labels")
def rbm_energy(spark, d):
    node = neural.RBM(1)
    node.w, node.bv, node.bh = np.array([[0.1], [0.2]]), np.array([0.5, -0.25]), np.array([0.3])
    df = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", vector(["quality", "toxic"]).alias("v"), F.array(F.lit(1.0)).alias("h"))
    return df.select("doc_id", r(node.energy("v", "h")).alias("energy"))


# Online.
@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS avg FROM events")
def online_mean(spark, d):
    return online.running_mean(events(spark, d), "us", "user_id").select("event_id", r(F.get("avg", F.lit(0)), 9).alias("avg"))


@query("SELECT event_id, round(value - lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts), 6) + 0.0 AS y0 FROM events")
def online_timediff(spark, d):
    return outputs(online.OnlineTimeDiff("us").learn_and_apply(events(spark, d).select("event_id", "user_id", "us", "x"), "user_id"), 1, ["event_id"])


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
e AS (SELECT event_id, user_id, i, value, value AS avg FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, o.value, 0.8 * e.avg + 0.2 * o.value FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT event_id, round(CASE WHEN i > 1 THEN value - avg ELSE value END, 6) + 0.0 AS y0 FROM e""")
def ema(spark, d):
    return outputs(online.OnlineCentering(9, "us").learn_and_apply(events(spark, d).select("event_id", "user_id", "us", "x"), "user_id"), 1, ["event_id"])


# Layers.
@query(f"SELECT {', '.join(KEY)}, {sql_cols(['l_quantity', 'l_discount', 'l_quantity*l_quantity', 'l_quantity*l_discount', 'l_discount*l_discount', 'least(l_tax, 0.05)'])} FROM lineitem")
def layer(spark, d):
    node = routing.Layer([expansions.QuadraticExpansion(2), scaling.Cutoff(None, 0.05)], [2, 1])
    return outputs(node.fit_transform(items(spark, d, ["l_quantity", "l_discount", "l_tax"])), 6, KEY)


@query(f"SELECT {', '.join(KEY)}, {sql_cols(['l_quantity', 'l_discount', 'least(l_quantity, 10)', 'least(l_discount, 10)'])} FROM lineitem")
def same_input(spark, d):
    return outputs(routing.SameInputLayer([scaling.Identity(), scaling.Cutoff(None, 10)]).fit_transform(items(spark, d, ["l_quantity", "l_discount"])), 4, KEY)


@query(f"WITH v AS (SELECT l_discount AS v FROM lineitem UNION ALL SELECT l_tax FROM lineitem), m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM v) SELECT {', '.join(KEY)}, {sql_cols(['(l_discount - m) / s', '(l_tax - m) / s'], 5)} FROM lineitem, m")
def clone_layer(spark, d):
    return outputs(routing.CloneLayer(scaling.Normalize(), 2, 1).fit_transform(items(spark, d, ["l_discount", "l_tax"])), 2, KEY, 5)


# Graph-based slow features.
_GSFA = "SELECT round({n}, 3) AS n, round({s}, 3) AS s, round({q}, 3) AS q, round({r}, 3) AS r, round({dd}, 3) AS dd FROM "


def _graph_row(spark, g):
    return spark.createDataFrame([tuple(float(round(v, 3)) for v in (g.x.n, g.x.s[0], g.x.ss[0, 0], g.n_diffs, g.dd[0, 0]))], "n double, s double, q double, r double, dd double")


@query("WITH g AS (SELECT user_id, count(*)::DOUBLE AS n, sum(value) AS s, sum(value*value) AS q FROM events GROUP BY 1) " + _GSFA.format(n="sum(n)", s="sum(s)", q="sum(q)", r="sum(n)", dd="sum(2*(n*q-s*s)/n)") + "g")
def gsfa_clustered(spark, d):
    return _graph_row(spark, slow.graph_moments(events(spark, d), "clustered", "event_id", block="user_id"))


@query("""WITH b AS (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) / 50) AS b, value FROM events), g AS (SELECT b, count(*)::DOUBLE AS n, sum(value) AS s, sum(value*value) AS q FROM b GROUP BY 1),
l AS (SELECT *, lead(n) OVER w AS n2, lead(s) OVER w AS s2, lead(q) OVER w AS q2, CASE WHEN lag(b) OVER w IS NULL OR lead(b) OVER w IS NULL THEN 1 ELSE 2 END AS f FROM g WINDOW w AS (ORDER BY b)) """
       + _GSFA.format(n="sum(f*n)", s="sum(f*s)", q="sum(f*q)", r="sum((n+n2)/2)", dd="sum((n2*q+n*q2-2*s*s2)*(n+n2)/(2*n*n2))") + "l")
def gsfa_serial(spark, d):
    return _graph_row(spark, slow.graph_moments(events(spark, d), "serial", "event_id", block_size=50))


@query("""WITH o AS (SELECT value AS x, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS c FROM events), f AS (SELECT *, least(i, 2) + least(c - 1 - i, 2) AS f, lead(x, 1) OVER (ORDER BY i) AS a, lead(x, 2) OVER (ORDER BY i) AS b FROM o) """
       + _GSFA.format(n="sum(f)", s="sum(f*x)", q="sum(f*x*x)", r="2.0*(count(a)+count(b))", dd="2*(sum(pow(a-x,2))+sum(pow(b-x,2)))") + "f")
def gsfa_window(spark, d):
    return _graph_row(spark, slow.graph_moments(events(spark, d), "window", "event_id", half=2))


@query("""WITH o AS (SELECT value AS x, lag(value) OVER (ORDER BY event_id) AS y FROM events) """ + _GSFA.format(n="count(*)::DOUBLE", s="sum(x)", q="sum(x*x)", r="count(y)::DOUBLE", dd="sum((x-y)*(x-y))") + "o")
def gsfa_regular(spark, d):
    return _graph_row(spark, slow.graph_moments(events(spark, d), "regular", "event_id"))


@query("""WITH g AS (SELECT a.event_id AS src, b.event_id AS dst, 1.0 / (1 + a.event_id % 3) AS w, a.value AS x, b.value AS y FROM events a JOIN events b ON b.event_id = a.event_id + 7)
SELECT round(sum(w * (y - x) * (y - x)) / sum(w), 4) AS delta FROM g""")
def graph_delta(spark, d):
    e = events(spark, d)
    edges = e.select(F.col("event_id").alias("src"), (F.col("event_id") + 7).alias("dst"), (1.0 / (1 + F.col("event_id") % 3)).alias("w"))
    return spark.createDataFrame([(float(round(slow.graph_delta_values(e, edges, "event_id")[0], 4)),)], "delta double")


# Graphs.
_EDGES = "(SELECT n_nationkey AS src, n_nationkey + 5 AS dst FROM nation WHERE n_nationkey + 5 < 25 AND n_regionkey <> 2)"


def _nation_graph(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("id")), n.where("n_nationkey + 5 < 25 and n_regionkey <> 2").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 5).alias("dst"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), r AS (SELECT n_nationkey AS id, n_nationkey AS c FROM nation UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def connected_components(spark, d):
    return graphs.component_labels(*_nation_graph(spark, d))


@query(f"WITH RECURSIVE r AS (SELECT n_nationkey AS id, 0 AS level FROM nation UNION SELECT e.dst, r.level + 1 FROM r JOIN {_EDGES} e ON e.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY 1")
def topo_sort(spark, d):
    return graphs.topological_levels(*_nation_graph(spark, d))


# Without an SQL form: rows are checked, and invariants in the tests.
@query()
def fa(spark, d):
    return outputs(decomposition.FactorAnalysis(2).fit_transform(vectors(spark, d, 6)), 2, ["vec_id"])


@query()
def fastica(spark, d):
    return outputs(ica.FastICA("symm", limit=1e-4, max_it=40).fit_transform(vectors(spark, d, 4)), 4, ["vec_id"])


@query()
def jade(spark, d):
    return outputs(ica.JADE().fit_transform(vectors(spark, d, 4)), 4, ["vec_id"])


@query()
def cubica(spark, d):
    return outputs(ica.CuBICA().fit_transform(vectors(spark, d, 4)), 4, ["vec_id"])


def _covariance_of_outputs(df: DataFrame, n: int) -> DataFrame:
    """(i, j, c): sample covariances of the vector's parts over all rows, by Spark's own aggregates."""
    x = parts("x", n)
    flat = df.select(*[c.alias(f"y{i}") for i, c in enumerate(x)])
    sums = flat.agg(*[F.covar_samp(f"y{i}", f"y{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(n)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r(F.col(f"c{i}_{j}"), 3).alias("c")) for i in range(n) for j in range(n)]))
    return sums.select(rows.alias("r")).select("r.*")


# The outputs of independent components have unit variance and no correlation, whatever rotation was found.
_IDENTITY = "SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, CASE WHEN a.i = b.j THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM range(4) a(i), range(4) b(j)"


@query(_IDENTITY)
def fastica_covariance(spark, d):
    return _covariance_of_outputs(ica.FastICA("symm", limit=1e-4, max_it=40).fit_transform(vectors(spark, d, 4)), 4)


@query(_IDENTITY)
def jade_covariance(spark, d):
    return _covariance_of_outputs(ica.JADE().fit_transform(vectors(spark, d, 4)), 4)


@query(_IDENTITY)
def cubica_covariance(spark, d):
    return _covariance_of_outputs(ica.CuBICA().fit_transform(vectors(spark, d, 4)), 4)


@query()
def isfa(spark, d):
    return outputs(slow.ISFA(2, order="us", chunk="user_id").fit_transform(_series(spark, d)), 2, ["event_id"])


@query()
def tdsep(spark, d):
    return outputs(slow.TDSEP(2, order="us", chunk="user_id").fit_transform(_series(spark, d)), 2, ["event_id"])


@query()
def sfa2(spark, d):
    return outputs(slow.SFA2(2, order="us", chunk="user_id").fit_transform(_series(spark, d)), 2, ["event_id"])


@query()
def xsfa(spark, d):
    return outputs(slow.XSFA(2, order="us", chunk="user_id").fit_transform(_series(spark, d)), 2, ["event_id"])


@query()
def gsfa(spark, d):
    return outputs(slow.GSFA("clustered", 2, "vec_id", block="label").fit_transform(vectors(spark, d, 4)), 2, ["vec_id"])


@query()
def igsfa(spark, d):
    return outputs(slow.IGSFA(3, 1, "QR_decomposition", True, order="vec_id").fit_transform(vectors(spark, d, 4)), 3, ["vec_id"])


@query()
def vartime_sfa(spark, d):
    s = _series(spark, d).withColumn("sec", F.col("us") / 1e6)
    return outputs(slow.VartimeSFA(2, "sec", "user_id").fit_transform(s), 2, ["event_id"])


def _embedded(node: manifold.LLE, df: DataFrame) -> DataFrame:
    """Every row embedded; a table above ``most_rows`` rows is fitted on that many of them, spread by a hash of the id."""
    fit = df if df.count() <= node.most_rows else df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(node.most_rows)
    return node.fit(fit.orderBy("vec_id")).transform(df)


@query()
def lle(spark, d):
    return outputs(_embedded(manifold.LLE(8, 2), vectors(spark, d, 4)), 2, ["vec_id"])


@query()
def hlle(spark, d):
    return outputs(_embedded(manifold.HLLE(10, 2), vectors(spark, d, 4)), 2, ["vec_id"])


@query()
def neural_gas(spark, d):
    return neural.NeuralGas(5, epochs=3).fit_transform(vectors(spark, d, 3)).select("vec_id", "node")


@query()
def growing_neural_gas(spark, d):
    return neural.GrowingNeuralGas(order="vec_id", max_nodes=12).fit_transform(vectors(spark, d, 3)).select("vec_id", "node")


@query()
def gas_expansion(spark, d):
    return neural.GrowingNeuralGasExpansion(6, order="vec_id").fit_transform(vectors(spark, d, 3)).select("vec_id", "x")


@query()
def rbm(spark, d):
    df = vectors(spark, d, 6).withColumn("x", F.transform("x", lambda v: (v > 0).cast("double")))
    return outputs(neural.RBM(3, epochs=3).fit_transform(df), 3, ["vec_id"])


@query()
def perceptron(spark, d):
    df = vectors(spark, d, 4).withColumn("label", F.when(F.col("label") > 0, 1).otherwise(-1))
    return classifiers.Perceptron(order="vec_id").fit(df).label(df, "said").select("vec_id", "said")


@query()
def hopfield_recall(spark, d):
    df = vectors(spark, d, 8).withColumn("x", F.transform("x", lambda v: v > 0))
    node = classifiers.Hopfield().fit(df)
    return node.label(df, "said").select("vec_id", "said")


@query()
def ccipca(spark, d):
    c = scaling.Normalize().fit_transform(vectors(spark, d, 4))
    return outputs(online.CCIPCA(order="vec_id").fit(c).transform(c), 4, ["vec_id"])


@query()
def mca(spark, d):
    c = scaling.Normalize().fit_transform(vectors(spark, d, 4))
    return outputs(online.MCA(2, order="vec_id").fit(c).transform(c), 2, ["vec_id"])


@query()
def incsfa(spark, d):
    c = scaling.Normalize().fit_transform(vectors(spark, d, 4))
    return outputs(online.IncSFA(2, order="vec_id").fit(c).transform(c), 2, ["vec_id"])


@query()
def online_flow(spark, d):
    flow = online.OnlineFlow([online.OnlineCentering(), online.CCIPCA(2)], "vec_id")
    return outputs(flow.fit(vectors(spark, d, 4)).transform(vectors(spark, d, 4)), 2, ["vec_id"])


def _at(row: int, column: int) -> str:
    return f"embedding[{8 * row + column + 1}]::DOUBLE"


_WINDOWS = [(i, j) for i in range(7) for j in range(7)]
_DIAGONAL = [f"{_at(i + 1, j + 1)} - {_at(i, j)}" for i, j in _WINDOWS]
_MEAN = [f"({_at(i, j)} + {_at(i, j + 1)} + {_at(i + 1, j)} + {_at(i + 1, j + 1)}) / 4" for i, j in _WINDOWS]


@query(f"SELECT vec_id, {sql_cols(_DIAGONAL + _MEAN)} FROM embeddings")
def convolution(spark, d):
    """Both filters at all 49 places of the 8 × 8 images."""
    node = routing.Convolution2D(np.array([[[1.0, 0], [0, -1]], [[0.25] * 2] * 2]), (8, 8), mode="valid")
    return outputs(node.transform(vectors(spark, d)), 98, ["vec_id"])


@query()
def flow_poly_pca_sfa(spark, d):
    flow = Flow([expansions.PolynomialExpansion(3), decomposition.PCA(6, svd=True), slow.SFA(3, "us", "user_id", rank_deficit="pca")])
    return outputs(flow.fit(_series(spark, d)).transform(_series(spark, d)), 3, ["event_id"])


@query()
def linear_svm(spark, d):
    from pyspark.ml.classification import LinearSVC

    df = vectors(spark, d, 8).withColumn("label", (F.col("label") > 4).cast("int"))
    return classifiers.MLAdapter(LinearSVC(maxIter=5), "label").fit_transform(df).select("vec_id", "label")
