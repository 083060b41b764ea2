"""Invariants and planted structure of the operators, recomputed with numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgrain.core import Node, TrainingError
from flowgrain.functions import linalg, local
from flowgrain.operators import classifiers, decomposition, expansions, graph, ica, manifold, moments, neural, routing, scaling, slow, timeops
from flowgrain.plans.flow import CachePolicy, Extensions, Flow, FlowError, MessageFlow, MessageNode, Sender, checkpoint_to, load_flow, save_flow
from flowgrain.sources import tables
from flowgrain.streaming import online


def frame(spark, x, **cols):
    return tables.from_array(spark, np.asarray(x, float), **cols)


def mat(df, column="x"):
    return tables.to_array(df, column)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (400, 3)) @ rng.standard_normal((3, 3)) + [1, 2, 3]
    return x, frame(spark, x).persist()


def test_moments_wide_and_narrow_agree(spark, mixed, monkeypatch):
    x, df = mixed
    assert np.allclose(moments.moments(df).covariance(), np.cov(x.T))
    monkeypatch.setattr(moments, "UNROLLED", 1)
    assert np.allclose(moments.moments(df).covariance(), np.cov(x.T))
    by = moments.moments_by(df.withColumn("g", F.col("t") % 3), "x", "g")
    assert all(np.allclose(by[g].covariance(), np.cov(x[g::3].T)) for g in range(3))


def test_pca_whitening_and_inverse(mixed):
    x, df = mixed
    y = mat(decomposition.Whitening().fit_transform(df))
    assert np.allclose(np.cov(y.T), np.eye(3), atol=1e-8) and np.allclose(y.mean(0), 0, atol=1e-9)
    p = decomposition.PCA(0.9).fit(df)
    assert p.explained_variance >= 0.9 and np.all(np.diff(p.d) <= 0)
    full = decomposition.PCA().fit(df)
    assert np.allclose(mat(full.inverse_transform(full.transform(df))), x)
    n = decomposition.NIPALS(2, conv=1e-12).fit(df)
    assert np.allclose(n.d, full.d[:2]) and np.allclose(np.abs(n.v.T @ full.v[:, :2]), np.eye(2), atol=1e-4)


def test_sfa_finds_the_slow_sine(spark):
    t = np.linspace(0, 2 * np.pi, 1000)
    s = np.stack([np.sin(t), np.sin(9 * t + 1)], 1)
    df = frame(spark, s @ np.array([[1, 0.4], [0.7, -1]]))
    node = slow.SFA(order="t").fit(df)
    y = mat(node.transform(df))
    assert abs(np.corrcoef(y[:, 0], s[:, 0])[0, 1]) > 0.999 and node.d[0] < node.d[1]
    assert np.allclose(mat(node.inverse_transform(node.transform(df))), mat(df))
    even = df.withColumn("sec", F.col("t") * 2.0)
    assert abs(np.corrcoef(mat(slow.VartimeSFA(1, "sec").fit_transform(even))[:, 0], s[:, 0])[0, 1]) > 0.999
    two = slow.SFA2(1, order="t", rank_deficit="pca").fit(df)
    z = mat(two.transform(df))[:, 0]
    assert np.allclose(two.quadratic_form(0).value(mat(df)), z, atol=1e-6)


def test_gsfa_regular_is_sfa_and_igsfa_keeps_the_width(spark, mixed):
    _, df = mixed
    a, b = slow.GSFA("regular", order="t").fit(df), slow.SFA(order="t").fit(df)
    assert np.allclose(np.abs(a.sf / np.linalg.norm(a.sf, axis=0)), np.abs(b.sf / np.linalg.norm(b.sf, axis=0)), atol=1e-3)
    for mode, how in (("mirror_window", {"half": 2}), ("truncate_window", {"half": 2}), ("mixed", {"block_size": 40}), ("compact_classes", {"block_size": 50})):
        assert slow.GSFA(mode, 2, "t", **how).fit(df).sf.shape == (3, 2)
    for scaling_ in (None, "data_dependent", "QR_decomposition", "sensitivity_based"):
        node = slow.IGSFA(3, 1, scaling_, True, order="t").fit(df)
        y = node.transform(df)
        assert mat(y).shape[1] == 3
    assert np.allclose(mat(node.inverse_transform(y)), mat(df), atol=1e-6)


@pytest.mark.parametrize("make", [lambda: ica.CuBICA(1e-5), lambda: ica.JADE(1e-5), lambda: ica.FastICA("symm", limit=1e-5, max_it=60), lambda: ica.FastICA("defl", "tanh", fine_g=None, limit=1e-5, max_it=60)])
def test_ica_recovers_uniform_sources(spark, make):
    rng = np.random.default_rng(5)
    s = rng.uniform(-1, 1, (3000, 3))
    df = frame(spark, s @ np.array([[1, 0.5, 0.2], [-0.3, 1, 0.4], [0.2, -0.6, 1]]))
    node = make().fit(df)
    c = np.abs(np.corrcoef(mat(node.transform(df)).T, s.T)[:3, 3:])
    assert np.all(c.max(1) > 0.99) and len(set(c.argmax(1))) == 3


def test_isfa_and_tdsep_separate_by_lags(spark):
    t = np.arange(2000)
    s = np.stack([np.sin(t / 40), np.sin(t / 7 + 1)], 1)
    df = frame(spark, s @ np.array([[1, 0.6], [0.5, -1]]))
    for node in (slow.TDSEP(3, "t"), slow.ISFA(3, order="t")):
        c = np.abs(np.corrcoef(mat(node.fit(df).transform(df)).T, s.T)[:2, 2:])
        assert np.all(c.max(1) > 0.99)


def test_xsfa_first_source_is_slow(spark):
    t = np.linspace(0, 4 * np.pi, 1500)
    s = np.stack([np.sin(t), np.sin(7 * t)], 1)
    df = frame(spark, s @ np.array([[1, 0.3], [0.4, -1]]))
    y = mat(slow.XSFA(2, 1, 2, "t").fit_transform(df))
    assert abs(np.corrcoef(y[:, 0], s[:, 0])[0, 1]) > 0.99 and y.shape[1] == 2


def test_factor_analysis_and_regression(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((2, 5))
    x = rng.standard_normal((3000, 2)) @ a + 0.6 * rng.standard_normal((3000, 5))
    node = decomposition.FactorAnalysis(2, tol=1e-9, max_cycles=300).fit(frame(spark, x))
    assert np.allclose(node.a @ node.a.T, a.T @ a, atol=0.4) and np.allclose(node.sigma, 0.36, atol=0.06)
    beta = rng.standard_normal((5, 3))
    df = frame(spark, x).withColumn("y", F.array(*[sum(F.get("x", F.lit(i)) * float(beta[i, j]) for i in range(5)) + float(j) for j in range(3)]))
    fit = decomposition.LinearRegression().fit(df)
    assert np.allclose(fit.beta[1:], beta) and np.allclose(fit.beta[0], [0, 1, 2])


def test_classifiers_on_two_clouds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((150, 2)) * [3, 0.4], rng.standard_normal((150, 2)) * [3, 0.4] + [0, 3]])
    df = frame(spark, x).withColumn("label", (F.col("t") >= 150).cast("int"))
    true = np.arange(300) >= 150
    said = lambda d: np.array([r[0] for r in d.orderBy("t").select("said").collect()])
    for node in (classifiers.Gaussian(), classifiers.NearestMean()):
        assert (said(node.fit(df).label(df, "said")) == true).mean() > 0.98
    assert (said(classifiers.KNN(3, block=64).fit(df).label_by(df, "t", "said")) == true).mean() > 0.98
    y = mat(decomposition.FDA(1).fit_transform(df))[:, 0]
    assert max(((y > 0) == true).mean(), ((y < 0) == true).mean()) > 0.98
    row = classifiers.Gaussian().fit(df).rank(df).orderBy("t").first()
    assert row["rank"][0] == 0
    signed = df.withColumn("label", F.col("label") * 2 - 1).orderBy(F.xxhash64("t"))
    p = classifiers.Perceptron(order="o").fit(signed.withColumn("o", F.xxhash64("t")))
    assert ((said(p.label(df, "said")) > 0) == true).mean() > 0.75


def test_nearest_neighbours_over_cells_are_exact(spark):
    """Ties on a grid, copies with other labels, a hot vector, queries far from all rows; each vector against its own cell and few others."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 8, (700, 3)), rng.standard_normal((700, 3)) * 4, np.tile([1.5, 2.5, 3.5], (600, 1))]).astype(float)
    label = rng.integers(0, 9, len(x))
    q = np.concatenate([x[::3], rng.standard_normal((40, 3)) * 100])
    df = frame(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "t long, label int"), "t")
    node = classifiers.KNN(5, block=320).fit(df)
    got = {}
    for r in node.neighbours(frame(spark, q), "t").collect():
        got.setdefault(r.t, []).append((r.d2, r.l))
    said = {r.t: r.said for r in node.label_by(frame(spark, q), "t", "said").collect()}
    assert len(got) == len(said) == len(q)
    for i, v in enumerate(q):
        d = x - v
        want = sorted(zip((d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2).tolist(), label.tolist(), strict=True))[:5]
        assert sorted(got[i]) == want
        votes = [w for _, w in want]
        assert said[i] == min(votes, key=lambda w: (-votes.count(w), w))
    cells, _ = node._tree()
    near = np.array([sorted(((x - v) ** 2).sum(1))[4] for v in x[700:1400]])
    assert cells.cells > 20 and len(cells.walk(x[700:1400], near)[0]) < 700 * cells.cells / 3


def test_nearest_neighbours_of_wide_vectors_are_exact(spark):
    """All pairs by matrix products: ties, copies with other labels, vectors far from zero and close together, huge ones and NaN."""
    rng = np.random.default_rng(7)
    x = np.concatenate([
        rng.integers(0, 2, (900, 24)), rng.standard_normal((900, 24)).astype(np.float32), 1e7 + rng.standard_normal((300, 24)) * 1e-3,
        np.tile(np.arange(24.0), (400, 1)), np.full((3, 24), 1e200), np.full((4, 24), np.nan),
    ]).astype(float)
    label = [f"l{v}" for v in rng.integers(0, 9, len(x))]
    q = np.concatenate([x[::3], x[-7:], rng.standard_normal((2500, 24)) * 3])
    df = frame(spark, x).join(spark.createDataFrame(list(enumerate(label)), "t long, label string"), "t")
    node = classifiers.KNN(5).fit(df)
    got = {}
    for r in node.neighbours(frame(spark, q), "t").collect():
        got.setdefault(r.t, []).append((r.d2, r.l))
    said = {r.t: r.said for r in node.label_by(frame(spark, q), "t", "said").collect()}
    assert len(got) == len(said) == len(q)
    ordered = lambda rows: sorted(rows, key=lambda w: (np.isnan(w[0]), np.nan_to_num(w[0], nan=0.0, posinf=np.inf), w[1]))
    with np.errstate(all="ignore"):
        for i in [*range(0, 900, 5), *range(900, len(q), 100), *range(len(x[::3]), len(x[::3]) + 7)]:
            d = sum((x[:, j] - q[i, j]) ** 2 for j in range(24))
            want = ordered(zip(d.tolist(), label, strict=True))[:5]
            assert repr(ordered(got[i])) == repr(want)
            votes = [w for _, w in want]
            assert said[i] == min(votes, key=lambda w: (-votes.count(w), w))


def test_nearest_neighbours_block_by_block(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 3, (300, 12)).astype(float), rng.integers(0, 3, (2000, 12)).astype(float)
    sizes, labels = rng.integers(1, 4, 2000), rng.integers(0, 50, 6000)
    search, done = classifiers._Search(a, 7), 0
    search.PAIRS = 1 << 12
    for i, j in ((0, 3), (3, 700), (700, 701), (701, 2000)):
        n = sizes[i:j].sum()
        search.add(b[i:j], sizes[i:j], labels[done : done + n])
        done += n
    rows = np.repeat(b, sizes, 0)
    for i, v in enumerate(a):
        want = sorted(zip(((rows - v) ** 2).sum(1).tolist(), labels[:done].tolist(), strict=True))[:7]
        assert list(zip(search.d2[search.i == i].tolist(), search.l[search.i == i].tolist(), strict=True)) == want


def test_knn_query_takes_all_numbers_of_a_vector(spark, tmp_path):
    """The labels show in the last numbers only."""
    from flowgrain.plans import catalog

    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        v = np.zeros(64)
        v[3:] = rng.standard_normal(61) * 0.01
        v[39 + i % 4 * 8] += 1.0
        rows.append((i, v.tolist(), i % 4))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.queries()["knn"](spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.label) for r in found) == [(i, i % 4) for i in range(120)]


def test_time_operators_exact(spark):
    df = frame(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12], [13, 14, 15]])
    y = mat(timeops.TimeDelay(3, 2).transform(df))
    assert y[0].tolist() == [1, 2, 3, 0, 0, 0, 0, 0, 0] and y[4].tolist() == [13, 14, 15, 7, 8, 9, 1, 2, 3]
    frames = timeops.TimeFrames(3, 1)
    assert mat(frames.transform(df)).shape == (3, 9) and np.allclose(mat(frames.pseudo_inverse(frames.transform(df))), mat(df))
    long = frame(spark, np.arange(400.0)[:, None] ** 2)
    d = timeops.time_difference(long.repartition(5), "t")
    assert np.allclose(mat(d)[:, 0], np.diff(np.arange(400.0) ** 2))
    with pytest.raises(TrainingError):
        timeops.time_difference(long, "")


def test_hit_parade_with_a_gap(spark):
    x = np.zeros(300)
    x[[10, 12, 100, 200]] = [9, 10, 8, 7]
    node = scaling.HitParade(3, 5).fit(frame(spark, x[:, None]))
    assert node.maxima[0] == [(10.0, 12), (8.0, 100), (7.0, 200)]


@pytest.mark.parametrize("bins", [7, 50, 4096])
def test_hit_parade_with_a_gap_is_the_fold_of_all_rows(spark, monkeypatch, bins):
    monkeypatch.setattr(scaling.HitParade, "BINS", bins)
    rng = np.random.default_rng(bins)
    x = np.stack([rng.standard_normal(3000), rng.integers(0, 12, 3000), np.arange(3000.0), np.cumsum(rng.standard_normal(3000))], 1)
    df = frame(spark, x)
    df = df.select((F.col("t") * 3 - 2000).alias("t"), "x").unionByName(spark.createDataFrame([(0, [None, float("nan"), None, None]), (None, [9e9] * 4)], "t long, x array<double>"))
    for n, gap in ((1, 2), (4, 7), (5, 40)):
        node = scaling.HitParade(n, gap).fit(df.repartition(3))
        for v in range(4):
            values = list(zip((np.arange(3000) * 3 - 2000).tolist(), x[:, v].tolist(), strict=True))
            assert node.maxima[v] == scaling._gapped(values, n, gap, 1.0) and node.minima[v] == scaling._gapped(values, n, gap, -1.0)
    long = df.select("t", F.posexplode("x").alias("v", "x")).where("t is not null and v = 0 and x is not null")
    if bins == 50:
        assert scaling.HitParade(2, 7)._may_change(long).count() < 1500


def test_order_statistics_and_cutoff(spark):
    x = np.array([[4.0, 1], [2, 2], [3, 3], [1, 4], [6, 5], [5, 6]])
    node = scaling.AdaptiveCutoff(1 / 3, 0.2).fit(frame(spark, x))
    assert node.lower.tolist() == [3, 3] and node.upper.tolist() == [5, 5]


def test_pseudo_inverse_of_an_expansion(spark):
    x = np.random.default_rng(0).uniform(0.2, 1, (20, 2))
    fs = [lambda m: m, lambda m: m**2]
    df = frame(spark, np.concatenate([x, x**2], 1))
    assert np.allclose(mat(expansions.pseudo_inverse(df, fs, 2), "inverse"), x, atol=1e-4)


def test_convolution_modes(spark):
    rng = np.random.default_rng(2)
    img, f = rng.standard_normal((3, 5, 6)), rng.standard_normal((2, 3, 2))
    for mode in ("valid", "same", "full"):
        a = routing.Convolution2D(f, (5, 6), "fft", mode)
        b = routing.Convolution2D(f, (5, 6), "linear", mode)
        assert np.allclose(a.convolve(img), b.convolve(img)) and a.convolve(img).shape[2:] == a.output_shape
    y = mat(routing.Convolution2D(f, (5, 6), mode="valid").transform(frame(spark, img.reshape(3, -1))))
    assert np.allclose(y, routing.Convolution2D(f, (5, 6), mode="valid").convolve(img).reshape(3, -1))
    for boundary in ("wrap", "symm"):
        assert routing.Convolution2D(f, (5, 6), "linear", "same", boundary).convolve(img).shape == (3, 2, 5, 6)


def test_switchboards():
    r = routing.Rectangular2dSwitchboard((4, 4), (2, 2), (2, 2))
    assert r.field(3) == [10, 11, 14, 15] and r.out_channels_xy == (2, 2)
    with pytest.raises(ValueError):
        routing.Rectangular2dSwitchboard((5, 4), (2, 2), (2, 2))
    d = routing.DoubleRect2dSwitchboard((4, 4), (2, 2))
    assert d.output_channels == 5 and d.field(2) == [5, 6, 9, 10]
    rhomb = routing.DoubleRhomb2dSwitchboard((4, 4), 2)
    assert all(len(set(f)) == 4 for f in rhomb.fields)
    t = routing.CoordinateTranslator(4, 3)
    assert t.index_to_image(6) == (2, 1) and t.image_to_index(2, 1) == 6


def test_embeddings_and_gases(spark):
    t = np.sort(np.random.default_rng(4).uniform(0, 3, 150))
    df = frame(spark, np.stack([np.cos(t), np.sin(t), 0.3 * t], 1))
    for node in (manifold.LLE(8, 1), manifold.HLLE(8, 1)):
        y = mat(node.fit(df).transform(df))[:, 0]
        assert abs(np.corrcoef(y, t)[0, 1]) > 0.95
    with pytest.raises(TrainingError):
        manifold.LLE(3, 1, most_rows=10).fit(df)
    gas = neural.NeuralGas(6, epochs=5).fit(df)
    assert gas.nodes.shape == (6, 3) and gas.nearest(df).agg(F.max("distance")).first()[0] < 1.5
    grown = neural.GrowingNeuralGas(max_nodes=8, every=20).fit(df)
    assert 3 <= len(grown.nodes) <= 8


def test_rbm_and_hopfield(spark):
    rng = np.random.default_rng(6)
    base = np.array([[1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1]])
    df = frame(spark, base[rng.integers(0, 2, 200)])
    m = neural.RBM(2, epochs=60, rate=0.5, seed=1).fit(df)
    p = 1 / (1 + np.exp(-(1 / (1 + np.exp(-(base @ m.w + m.bh))) @ m.w.T + m.bv)))
    assert np.abs(p - base).mean() < 0.35
    labelled = neural.RBMWithLabels(2, 2, epochs=2).fit(df)
    assert mat(labelled.transform(df)).shape == (200, 2)
    h = classifiers.Hopfield().fit(frame(spark, np.array([[1, 1, 1, 1, 0, 0, 0, 0]])))
    out = h.label(frame(spark, np.array([[1, 1, 1, 0, 0, 0, 0, 0]]))).first()["label"]
    assert out == [True] * 4 + [False] * 4 and h.memory_size == 8


def test_online_operators(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 3)) * [3, 1.5, 0.5]
    df = frame(spark, x)
    d, u = online.CCIPCA(3).fit(df).components()
    assert np.allclose(np.abs(np.diag(u)), 1, atol=0.05) and abs(d[0] - 9) < 2
    v = online.MCA(1, eps=0.02).fit(df).state_["v"][0]
    assert abs(v[2]) > 0.98
    c = online.OnlineCentering().fit(df)
    assert np.allclose(c.state_["avg"], x.mean(0))
    assert mat(online.IncSFA(1).fit(df).transform(df)).shape == (3000, 1)
    chain = online.CircularOnlineFlow([online.OnlineCentering()], 2).fit(df.limit(5))
    assert chain.state_["0"]["n"] == 10
    layer = online.OnlineLayer([online.OnlineCentering(), online.OnlineTimeDiff()], [2, 1])
    assert mat(layer.fit(df).transform(df)).shape == (3000, 3)


def test_online_on_streams(spark, tmp_path):
    schema = "k int, t bigint, x array<double>"
    for i in range(2):
        spark.createDataFrame([(j % 2, 2 * i + j, [float(2 * i + j)]) for j in range(2)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = tables.stream(spark, str(tmp_path / "in/*"), schema)
    node = online.OnlineCentering()
    q = node.on_stream(source, str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert np.allclose(node.state_["avg"], [1.5])
    out = online.OnlineTimeDiff().per_key(source, "k").writeStream.format("memory").queryName("diffs").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    out.processAllAvailable()
    out.stop()
    assert {(r.t, r.x[0]) for r in spark.table("diffs").collect()} == {(0, 0.0), (1, 1.0), (2, 2.0), (3, 2.0)}


def test_flows(spark, mixed, tmp_path):
    x, df = mixed
    flow = scaling.Normalize() + decomposition.PCA(2) + slow.SFA(order="t")
    assert len(flow) == 3
    y = mat(flow.fit(df, checkpoint_to(str(tmp_path / "n"))).transform(df))
    save_flow(flow, str(tmp_path / "flow.json"))
    assert np.allclose(mat(load_flow(str(tmp_path / "flow.json")).transform(df)), y)
    assert json.loads((tmp_path / "n1.json").read_text())["class"] == "PCA"
    assert isinstance(Node.load(str(tmp_path / "n0.json")), scaling.Normalize)
    back = Flow([scaling.Normalize(), decomposition.PCA()]).fit(df)
    assert np.allclose(mat(back.inverse_transform(back.transform(df))), x)
    with pytest.raises(FlowError):
        Flow([scaling.Normalize()]).fit([None])
    assert "PCA" in flow.describe()


def test_messages_extensions_and_cache(mixed):
    _, df = mixed
    seen = []
    stop = MessageNode(node_id="end", run=lambda d, m: (seen.append(sorted(m)) or d, {"n": 1}))
    again = MessageNode(node_id="loop", run=lambda d, m: (d, {"i": m.get("i", 0) + 1}, "loop" if m.get("i", 0) < 2 else "end"))
    out, message = MessageFlow([Sender("end"), again, stop]).execute(df)
    assert message["i"] == 3 and seen == [["i", "x"]] and message["n"] == 1
    ext = Extensions()
    ext.method("shout", scaling.Normalize, "shout")(lambda self: "hey")
    with ext.use("shout"):
        assert scaling.Normalize().shout() == "hey"
    assert not hasattr(scaling.Normalize, "shout")
    policy, node = CachePolicy(), scaling.Identity()
    with policy.cached():
        assert policy.transform(node, df) is policy.transform(node, df)


def test_graphs(spark):
    g = graph.Graph()
    a, b, c, d = (g.add_node(i) for i in "abcd")
    for h, t in ((a, b), (a, c), (c, b)):
        g.add_edge(h, t)
    assert [n.data for n in g.topological_sort()] == ["a", "d", "c", "b"]
    assert [n.data for n in g.dfs(a)] == ["a", "c", "b"] and [n.data for n in g.bfs(a)] == ["a", "b", "c"]
    assert len(g.connected_components()) == 2 and not g.is_weakly_connected()
    g.add_edge(b, a)
    with pytest.raises(graph.GraphError):
        g.topological_sort()
    g.remove_node(b)
    assert len(g.edges) == 1


def test_linear_algebra():
    rng = np.random.default_rng(0)
    a, b = linalg.random_symmetric(4, 1), np.diag([1.0, 2, 3, 4])
    d, v = linalg.gen_eigh(a, b)
    assert np.allclose(v.T @ b @ v, np.eye(4)) and np.allclose(a @ v, b @ v * d)
    low = rng.standard_normal((4, 2))
    for how in ("pca", "svd", "reg"):
        d, v = linalg.gen_eigh(a, low @ low.T, how)
        assert v.shape == (4, 2) and np.allclose(v.T @ low @ low.T @ v, np.eye(2), atol=1e-4)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.gen_eigh(a, low @ low.T)
    q = linalg.random_rotation(5, 2)
    assert np.allclose(q @ q.T, np.eye(5)) and np.isclose(np.linalg.det(q), 1)
    form = linalg.QuadraticForm(np.array([[2.0, 0.3], [0.3, -1]]), np.array([0.5, 0.2]))
    top, bottom = form.extrema(2.0)
    angle = np.linspace(0, 2 * np.pi, 20001)
    values = form.value(2 * np.stack([np.cos(angle), np.sin(angle)], 1))
    assert np.isclose(form.value(top)[0], values.max(), atol=1e-5) and np.isclose(form.value(bottom)[0], values.min(), atol=1e-5)
    assert np.isclose(np.linalg.norm(top), 2) and form.invariances(top)[0].shape == (2, 1)
    assert linalg.covariance_maxima(np.array([[1, 5.0], [2, 3]])) == [5.0, 2.0]
    assert linalg.gabor((5, 5), 0, 0, 0.1, (1, 1)).shape == (5, 5)
    assert expansions.expanded_size(3, 4) == 34 and expansions.monomials_of_degree(2, 3) == 6


def test_column_helpers(spark):
    df = spark.range(2000).withColumn("k", local.weighted_choice({"a": 3, "b": 1}, 5))
    n = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert set(n) == {"a", "b"} and 1350 < n["a"] < 1650
    assert len(list(local.orthogonal_permutations({"a": [1, 2], "b": [3]}))) == 2
    assert list(local.zip_stretched([1, 2], 5)) == [(1, 5), (2, 5)]
    assert local.recursive_map(lambda v: v + 1, [1, [2, 3]]) == [2, [3, 4]] and local.recursive_reduce(lambda a, b: a + b, [1, [2, 3]]) == 6
    jac = routing.gradient([expansions.QuadraticExpansion(2)], np.array([2.0, 3.0]))
    assert np.allclose(jac, [[1, 0], [0, 1], [4, 0], [3, 2], [0, 6]], atol=1e-6)


def test_lagged_stack_and_shortcuts(mixed):
    x, df = mixed
    c = timeops.LaggedCovariances.of(df, [0, 2], "t")
    y = x - x[:-2].mean(0)
    assert np.allclose(c.covs[0], np.cov(x.T)) and np.allclose(c.covs[1], (x[:-2] - x[:-2].mean(0)).T @ (x[2:] - x[2:].mean(0)) / (len(y) - 3))
    s = c.symmetrize().weight([1, 0.5])
    assert np.allclose(s.covs, s.covs.transpose(0, 2, 1)) and np.allclose(s.rotate(0.3, (0, 2)).rotate(-0.3, (0, 2)).covs, s.covs)
    assert np.allclose(s.permute((0, 1)).permute((0, 1)).covs, s.covs)
    assert np.allclose(mat(local.pca(df)), mat(decomposition.PCA().fit_transform(df)))
    assert slow.GSFA([("dual_serial", {"block_size": 40}), ("ignore_data", {})], 2, "t").fit(df).sf.shape == (3, 2)


def test_sources_round_trip(spark, mixed, tmp_path):
    x, df = mixed
    for kind in ("parquet", "orc", "json"):
        tables.write(df, str(tmp_path / kind), kind)
        assert np.allclose(mat(tables.read(spark, str(tmp_path / kind), kind=kind, schema=df.schema)), x)
    tables.write(df, str(tmp_path / "csv"), "csv")
    back = tables.read(spark, str(tmp_path / "csv"), ["x0", "x1", "x2"], "csv", keep=["t"]).withColumn("t", F.col("t").cast("bigint"))
    assert np.allclose(mat(back), x)


def test_queries_embed_and_learn_all_rows(spark, monkeypatch):
    from flowgrain.plans import catalog

    d = "/root/testdata/sf0.001"
    ids = sorted(r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id").collect())
    assert len(ids) > 400
    for name in ("lle", "hlle"):
        assert sorted(r.vec_id for r in catalog.queries()[name](spark, d).collect()) == ids
    few = manifold.LLE(8, 2, most_rows=100)
    assert catalog._embedded(few, catalog.vectors(spark, d, 4)).count() == len(ids) and len(few.train) == 100
    learnt = []
    fit = classifiers.Hopfield._fit
    monkeypatch.setattr(classifiers.Hopfield, "_fit", lambda node, df: (fit(node, df), learnt.append(node.patterns))[0])
    catalog.queries()["hopfield_recall"](spark, d)
    assert learnt == [len(ids)]
