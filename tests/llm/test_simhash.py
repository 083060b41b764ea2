import random

import numpy as np
import pyarrow as pa
import xxhash

from flowgrain.llm import components, simhash


def slow_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(prints, ids, most):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_query_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 30, 200]))] for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        for k in range(3):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((100 + 10 * i + k, "\n\t".join(v).upper() if k == 1 else "  ".join(v)))
    rows += [(5000, None), (5001, " \n"), (None, rows[4][1]), (5002, "É é"), (5002, "É é"), (5003, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op3(df).collect()), key=str)
    prints = [slow_print(t) for _, t in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, groups(prints, [d for d, _ in rows], 4), strict=True)), key=str)
    assert got == want
    assert simhash.op3(df.limit(0)).count() == 0


def test_grid_finds_every_link_also_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = []
    for c in centers:
        for _ in range(80):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints], "fp bigint")
    for most, blocks, reach in ((4, 3, 1), (7, 4, 1), (8, 3, 2)):
        edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.fingerprint_links(df, most, blocks, reach).collect()]
        at = {x: i for i, x in enumerate(prints)}
        u, v = np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
        assert all((a ^ b).bit_count() <= 6 * most for a, b in edges)
        roots = components.local_roots(len(prints), u, v)
        assert [prints[r] for r in roots] == [prints[x] for x in groups(prints, range(len(prints)), most)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (-3, -2), (-2, -3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)} | {-2: -3}
    assert got == want


def test_salts_are_independent():
    texts = pa.array([" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(1, 90)])
    f = simhash.fingerprints(texts, 5, 3)
    assert (f[:, 0] == simhash.fingerprints(texts, 5)[:, 0]).all()
    apart = np.bitwise_count(f[:, 0] ^ f[:, 1]).mean()
    assert 28 < apart < 36
