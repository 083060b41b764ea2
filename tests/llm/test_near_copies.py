import random

import numpy as np

from flowgrain.llm import near_copies, simhash
from flowgrain.llm.components import lightest_forest, local_roots


def shingles(words, width=5):
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def representatives(rows):
    """The smallest doc_id of each group that pairs of similarity 0.8 connect, by all pairs."""
    sets = [shingles(w) for _, w in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    return {min(d for (d, _), r in zip(rows, root, strict=True) if r == own) for own in root}


def test_forest_is_the_lightest():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        u, v = rng.integers(0, n, 20), rng.integers(0, n, 20)
        apart = u != v
        u, v = u[apart], v[apart]
        w = rng.integers(0, 6, len(u))
        keep = lightest_forest(u, v, w)
        root, total = list(range(n)), []
        for a, b, x in sorted(zip(u.tolist(), v.tolist(), w.tolist(), strict=True), key=lambda e: e[2]):
            if root[a] != root[b]:
                root = [root[a] if r == root[b] else r for r in root]
                total.append(x)
        assert sorted(w[keep].tolist()) == total
        assert len(set(local_roots(n, u[keep], v[keep]).tolist())) == len(set(root))


def test_cells_meet_at_the_similarity():
    """The share of pairs of similarity 0.8 that meet in a cell within the bit limit, for several sizes and kinds of edit."""
    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    import pyarrow as pa

    tables, limit = near_copies.tables_needed(0.8, 0.96), near_copies.bit_limit(0.8)
    for n, kind in ((13, "end"), (40, "end"), (300, "end"), (300, "words")):
        a, b = [], []
        while len(a) < 150:
            x = new(n)
            y = list(x)
            if kind == "end":
                k = (n - 4) // 9
                y[n - k :] = new(k)
            else:
                for at in rng.sample(range(n), 6):
                    y[at] = new(1)[0]
            if jaccard(shingles(x), shingles(y)) >= 0.8:
                a.append(" ".join(x))
                b.append(" ".join(y))
        one, two = (simhash.fingerprints(pa.array(t), 5, near_copies.SALTED, True)[:, : near_copies.SALTED] for t in (a, b))
        met = np.zeros(len(a), bool)
        for (x, _), (y, _) in zip(near_copies.cells(one, tables), near_copies.cells(two, tables), strict=True):
            met |= x == y
        met &= np.bitwise_count(one ^ two).sum(1) <= limit
        assert met.mean() >= 0.9, (n, kind, met.mean())


def test_fingerprints_of_long_chunks_cover_all_shingles():
    """More shingles in a chunk than are hashed at once."""
    import pyarrow as pa

    texts = [" ".join(f"v{i}x{j}" for j in range(4000)) for i in range(20)]
    whole = simhash.fingerprints(pa.array(texts), 5, 2, True)
    for i, t in enumerate(texts):
        assert (simhash.fingerprints(pa.array([t]), 5, 2, True)[0] == whole[i]).all()
    assert 20 < np.bitwise_count(whole[:-1, 0] ^ whole[1:, 0]).mean() < 44


def test_stage_keeps_what_exact_similarity_keeps(spark, monkeypatch):
    from flowgrain.llm import pipeline

    monkeypatch.setattr(near_copies, "UNIT", 5)
    rng = random.Random(3)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(300):
        n = rng.choice([9, 60, 150, 400])
        a = new(n)
        # One run of new words at the end changes as many shingles as it has words.
        b = a[: n - round((n - 4) * rng.uniform(0.02, 0.2))]
        rows += [(10 * i, a), (10 * i + 1, b + new(n - len(b)))]
    hub = new(200)
    rows += [(9000 + i, hub[: 200 - i] + new(i)) for i in range(12)]
    rows += [(9500, new(3) * 100), (9501, [])]
    want = representatives(rows)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    got = {r.doc_id for r in pipeline.simhash_near_dedup(spark, df, "").collect()}
    # No document is dropped for less than 0.8; a pair may be missed.
    assert got >= want and len(got - want) <= 0.03 * len(want)
    assert 80 < len(rows) - len(want) < 280


def test_crowded_cells_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWDED", 64)
    monkeypatch.setattr(near_copies, "COUNTED", 2)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        rows.append((i, w))
    rows.append((1000, [f"z{i}" for i in range(100)]))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    assert {r.doc_id for r in near_copies.keep_one_of_each_group(df).collect()} == {0, 1000}


def test_dense_cells_lose_no_pair(spark, monkeypatch):
    """However soon cells are cut, and in whatever parts they are dealt, the groups are those of cells that are compared whole."""
    rng = random.Random(11)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, hub = [], new(150)
    for i in range(120):
        a, n = new(150), rng.randrange(7, 13)
        rows += [(10 * i, a), (10 * i + 1, a[: 150 - n] + new(n))]
    # A chain: each has a similarity over 0.8 to the next and a lower one to those after it.
    rows += [(5000 + i, hub[12 * i :] + new(12 * i)) for i in range(6)]
    rows += [(8000 + i, [*rows[0][1][:75], f"n{i}", *rows[0][1][76:]]) for i in range(40)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string").persist()
    groups = lambda: sorted((r.doc_id, r.component_id) for r in near_copies.near_copy_groups(df).collect())
    want = groups()
    exact = representatives(rows)
    kept = {d for d, c in want if c == d}
    assert kept >= exact and len(kept - exact) <= 0.03 * len(exact)
    monkeypatch.setattr(near_copies, "DENSE", 0)
    assert groups() == want
    monkeypatch.setattr(near_copies, "CROWDED", 3)
    monkeypatch.setattr(near_copies, "COUNTED", 1)
    assert groups() == want


def test_what_the_first_pass_cuts_off_is_found_by_the_second(spark, monkeypatch):
    rng = random.Random(12)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):
        a = new(150)
        rows += [(10 * i, a), (10 * i + 1, a[:144] + new(6)), (10 * i + 2, new(4) + a[4:])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    whole = near_copies.candidates
    monkeypatch.setattr(near_copies, "candidates", lambda *a: whole(*a).where("u % 3 = 0"))
    kept = {r.doc_id for r in near_copies.near_copy_groups(df).where("doc_id = component_id").collect()}
    assert kept == representatives(rows)


def kin(rng, n):
    """(doc_id, words): n documents of like text of which few pairs have a similarity of 0.8 but most are candidates; every fourth has a near copy."""
    base, rows = [f"v{i}" for i in range(150)], []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([2, 3])):
            w[k] = f"n{i}x{k}"
        rows.append((i, w))
        if i % 4 == 0:
            rows.append((1000 + i, [*w[:40], f"m{i}", *w[41:]]))
    return rows


def kept_by_all_pairs(rows):
    """The smallest doc_id of each group that all pairs connect which meet in a cell within the bit limit and are similar enough."""
    import pyarrow as pa

    prints = simhash.fingerprints(pa.array([" ".join(w) for _, w in rows]), 5, near_copies.SALTED, True)[:, : near_copies.SALTED]
    met = sum(c[:, None] == c[None] for c, _ in near_copies.cells(prints, near_copies.tables_needed(0.8, 0.96))) > 0
    met &= np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= near_copies.bit_limit(0.8)
    sets = [shingles(w) for _, w in rows]
    links = np.array([(i, j) for i, j in np.argwhere(met) if jaccard(sets[i], sets[j]) >= 0.8])
    root, ids = local_roots(len(rows), *links.T), np.array([d for d, _ in rows])
    return {int(ids[root == r].min()) for r in set(root.tolist())}


def test_candidates_without_links_are_not_rows(spark, monkeypatch):
    """A large group of near copies that are less similar than the limit makes rows in proportion to it, not pairs."""
    rows = kin(random.Random(21), 240)
    made, whole = {}, near_copies.materialize

    def counted(df, name):
        out = whole(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    # The first pass finds nothing, so all is left to the second.
    monkeypatch.setattr(near_copies, "candidates", lambda *a, all=near_copies.candidates: all(*a).where("false"))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    kept = {r.doc_id for r in near_copies.near_copy_groups(df).where("doc_id = component_id").collect()}
    assert kept == kept_by_all_pairs(rows)
    assert max(made.values()) < 20 * len(rows), made


def test_parts_of_clumps_lose_no_link(spark, monkeypatch):
    rows = kin(random.Random(22), 60) + [(5000, ["a"]), (5001, [])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string").persist()
    groups = lambda: sorted((r.doc_id, r.component_id) for r in near_copies.near_copy_groups(df).collect())
    want = groups()
    whole = near_copies.candidates
    monkeypatch.setattr(near_copies, "candidates", lambda *a: whole(*a).where("u % 3 = 0"))
    assert groups() == want
    monkeypatch.setattr(near_copies, "PIECE", 1500)
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    assert groups() == want


def test_shingles_in_common_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(near_copies, "BLOCK", 17)
    for n in (1, 3, 60, 300):
        unit, run = np.sort(rng.integers(0, 3, n)), rng.integers(0, 40, n)
        # Some shingles are in most sets, some in few; some sets are empty.
        sets = [set((rng.integers(0, 2000, rng.integers(0, 30)) ** 2 // 1000).tolist()) for _ in range(n)]
        sets = [s | set(range(9000, 9020)) if rng.random() < 0.6 else s for s in sets]
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        h = np.array([x for s in sets for x in sorted(s)], np.int64)
        for low, both in near_copies.shared_shingles(unit, row, h):
            assert all(both[i, j] == (len(sets[low + i] & sets[j]) if unit[low + i] == unit[j] else 0) for i in range(len(both)) for j in range(n) if low + i != j)
        got = [(a, b) for i, j in near_copies.similar(unit, run, row, h, 0.5) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if unit[i] == unit[j] and run[i] != run[j] and jaccard(sets[i], sets[j]) >= 0.5 - 1e-9]
        assert sorted(got) == want


def test_whole_sets_end_with_a_unit():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    unit = np.sort(rng.integers(0, 30, 400))
    lists = [rng.integers(0, 99, rng.integers(0, 9)).tolist() for _ in unit]
    rows = pa.record_batch([pa.array(unit), pa.array(lists, pa.list_(pa.int64()))], ["unit", "h"])
    out = list(near_copies.whole_sets((rows.slice(i, 7) for i in range(0, 400, 7)), 2000))
    assert pa.Table.from_batches(out).to_pylist() == rows.to_pylist() and len(out) > 3
    ends = [set(b.column(0).to_pylist()) for b in out]
    assert sum(map(len, ends)) == len(set().union(*ends))


def test_parts_of_crowded_cells_hold_every_pair_of_groups_once():
    rng = np.random.default_rng(2)
    digest = rng.integers(-(2**62), 2**62, 300)
    cell = rng.integers(0, 3, 300) - 1
    root = np.where(rng.random(300) < 0.5, 7 + cell, digest)
    crowds = near_copies.Crowds([(c, 7 + c, int(((cell == c) & (root == 7 + c)).sum())) for c in (-1, 0)], [(c, int(((cell == c) & (root != 7 + c)).sum())) for c in (-1, 0)], 20)
    at, unit, run = crowds.deal(cell, root, digest)
    order = np.lexsort((run, unit))
    at, unit, run = at[order], unit[order], run[order]
    got = sorted(tuple(sorted((int(at[x]), int(at[y])))) for i, j in near_copies.across(unit, run) for x, y in zip(i, j, strict=True))
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if cell[i] == cell[j] and root[i] != root[j]]
    assert got == want


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (1, text + " x"), (2, "other words here"), (1, text + " x"), (None, text), (9, None), (8, ""), (2, text + " y"), (4, "long " * 30_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, component_id string, key int")
    out = near_copies.keep_one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted([(1, text + " x"), (2, "other words here"), (-1, text), (8, ""), (4, "long " * 30_000)])
    assert near_copies.keep_one_of_each_group(df.limit(0)).count() == 0
