import random
import re

import numpy as np

from flowgrain.llm import decontam


def word_list(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def semi_global(a, b):
    """The least edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(rows, items, rate=0.2):
    out = {}
    for d, t in rows:
        for i, u in items:
            a, b = word_list(u), word_list(t)
            if a and (x := semi_global(a, b)) <= int(rate * len(a) + 1e-9):
                out[d, i] = x
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        what = rng.choice("sdi")
        if what == "d":
            del words[at]
        else:
            words[at : at + (what == "s")] = [f"new{rng.randint(0, 999)}"]
    return words


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "a", *[f"w{i}" for i in range(60)]]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([4, 5, 6, 12, 20, 40])))) for i in range(30)] + [(90, None), (91, "..."), (92, "the"), (93, "Émile, dit: non!")]
    rows = []
    for d in range(200):
        body = text(rng.randint(0, 120))
        if d % 2:
            own = rng.choice(items[:30])[1].split()
            at = rng.randint(0, len(body))
            body[at:at] = edited(rng, own, rng.randint(0, len(own) // 5))
        rows.append((d, rng.choice([" ", "\n", ", "]).join(body).replace("the", rng.choice(["the", "The"]))))
    rows += [(300, None), (301, "x " * 20_000 + items[3][1].upper()), (302, "avant. émile (dit)\tnon après Émile dit non")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.op1(df, bench).collect()}
    want = brute(rows, items)
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and all(k in got for k, x in want.items() if x == 0)
    assert decontam.op1(df.limit(0), bench).count() == 0 and decontam.op1(df, bench.limit(0)).count() == 0
    kept = {r.doc_id for r in decontam.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_walk_keeps_equal_texts_equal_and_edits_near():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 60, (1, 40)).astype(np.uint64)
    b = np.delete(a, 7, 1)
    b = np.concatenate([b, rng.integers(1, 1 << 60, (1, 1)).astype(np.uint64)], 1)
    near = np.mean([(decontam.walk(a, 80, s) != decontam.walk(b, 80, s)).mean() for s in range(30)])
    assert (decontam.walk(a, 80, 3) == decontam.walk(a.copy(), 80, 3)).all() and near < 0.6


def test_finds_every_copy_at_the_edit_limit(spark):
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, rows = [], []
    for i, n in enumerate([15, 38, 40, 59, 60] * 3):
        words, k = new(n), n // 5
        items.append((i, " ".join(words)))
        for what in range(12):
            copy = list(words)
            for at in sorted(rng.sample(range(1, n - 1), k), reverse=True):
                kind = "dis"[what % 3]
                copy[at : at + (kind != "i")] = [] if kind == "d" else new(1)
            rows.append((100 * i + what, " ".join(new(rng.randint(0, 40)) + copy + new(70))))
    got = {(r.doc_id, r.item_id) for r in decontam.op1(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(d, d // 100) for d, _ in rows}


def test_distances_of_many_windows():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, 12).astype(np.uint64)
    rows = rng.integers(0, 5, (200, 15)).astype(np.uint64)
    rows[:100, :12] = np.where(rng.random((100, 12)) < 0.8, a, rows[:100, :12])
    lengths = rng.integers(1, 16, 200)
    many = decontam.edit_distances(a, rows, lengths, 4)
    assert [tuple(x) for x in zip(*many, strict=True)] == [decontam.edit_distance(a, r[:n], 4) for r, n in zip(rows, lengths, strict=True)]
