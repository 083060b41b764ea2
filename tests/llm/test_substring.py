import hashlib
import random
import re

import numpy as np

from flowgrain.llm import substring


def brute(rows, width):
    """rows: (doc_id, text), by the contract, windows compared as word tuples."""
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < d:
                    gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    word = lambda: rng.choice(["a", "bb", "ccc", "É", "zz."]) + str(rng.randint(0, 9))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 3, 49, 50, 51, 120, 300]))]
        if i % 3 == 0:
            a = rng.randint(0, 15)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + rng.choice([49, 50, 55])]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (101, rows[4][1]), (3, "x " * 200), (3, rows[7][1]), (5, None), (None, rows[4][1]), (200, "the " * 120), (201, "the " * 60)]
    return rows


def test_sliding_minimum():
    x = np.array([5, 3, 9, 1, 7, 7, 2], np.uint64)
    for w in range(1, 8):
        assert substring.sliding_minimum(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_equals_brute_force_in_any_number_of_batches(spark):
    rows = corpus(random.Random(11))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, rank int, prints string")
    want = brute(rows, 50)
    for batches in (1, 5):
        got = sorted((tuple(r) for r in substring.op6(df, batches).collect()), key=str)
        assert got == want, batches
    assert substring.op6(df.limit(0)).count() == 0


def test_equal_polynomial_hashes_are_no_equal_words(spark):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    plain = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    swapped = plain.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{plain} {rest}"), (2, f"{swapped} {rest} x"), (3, f"{swapped} {rest}"), (4, f"{plain} {rest} y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for batches in (1, 3):
        assert sorted(tuple(r) for r in substring.op6(df, batches).collect()) == brute(rows, 50)


def test_index_is_incremental_and_compacts(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    index = substring.FingerprintIndex(spark, fan=4)
    for k in range(5):
        df = spark.createDataFrame([(10 - k, f"start{k} {passage} end{k}")], "doc_id bigint, text string")
        got = index.add(df, with_text=True).collect()[0]
        assert (got.n_removed, got.kept_text) == ((0, None) if k == 0 else (80, f"start{k} end{k}"))
    assert [r.level for r in index.runs] == [1, 0]
    index.close()


def test_index_opens_again(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(80))
    root = f"file://{tmp_path}/index"
    for k in range(4):
        index = substring.FingerprintIndex.open(spark, root) if k else substring.FingerprintIndex(spark, root=root)
        df = spark.createDataFrame([(10 - k, f"start{k} {passage} end{k}"), (None, passage), (20 + k, None)], "doc_id bigint, text string")
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in index.add(df, with_text=True).collect()}
        assert got == {10 - k: (0, None) if k == 0 else (80, f"start{k} end{k}"), None: (0, None), 20 + k: (0, None)}


def test_merge_join_shuffles_neither_side(spark):
    index = substring.FingerprintIndex(spark, fan=9)
    df = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 90), i -> concat('w', i, '-', id % 7))) AS text")
    index.add(df)
    run = index._run(0, spark.range(5000).selectExpr("id AS print", "1 AS rank", "id AS doc_id"))
    met = run.heads.select("print").join(index.runs[0].heads.select("print", "mask").hint("merge"), "print")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_long_texts_and_very_common_passages(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{passage} own{i}") for i in range(400)] + [(1000, " ".join(f"z{i}" for i in range(60000)) + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in substring.op6(df).collect()}
    assert got == {i: 0 if i == 0 else 60 for i in range(400)} | {1000: 60}


def test_texts_are_cut_and_emptied_ones_go(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, 9), (2, f"own  {passage} tail", 9), (3, passage, 9), (4, None, 0), (5, "short", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.remove_repeats(df).collect()}
    assert got == {1: (passage, 9), 2: ("own tail", 8), 4: (None, 0), 5: ("short", 5)}
