import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flowgrain.llm import quality
from flowgrain.llm.bytetext import chunks


def stream(*texts):
    (_, _, data, off), = chunks(pa.array(list(texts)))
    units, bound = quality.symbols(data, off)
    return [bytes(units[a:b].tobytes()).decode("utf-16-le") for a, b in zip(bound[:-1], bound[1:], strict=True)]


def test_symbols_are_code_units_with_single_spaces():
    assert stream("", "Ab \n cD1, ", "   ", " \t", "é😀 жук\r\n漢字", "x") == ["", "Ab cD1,", "", "", "é😀 жук 漢字", "x"]
    assert stream("to to\nto be", "be be") == ["to\x1a\x1a be", "be\x1a"]


def brute_keys(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    body = "".join("\x1a" if i and w == words[i - 1] else " " * (i > 0) + w for i, w in enumerate(words))
    units = [32] * 3 + np.frombuffer(body.encode("utf-16-le"), "<u2").tolist() + [32]
    return [tuple(units[i : i + 4]) for i in range(len(units) - 3)] if body else []


def brute_bits(trusted, texts):
    """Mean bits of each text by the textbook recursion over dictionaries."""
    grams = [{}]
    for t in trusted:
        for g in brute_keys(t):
            grams[0][g] = grams[0].get(g, 0) + 1
    while len(grams) < 4:
        low = {}
        for g in grams[-1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        grams.append(low)
    grams.reverse()
    cut = [quality.discounts({i: sum(n == i for n in level.values()) for i in range(1, 5)}) for level in grams]
    rows = []
    for level in grams:
        own = {}
        for g, n in level.items():
            own.setdefault(g[:-1], []).append(n)
        rows.append(own)

    def p(g):
        level = len(g) - 1
        below = p(g[1:]) if level else 1 / 65536
        own = rows[level].get(g[:-1])
        if not own:
            return below
        n, d = grams[level].get(g, 0), cut[level]
        return max(n - d[min(n, 3)], 0) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * below

    return [-sum(math.log2(p(g)) for g in k) / len(k) if (k := brute_keys(t)) else None for t in texts]


def test_query_equals_the_recursion(spark, monkeypatch):
    """Perplexity, threshold and verdict of every row, in two languages and three scripts, over several blocks."""
    rng = random.Random(3)
    letters = ["abcdé ", "жук нё", "漢字 語"]
    rows = [(i, "".join(rng.choice(letters[i % 3]) for _ in range(rng.randint(1, 80))), "xy"[i % 2]) for i in range(130)]
    rows += [(200 + i, "".join(rng.choice("$%&~😀漢z") for _ in range(60)), "xy"[i % 2]) for i in range(6)] + [(300, None, "x"), (301, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 110)] + [(5, 0, 0)], "doc_id bigint, quality int, toxic int")
    rule = quality.Rule(0.9, 1.1, 50)
    got = {r.doc_id: r for r in quality.classify(docs, labels, rule).collect()}
    trusted = [i for i in range(110) if i != 5]
    bits = dict(zip([r[0] for r in rows], brute_bits([rows[i][1] for i in trusted], [t or "" for _, t, _ in rows]), strict=True))
    limits = {}
    for lang in ("x", "y", None):
        steps = sorted(math.ceil(round(bits[i] * 1000, 6)) for i in trusted if bits[i] is not None and lang in (None, rows[i][2]))
        limits[lang] = steps[math.ceil(0.9 * len(steps)) - 1] / 1000 * 1.1
    assert len(got) == len(rows)
    for d, _, lang in rows:
        limit = limits.get(lang if lang else "none", limits[None])
        assert got[d].threshold == pytest.approx(2**limit, rel=2e-3)
        if bits[d] is None:
            assert got[d].perplexity is None and got[d].keep
        else:
            assert got[d].perplexity == pytest.approx(2 ** bits[d], rel=1e-4)
            assert got[d].keep == (bits[d] <= limit) or abs(bits[d] - limit) < 2e-3
    assert not any(got[200 + i].keep for i in range(6))


def test_thresholds_are_quantiles_of_each_language(spark):
    rows = [("a", i / 100) for i in range(1, 101)] + [("b", 9.0)] * 3 + [("c", None)]
    df = spark.createDataFrame(rows, "lang string, bits double")
    got = {r.lang: r.threshold for r in quality.thresholds(df, quality.Rule(0.9, 1.0, 50)).collect()}
    assert got == pytest.approx({"a": 0.9, None: 0.93})


def test_edge_cases(spark):
    rows = [(1, "plain words in a line of text", "en"), (2, None, "en"), (3, "", None), (4, "x" * 50_000, "en"), (None, "plain words", "xx"), (1, "plain words in a line of text", "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert quality.classify(docs, labels).count() == 6
    assert got[1].keep and got[2].keep and got[2].perplexity is None and got[3].perplexity is None and not got[4].keep
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {1, 2, 3, None}
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == 6
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
