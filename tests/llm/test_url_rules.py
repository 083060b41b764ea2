from itertools import combinations

from pyspark.sql import functions as F

from flowgrain.llm import url_rules
from flowgrain.llm.url_rules import Mining


def brute_fixed(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "nothing", "http://a.com", "http://A.Example.COM/en/x", "https://www.example.com/en/1", "https://m.www.example.com/en/", "http://xcom/", "http://b.net/es/?q#f", "http://b.net/fr", "http://b.net/fr/://c.com/", "ftp://net/es/", "http://example.net#a/b", "x://?y", "https://É.com/Ü"]


def test_fixed_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for r in url_rules.op7(df, labels).collect():
        host, path, rule, verdict = brute_fixed(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_rules.op7(df.limit(0), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    urls = [f"http://{'bad' if i % 3 == 0 else 'fine'}{i % 2}.org/{'spam' if i % 6 == 0 else 'news'}/{i % 5}?{'k' if i % 4 else 'z'}=1" for i in range(240)]
    bad = {i for i in range(240) if i % 6 == 0 or i % 17 == 0}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 0 if i in bad and i % 2 == 0 else 1, int(i in bad and i % 2)) for i in range(0, 240, 2)] + [(999, 0, 0)], "doc_id bigint, quality int, toxic int")
    sets = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    how = Mining(0.05, 0.8)
    train = [(sets[i], i in bad) for i in range(0, 240, 2)]
    rules = set()
    for size in range(1, 8):
        for combo in {c for t, _ in train for c in combinations(sorted(t), size)}:
            n = [b for t, b in train if set(combo) <= t]
            if sum(n) >= 0.05 * len(train) and sum(n) >= 0.8 * len(n):
                rules.add(combo)
    got = {tuple(sorted(r["items"])) for r in url_rules.mine(pages, labels, how).collect()}
    assert got == rules and rules
    verdict = {r.page_id: r.verdict for r in url_rules.op7(pages, labels, (), how).collect()}
    assert verdict == {i: "block" if any(set(r) <= sets[i] for r in rules) else "allow" for i in range(240)}
