import random
import re

from flowgrain.llm.html_extract import BAD, GOOD, NEAR, SHORT, extract, main_text, second_pass

PROSE = "This is the first paragraph of the article, and it is written in plain words so that the density of stop words is high enough. " * 2


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>Site</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Logo</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld<br>two&nbsp; three &lt;b&gt; <a href="x">link</a> in text.<p>Next
    <!-- <p>hidden</p> --> part</p><form><input><button>Send</button></form><aside>Side</aside>
    <div class="comments"><p>A reader says something here.</p></div></article>
    <div class="ad">Buy now</div><footer>&copy; me</footer><script>x</body></html>"""
    assert main_text(page) == "Head & line One bold two three <b> link in text. Next part"


def test_pages_without_an_article_use_densities():
    page = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><h2>Heading</h2><div>{PROSE}</div><p>A short line.</p><div>{PROSE}</div><div><a href=3>{PROSE}</a></div><p>tail</p></body>"
    p = " ".join(PROSE.split())
    assert main_text(page) == f"Heading {p} A short line. {p}"


def test_class_names_must_match_whole():
    for name in ("share-price", "legal-history", "search-engine", "form-factor", "copyright-law", "adverse", "commentary"):
        assert main_text(f"<article><div class='{name}'><p>{PROSE}</p></div></article>") == " ".join(PROSE.split()), name
    for name in ("ad", "site-footer", "cookieBanner", "comments", "main-nav", "ad-slot-2", "related-links"):
        assert main_text(f"<article><p>One.</p><div class='{name}'><p>{PROSE}</p></div></article>") == "One.", name


def test_densities_decide_inside_an_article():
    links = "".join(f"<li><a href={i}>Other page number {i}</a></li>" for i in range(5))
    page = f"<article><h1>Title</h1><p>{PROSE}</p><p><a href=0>A source</a></p><p>{PROSE}</p><ul>{links}</ul><p>x7 k9 p4 q2 w8 " + "z1 z2 z3 z4 z5 z6 z7 z8 z9 " * 12 + "</p></article>"
    p = " ".join(PROSE.split())
    got = main_text(page)
    assert got.startswith(f"Title {p} A source {p}") and "Other page" not in got and got.endswith("z9")


def second_view(page):
    """Main text of simple, well-formed pages without an article, by another parser and the rules in one expression each."""
    from html.parser import HTMLParser

    from flowgrain.llm.html_extract import STOP_WORDS

    found, now = [], {"t": "", "l": 0, "a": 0}

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                now["a"] = 1
            else:
                self.close_block()

        def handle_endtag(self, tag):
            if tag == "a":
                now["a"] = 0
            else:
                self.close_block()

        def handle_data(self, data):
            now["t"] += data
            now["l"] += len(data) if now["a"] else 0

        def close_block(self):
            if now["t"].strip():
                found.append((" ".join(now["t"].split()), now["l"]))
            now.update(t="", l=0)

    P().feed(page)
    kind = []
    for t, links in found:
        w = [x.strip(".,;:").lower() for x in t.split()]
        stop = sum(x in STOP_WORDS for x in w) / len(w)
        kind.append("b" if links > 0.33 * len(t) else ("b" if links else "s") if len(t) < 70 else ("g" if len(t) > 200 else "n") if stop >= 0.24 else "n" if stop >= 0.12 else "b")
    out = []
    for i, (t, _) in enumerate(found):
        near = lambda step, i=i: next(((kind[j], abs(j - i)) for j in range(i + step, len(kind) if step > 0 else -1, step) if kind[j] in "gb"), ("b", i + 1 if step < 0 else len(kind) - i))
        (x, dx), (y, dy) = near(-1), near(1)
        final = kind[i] if kind[i] in "gb" else x if x == y else "g" if kind[i] == "n" else x if dx < dy else y
        out += [t] if final == "g" else []
    return " ".join(out)


def test_pages_without_an_article_equal_a_second_view():
    rng = random.Random(4)
    words = "the of and a to in word line other thing place".split()
    rare = "zorb quix vlam trud pelk".split()
    for _ in range(300):
        page = ""
        for _ in range(rng.randint(0, 9)):
            t = " ".join(rng.choice(words if rng.random() < rng.choice([0.2, 0.5, 0.9]) else rare) for _ in range(rng.choice([2, 5, 20, 60])))
            page += f"<p>{t}</p>" if rng.random() < 0.7 else f"<p><a href='x'>{t}</a> {rng.choice(['', t])}</p>"
        assert main_text(f"<body>{page}</body>") == second_view(page)


def test_deep_and_repeated_pages(spark):
    import time

    began = time.process_time()
    main_text("<div>x" * 60_000)
    main_text("<div>x</section>" * 60_000)
    assert time.process_time() - began < 20
    df = spark.createDataFrame([(1, "u", f"<p>{PROSE}</p>")] * 3, "page_id bigint, url string, html string")
    assert [r.n_chars for r in extract(df).collect()] == [len(" ".join(PROSE.split()))] * 3


def test_neighbours_decide():
    assert second_pass([SHORT, GOOD, SHORT, NEAR, BAD, SHORT]) == [GOOD, GOOD, GOOD, GOOD, BAD, BAD]
    assert second_pass([BAD, SHORT, SHORT, SHORT, GOOD]) == [BAD, BAD, GOOD, GOOD, GOOD]
    assert second_pass([SHORT]) == [BAD] and second_pass([]) == []


def test_broken_and_odd_pages(spark):
    pages = [None, "", "plain", "<", "<p", "<p class='a", "<div>" * 5000, "&amp;lt; &#65;&#x42; &bogus;", "<article>" + "é " * 100_000, "<script>never closed", '<p title="a > b">x</p>']
    df = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in enumerate(pages)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(pages) and all(r.text is not None and r.n_chars == len(r.text) for r in got.values())
    assert got[8].n_chars == 199_999
    assert extract(df.limit(0)).count() == 0


def test_articles_of_the_test_pages_come_out_whole(spark):
    rows = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    import html

    for r in rows:
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        want = html.unescape(re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", article))
        assert r.text.split() == re.sub(r"</?(?:b|a|i)\b[^>]*>", "", want).split()
