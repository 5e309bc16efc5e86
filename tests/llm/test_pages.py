"""Page extraction: common lines, declared articles, pages that only differencing can read."""

import html
import random
import re
import time

import pytest

from neoquarry.llm import pages, queries

SCHEMA = "page_id long, url string, html string"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(2)
    for limit in (1 << 28, 4):
        for _ in range(1500):
            a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 15))] for _ in "ab")
            out = set()
            if limit == 4:
                halved(a, b, out)
            else:
                out = pages.common_lines(a, b)
            rest = iter(b)
            assert len(out) == longest(a, b) and all(a[i] in rest for i in sorted(out))


def halved(a, b, out):
    """The way of long pages: cut in halves until one line is left."""
    places = list(range(len(a)))

    def go(a, b, places):
        if not a or not b:
            return
        if len(a) == 1:
            pages._align(a, b, places, out)
            return
        mid = len(a) // 2
        front, back = pages._zeros(pages._last(a[:mid], b), len(b)), pages._zeros(pages._last(a[mid:][::-1], b[::-1]), len(b))
        cut = max(range(len(b) + 1), key=lambda j: front[j] + back[len(b) - j])
        go(a[:mid], b[:cut], places[:mid])
        go(a[mid:], b[cut:], places[mid:])

    go(a, b, places)


def test_query_on_declared_articles(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op9_html(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"(?s)<article>(.*)</article>", r.html).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def page(*middle):
    return "<html><body><div>Our site</div><p>Read us daily.</p>" + "".join(f"<p>{m}</p>" for m in middle) + "<p>All rights.</p></body></html>"


def test_shared_lines_go_where_no_article_is_declared(spark):
    rows = [(i, f"http://h.example/a/{i}", page(f"Story {i} begins", "then it ends &amp; all is well", f"by {i}")) for i in range(1, 6)]
    rows = [(i, u, h.replace("then it ends", f"then {i} ends")) for i, u, h in rows]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i} begins\n\nthen {i} ends & all is well\n\nby {i}" for i in range(1, 6)}


@pytest.mark.parametrize("parts", [1, 7])
def test_one_host_over_many_parts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, f"http://h.example/{i:04d}", page(f"Text number {i}")) for i in range(200)]
        got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {i: f"Text number {i}" for i in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_of_equal_pages(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # a run that opens a host, one in the middle, one that closes it, and a host of one run
        texts = ["Gone"] * 40 + ["Story A"] + ["Busy"] * 60 + ["Story B", "Story C"] + ["Late"] * 40
        rows = [(i, f"http://h.example/{i:04d}", page(t)) for i, t in enumerate(texts)]
        rows += [(1000 + i, f"http://z.example/{i:04d}", page("Alone")) for i in range(20)]
        got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
        whole = "Our site\n\nRead us daily.\n\nAlone\n\nAll rights."
        assert got == {**dict(enumerate(texts)), **{1000 + i: whole for i in range(20)}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_is_not_the_article():
    text = """<!DOCTYPE html><html><head><title>T</title></head><body class="page"><header>Top</header><nav>Menu</nav>
    <div id="cookie-notice">We use cookies</div><main><article><header><h1>Head &#8211; line</h1></header><p>One<br>two <b>three</p>
    <div class="ad-slot"><p>Buy</p></div><script>x("</p>")</script><p>Four&nbsp;five</p><aside>Side</aside><form>Send <input></form>
    <section id="comments"><p>First!</p></section><ul><li>a<li>b</ul><table><tr><td>c</td></tr></table></article></main>
    <!-- <p>not shown</p> --><footer>Foot</footer><p>1 < 2"""
    blocks = pages.blocks_of(text)
    assert pages.main_text(blocks, None) == "Head – line\n\nOne two three\n\nFour five\n\na\n\nb\n\nc"


@pytest.mark.parametrize("around", [
    '<body class="single no-sidebar"><article>{}</article></body>',
    '<body class="sidebar"><article>{}</article></body>',
    '<div class="content-with-sidebar"><article>{}</article></div>',
    '<article class="post social">{}</article>',
    '<main class="widget" id="header-and-content">{}</main>',
    '<div class="widget"><div id="promo"><span class="ad"><main><div class="social"><article>{}</article></div></main></span></div></div>',
])
def test_marks_do_not_hide_a_declared_article(around):
    inner = '<p>One</p><div class="share-bar"><p>Share</p></div><section id="comments"><article class="comment"><p>First!</p></article></section><p>Two</p>'
    blocks = pages.blocks_of("<div class='site-header'><p>Top</p></div>" + around.format(inner) + "<div class='ad'><p>Buy</p></div>")
    assert pages.main_text(blocks, None) == "One\n\nTwo"


def test_links_and_formulas_are_text():
    text = '<p><a href="x">All of it linked</a></p><p>So <math><mi>x</mi></math> is <svg><text>y</text></svg>, <button>press</button> <canvas>it</canvas></p>'
    assert pages.main_text(pages.blocks_of(text), None) == "All of it linked\n\nSo x is y, press it"
    assert pages.main_text(pages.blocks_of(f"<article>{text}</article>"), None) == "All of it linked\n\nSo x is y, press it"


def test_nulls_repeats_long_pages_extra_columns_and_nothing(spark):
    long = "<p>" + "word " * 50_000 + "</p>" + "<div>" * 3000 + "<p>end"
    rows = [(1, None, None), (1, None, None), (None, "http://x/", ""), (2, "no url", "plain text"), (3, "http://x/b", long), (4, "http://x/c", "<p>a</p")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as partner", "3 as text")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in pages.extracted(df).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "plain text", 10), (3, "word " * 49_999 + "word\n\nend", 250_004), (4, "a", 1)]
    assert pages.extracted(df.limit(0)).collect() == []


def test_time_grows_with_broken_markup():
    """Tags that never end, quotes that never close, closing tags without an opening one: read once."""
    for piece, tail in (("<a ", ""), ('<a "', ""), ("<a ", '">'), ("<a '\"", ">"), ('<a b="c" ', '">'), ("<!", ""), ("<div>", "</p>"), ("<a<", " x"), ("<!--", "")):
        times = []
        for n in (50_000, 200_000):
            start = time.process_time()
            pages.blocks_of(piece * n + tail * n)
            times.append(time.process_time() - start)
        assert times[1] < 30 and times[1] < 10 * times[0] + 1, (piece, tail, times)


def test_tags_with_quotes():
    texts = lambda page: [b.text for b in pages.blocks_of(page)]
    assert texts('<p title="a > b">one</p><p>two') == ["one", "two"]
    assert texts('<p>x <a href="y>z</p>') == ['x <a href="y>z']
    assert texts("<p>a<!-- <p>b</p> -->c</p> d <!-- never closed <p>e") == ["ac", "d"]
    assert texts("1 < 2 and <b>3</b> > 2") == ["1 < 2 and 3 > 2"]
