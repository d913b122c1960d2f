"""Pages: elements, selectors, extraction, suggestion, hostile markup."""
import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedloom.functions.markup import scan
from feedloom.operators import html, suggest
from feedloom.session import stored

BASE = "https://site.example/list/"
PAGE = """<!doctype html><title>List</title><script>let s = "<div class='row'><a href='/no'>no</a></div>";</script>
<!-- <div class="row"><a href="/ghost">ghost</a></div> -->
<div class="row wide" data-x="1 > 0"><h2><a href="one?a=1&amp;b=2">One &amp; only</a></h2>
  <time datetime="2026-02-03T04:05:06Z">then</time><p class="dek">First&nbsp;<i>summary</i></p></div>
<div class="row"><h2><a href="/two">Two&#8217;s</a></h2><time>4 March 2026</time></div>
<div class="row"><h2>No link</h2></div>
<div class="row"><a href="#top">up</a><a href="javascript:x()">x</a></div>
<div class="row"><div class="row"><a href="//cdn.example/three">Three</a></div></div>"""


def table(spark, *pages):
    return spark.createDataFrame([(i, BASE, p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")


def extract(spark, page, **rule):
    found = html.extract_items(html.html_nodes(table(spark, page)), html.literal_rule(**rule))
    return found.orderBy("pos").collect()


def test_extraction(spark):
    a, b, c = extract(spark, PAGE, item=".row", title="h2", link="h2 a", date="time", summary=".dek")
    assert (a.url, a.title, a.summary) == ("https://site.example/list/one?a=1&b=2", "One & only", "First summary")
    assert a.guid == a.url and a.published_at == dt.datetime(2026, 2, 3, 4, 5, 6)
    assert (b.title, b.published_at, b.summary) == ("Two’s", dt.datetime(2026, 3, 4), None)
    assert (c.url, c.title) == ("https://cdn.example/three", "Three")


def test_defaults_without_selectors(spark):
    assert [(r.title, r.url) for r in extract(spark, PAGE, item="div.row")][:2] == [
        ("One & only", "https://site.example/list/one?a=1&b=2"), ("Two’s", "https://site.example/two")]


def test_headline(spark):
    cases = [
        ('<a href="/v">128</a> <a href="/p">A proper headline</a> <a href="/c">24 comments here, all long</a>', "/p"),
        ('<h3><a href="/p">Go</a></h3><a href="/c">1,024 comments</a><a href="/t">a very long tag link</a>', "/p"),
        ('<a href="/1">1 one</a><a href="/2">22 twenty-two</a>', "/2"),
        ('<a href="/img"><img src="x"></a>', "/img"),
        ('<a href="/a">same</a><a href="/b">size</a>', "/a"),
    ]
    nodes = html.html_nodes(table(spark, *[f'<div class="s">{block}</div>' for block, _ in cases]))
    got = {r.page_id: r.url for r in html.headline_links(nodes, ".s").collect()}
    assert got == {i: "https://site.example" + want for i, (_, want) in enumerate(cases)}


def test_a_limit_counts_containers(spark):
    page = "".join(f'<p class="c"><a href="/{i}">item {i}</a></p>' for i in range(150))
    found = html.extract_items(html.html_nodes(table(spark, page)), html.literal_rule(item=".c"), max_items=100).orderBy("pos").collect()
    assert [r.url for r in found] == [f"https://site.example/{i}" for i in range(100)]
    assert len(extract(spark, page, item=".c")) == 150


@pytest.mark.parametrize("selector,want", [
    ("a", ["x", "y", "z"]), (".m a", ["x", "y"]), ("div.m.n > a", None), ("#q .m a", ["y"]), ("[data-k] a", ["x"]),
    ('[data-k="v w"] a', None), ("a[rel=next]", ["z"]), ("A.l", ["x"]), ("div div a", ["y"]),
])
def test_selectors(spark, selector, want):
    page = table(spark, '<div class="m n" data-k="v w"><a class="l">x</a></div><div id="q"><div class="m"><a>y</a></div></div>'
                        '<a rel="next">z</a>')
    got = html.select_nodes(html.html_nodes(page), selector).orderBy("start").collect()
    assert [r.text for r in got] == (want or [])


def test_rules(spark):
    cases = {'"x"': None, '{"title":"h3"}': None, '{"item":3}': None, "{item:": None, "[]": None, '{"item":""}': None,
             '{"item":"' + "a" * 201 + '"}': None, '{"item":"a > b"}': None, '{"item":"li","title":5}': None,
             '{"item":"li","link":"","date":null,"more":1}': ("li", None), '{"item":".c","link":"h2 a"}': (".c", "h2 a")}
    rows = spark.createDataFrame([(k,) for k in cases], "json string")
    got = {r.json: r.rule and (r.rule["item"], r.rule.link) for r in html.with_rule(rows, "json").collect()}
    assert got == cases


def block(n, title):
    return "".join(f'<li class="s"><a href="/v/{i}">{i}</a><span class="t"><a href="/p/{i}">{title} {i}</a></span>'
                   f'<a href="/c/{i}">{i}0 comments on this</a></li>' for i in range(n))


def test_suggestions(spark):
    pages = [
        f"<ol>{block(4, 'Story')}</ol>",
        "<main>" + "".join(f'<article class="post"><h2><a href="/n/{i}">Headline {i}</a></h2><time datetime="2026-08-0{i}">d</time>'
                           '<p class="dek">about it</p></article>' for i in range(1, 4)) + "</main>",
        "<nav>" + "".join(f'<a class="n" href="/{i}">Section {i}</a>' for i in range(9)) + "</nav><div id=x>" + "".join(
            f'<div class="art"><h3><a href="/a/{i}">A headline of the usual length, number {i}</a></h3></div>' for i in range(3))
        + "</div>",
        "<h1>About</h1><p>We are a <a href='/c'>company</a></p>",
        "<div>" * 4100 + "x"]
    nodes = html.html_nodes(table(spark, *pages))
    best = {r.page_id: r for r in suggest.suggest_rules(nodes).filter("rank = 1").collect()}
    assert set(best) == {0, 1, 2}
    assert (best[0].rule["item"], best[0].rule.link, best[0]["sample"][1].url) == (".s", ".t a", "https://site.example/p/1")
    assert best[1].rule.asDict() == {"item": ".post", "title": "h2", "link": "h2 a", "date": "time", "summary": ".dek"}
    assert best[1]["sample"][0].published_at == dt.datetime(2026, 8, 1)
    assert best[2].rule["item"] == ".art"
    reasons = {r.page_id: r.reason for r in suggest.scrape_preview(table(spark, *pages)).collect()}
    assert reasons[0] is None and "nothing on the page" in reasons[3] and "nothing on the page" in reasons[4]


def test_elements_meet_the_blocks_they_lie_in(spark):
    """The sweep against a search of all blocks: nested and adjoining extents on several pages."""
    rng = random.Random(4)
    elements, blocks = [], []
    for page in range(6):
        clock = 0

        def grow(depth):
            nonlocal clock
            start, clock = clock, clock + 1
            while depth < 6 and rng.random() < 0.6:
                grow(depth + 1)
            # Ends may coincide, as an element that closes its parent does.
            clock += rng.random() < 0.5
            elements.append((page, start, max(clock, start + 1)))
            clock = max(clock, start + 1)

        for _ in range(12):
            grow(0)
        blocks += [(p, 1000 + k, (s, e)) for k, (p, s, e) in enumerate(elements) if p == page and rng.random() < (page > 0) * 0.4]
    els = spark.createDataFrame(elements, "page_id int, start int, end int")
    bls = spark.createDataFrame(blocks, "page_id int, rule_id int, model struct<start:int,end:int>")
    got = sorted((r.page_id, r.start, r.rule_id) for r in suggest.within_blocks(els, bls).collect())
    assert got == sorted((p, s, k) for p, s, _ in elements for q, k, m in blocks if p == q and m[0] < s < m[1]) and len(got) > 50


def test_suggestions_on_a_page_of_many_blocks(spark):
    """5,000 lists of three linked headlines, each a candidate of its own, and the lists themselves one more."""
    page = "".join(f'<div id="l{k}">' + "".join(f'<div class="c{k}"><h3><a href="/{k}/{i}">Headline {k} number {i}</a></h3></div>' for i in range(3))
                   + "</div>" for k in range(5_000))
    nodes = stored(html.html_nodes(table(spark, page)))
    rules = suggest.suggested_rules(nodes).filter("rule.title = 'h3' and rule.link = 'h3 a'")
    assert {r.item for r in rules.select("rule.item").collect()} == {f".c{k}" for k in range(5_000)} | {"#l0"}


def test_hostile_pages(spark):
    rows = extract(spark, "<p>open " * 6000 + '<div class="c"><h3><a href="/z">&#x110000; &#4294967296; kept</a></h3></div>',
                   item=".c")
    assert [(r.url, r.title) for r in rows] == [("https://site.example/z", "&#x110000; &#4294967296; kept")]
    big = html.html_nodes(table(spark, "x" * 4_000_001), 4_000_000).collect()
    assert len(big) == 1 and big[0].error


PIECES = ['<div class="c">', "</div>", '<a href="/x">', "</a>", "<h3>", "<p>", "<li>", "<td>", "<script>", "</SCRIPT>", "<!--",
          "-->", "&amp;", "&#0;", "&", "<", ">", '"', "'", "/>", "<br>", '<b data-x="a > b"', "<A HREF=/y>", "\x00", "é", " ", "="]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_any_markup_nests(pieces):
    page = "".join(pieces)
    rows = scan(page)
    for row in rows:
        assert 0 <= row["start"] < row["open_end"] <= len(page) and row["start"] < row["end"] <= len(page)
        if row["parent_id"] >= 0:
            parent = rows[row["parent_id"]]
            assert parent["start"] < row["start"] and row["end"] <= parent["end"]


def test_declared_feeds_in_any_spelling(spark):
    from feedloom.operators.discover import with_feed_link

    rss = "application/rss+xml"
    pages = {1: f'<link rel=alternate type={rss} href=/a.xml>', 2: f"<LINK HREF='/b?x&#38;y&amp;z' TYPE='{rss}' REL='home Alternate'>",
             3: f'<link rel="alternate stylesheet" type="text/css" href="/c"><link rel="alternate" type="{rss}" href="">', 4: f'<link rel="alternatex" type="{rss}" href="/d">',
             5: f'<link title="type=x" rel="alternate" type="{rss}" href="&#x2f;e" href="/no">', 6: "", 7: None}
    table = spark.createDataFrame([(k, "https://h.example/p", v) for k, v in pages.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r.feed_url for r in with_feed_link(table).collect()}
    assert got == {1: "https://h.example/a.xml", 2: "https://h.example/b?x&y&z", 3: None, 4: None, 5: "https://h.example/&#x2f;e", 6: None, 7: None}


def test_python_is_given_and_gives_pages_in_small_batches(spark):
    """Neither a batch of many pages nor a page of many elements is held as Python rows at once."""
    import pyarrow as pa

    from feedloom.functions.markup import scan_batches
    from feedloom.operators.html import html_nodes

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        html_nodes(spark.createDataFrame([(1, "u", "<p>")], "page_id bigint, url string, html string"))
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, before)
    pages = 40
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(pages)), "url": ["u"] * pages, "html": ["<b>x</b>" * 500] * pages,
                                        "error": pa.array([None] * pages, pa.string())})
    out = list(scan_batches(iter([batch])))
    assert max(b.num_rows for b in out) <= 2000
    rows = [r["page_id"] for b in out for r in b.to_pylist()]
    assert rows == [p for p in range(pages) for _ in range(500)]
