"""Feed bodies: formats, identity, broken documents, outcomes."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.operators import outcome, parse

HEAD = '<?xml version="1.0"?><rss version="2.0"><channel><title>Daily</title><link>https://d.example/</link>'
TAIL = "</channel></rss>"


def read(spark, *bodies, kind="application/xml"):
    rows = spark.createDataFrame([(str(i), i, b, kind) for i, b in enumerate(bodies)],
                                 "fetch_id string, feed_id bigint, body string, content_type string")
    parsed = parse.parse_feeds(rows)
    items = parse.items_of(parsed).orderBy("feed_id", "feed_pos").collect()
    return parsed.orderBy("feed_id").collect(), [[r for r in items if r.feed_id == i] for i in range(len(bodies))]


def test_rss_fields(spark):
    _, [items] = read(spark, HEAD + """
      <item><title><![CDATA[ Rain &amp; wind ]]></title><link>https://d.example/1</link><guid isPermaLink="false">a-1</guid>
        <dc:creator>Ada</dc:creator><author>other</author><description>&lt;p&gt;Wet&lt;/p&gt;</description>
        <content:encoded><![CDATA[<p>Very wet</p>]]></content:encoded><pubDate>Tue, 03 Mar 2026 08:05:00 +0100</pubDate></item>
      <item><title>Sun</title><atom:link rel="self" href="https://x"/><atom:link href="https://d.example/2"/>
        <dc:date>2026-03-04T00:00:00Z</dc:date></item>""" + TAIL)
    a, b = items
    assert (a.guid, a.url, a.title, a.author) == ("a-1", "https://d.example/1", "Rain &amp; wind", "Ada")
    assert (a.summary, a.content) == ("<p>Wet</p>", "<p>Very wet</p>")
    assert a.published_at == dt.datetime(2026, 3, 3, 7, 5)
    assert (b.url, b.guid, b.published_at) == ("https://d.example/2", "https://d.example/2", dt.datetime(2026, 3, 4))


def test_two_links_are_no_link(spark):
    _, [[item]] = read(spark, HEAD + "<item><title>T</title><link>https://a</link><link>https://b</link></item>" + TAIL)
    assert item.url is None and item.guid.startswith("h:")


def test_link_to_the_channel_identifies_nothing(spark):
    def body(title, when):
        return HEAD + f"<item><title>{title}</title><link>https://d.example/</link><pubDate>{when}</pubDate></item>" + TAIL

    _, items = read(spark, body("x", "Tue, 03 Mar 2026 08:05:00 GMT"), body("x", "Tue, 03 Mar 2026 21:00:00 GMT"),
                    body("x", "Wed, 04 Mar 2026 08:05:00 GMT"), body("y", "Tue, 03 Mar 2026 08:05:00 GMT"))
    same, later_that_day, next_day, other = (i[0].guid for i in items)
    assert same == later_that_day and len({same, next_day, other}) == 3


def test_atom(spark):
    [feed], [items] = read(spark, """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
      <link rel="self" href="https://a.example/feed"/><link href="https://a.example/"/>
      <entry><id>t:1</id><title>One</title><link rel="enclosure" href="https://m"/><link rel="alternate" href="https://a.example/1"/>
        <author><name>Bo</name></author><updated>2026-01-02T03:04:05Z</updated><published>2026-01-01T00:00:00.5Z</published></entry>
      <entry><id>yt:video:x</id><link href="https://v"/><media:group><media:title>Clip</media:title>
        <media:description>About</media:description></media:group></entry></feed>""")
    assert (feed.format, feed.feed_title, feed.site_url) == ("atom", "A", "https://a.example/")
    one, clip = items
    assert (one.guid, one.url, one.author) == ("t:1", "https://a.example/1", "Bo")
    assert one.published_at == dt.datetime(2026, 1, 1, 0, 0, 0, 500000)
    assert (clip.title, clip.summary, clip.published_at) == ("Clip", "About", None)


def test_rdf(spark):
    [feed], [[item]] = read(spark, """<rdf:RDF xmlns:rdf="x"><channel rdf:about="c"><title>R</title><link>https://r</link></channel>
      <item rdf:about="urn:1"><title>First</title><link>https://r/1</link><dc:date>2026-05-06</dc:date></item></rdf:RDF>""")
    assert (feed.format, feed.site_url) == ("rdf", "https://r")
    assert (item.guid, item.url, item.published_at) == ("urn:1", "https://r/1", dt.datetime(2026, 5, 6))


def test_json_feed(spark):
    [feed, broken], [items, _] = read(spark, """{"title":"J","home_page_url":"https://j","author":{"name":"Jo"},"items":[
      {"id":7,"external_url":"https://e/7","title":"Seven","content_text":"t","date_published":"2026-01-01T00:00:00Z"},
      {"url":"https://j/8","author":{"name":"Al"},"content_html":"<p>h</p>","content_text":"t"},
      {"title":"bare","date_published":"2026-01-01T09:00:00Z"}]}""", '{"items": [', kind="application/json")
    a, b, c = items
    assert (feed.format, broken.format) == ("json", "none")
    assert (a.guid, a.url, a.author, a.content) == ("7", "https://e/7", "Jo", "t")
    assert (b.guid, b.author, b.content, b.title) == ("https://j/8", "Al", "<p>h</p>", "")
    assert c.guid.startswith("h:") and c.url is None


def test_broken_documents_keep_what_can_be_read(spark):
    feeds, items = read(
        spark, HEAD + "<item><title>cut off",
        HEAD + "<item><title>a&nbsp;b &copy; & c</title><p>x<br></item><item><title>two</title></item>" + TAIL,
        "﻿" + HEAD + "<item><title>marked</title></item>" + TAIL, "<rss><![CDATA[ never ends", "no markup at all")
    assert [i.title for i in items[0]] == ["cut off"]
    assert [i.title for i in items[1]] == ["a b © & c", "two"]
    assert [i.title for i in items[2]] == ["marked"]
    assert [f.parse_mode for f in feeds[:3]] == ["mended", "mended", "strict"]
    assert feeds[3].parse_error and not feeds[4].parse_error and items[3] == items[4] == []


@pytest.mark.parametrize("status,network,kind,body,want,error", [
    (200, None, "application/rss+xml", HEAD + TAIL, "ok", None),
    (200, None, "text/html; charset=utf-8", "<!DOCTYPE html><html>Wait a moment</html>", "error",
     "Response was not a feed (HTTP 200, text/html; charset=utf-8)"),
    (200, None, None, "hello", "error", "Response was not a feed (HTTP 200, no content-type)"),
    (304, None, None, None, "not-modified", None),
    (503, None, "text/html", "no", "error", "HTTP 503"),
    (None, "reset", None, None, "error", "Network error: reset"),
    (200, None, "text/html", "﻿ <FEED>", "ok", None),
    (200, None, "text/html", "<feedback>", "error", "Response was not a feed (HTTP 200, text/html)"),
    (200, None, "application/json", " {", "ok", None),
])
def test_outcomes_and_validators(spark, status, network, kind, body, want, error):
    row = spark.createDataFrame([(status, network, kind, body, "new", "Mon", "old", "Sun")],
                                "status int, network_error string, content_type string, body string, etag string, "
                                "last_modified string, sent_etag string, sent_last_modified string")
    got = outcome.classify_feed(row).first()
    kept = {"ok": ("new", "Mon"), "not-modified": ("old", "Sun"), "error": (None, None)}[want]
    assert (got.status, got.error, (got.etag, got.last_modified)) == (want, error, kept)


def test_parse_error_is_an_error(spark):
    row = spark.createDataFrame([(200, None, "text/xml", "<rss><!--", "e", None)],
                                "status int, network_error string, content_type string, body string, etag string, last_modified string")
    got = outcome.classify_feed(parse.parse_feeds(row.withColumn("raw", F.col("body"))).withColumnRenamed("raw", "body"),
                                F.col("parse_error")).first()
    assert got.status == "error" and got.error.startswith("Parse error") and got.etag is None


def test_scrape_outcomes(spark):
    cases = [  # status, type, announced, body, items, selector, error part
        (200, "text/html", 10, "<html>", 3, ".c", None),
        (200, "text/html", 9_000_000, "<html>", 3, ".c", "page announces 9MB, over the 4MB scrape limit"),
        (200, "application/json", 10, "{}", 3, ".c", "was not an HTML page (HTTP 200, application/json)"),
        (200, "", 10, "  <!DocType html>", 3, ".c", None),
        (200, "text/html", 10, "<html>", 0, ".c", "matched nothing on that page (item selector: .c)"),
        (200, "text/html", 10, "<html>", 0, None, "carries no usable rule"),
        (404, "text/html", 10, "x", 0, ".c", "HTTP 404")]
    rows = spark.createDataFrame([(i, c[0], None, c[1], c[2], c[3], "e", None, c[4], c[5]) for i, c in enumerate(cases)],
                                 "i int, status int, network_error string, content_type string, content_length bigint, "
                                 "body string, etag string, last_modified string, n int, sel string")
    got = {r.i: r for r in outcome.classify_scrape(rows, F.col("n"), F.col("sel"), max_bytes=4_000_000).collect()}
    for i, case in enumerate(cases):
        assert (got[i].error is None) if case[6] is None else (case[6] in got[i].error and got[i].etag is None), case


def test_charsets(spark):
    rows = spark.createDataFrame([
        ("text/html; charset=windows-1252", bytearray("Café – ok".encode("cp1252"))),
        ("text/html", bytearray('<meta charset="iso-8859-1">né'.encode("latin-1"))),
        ("text/html; charset=Shift_JIS", bytearray("日本".encode("cp932"))),
        ("text/html; charset=what", bytearray("é".encode())), (None, bytearray(b"a\xffb"))],
        "content_type string, body binary")
    assert [r.body for r in outcome.decode_bodies(rows).collect()] == [
        "Café – ok", '<meta charset="iso-8859-1">né', "日本", "é", "a�b"]


def test_bodies_go_to_python_in_small_batches(spark):
    from feedloom.operators.parse import parse_feeds

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        body = "<rss><channel><item><title>a&nbsp;b</title></item>"
        got = parse_feeds(spark.createDataFrame([(body, "text/xml")], "body string, content_type string")).first()
        assert got.parse_mode == "mended" and got.entries[0].title == "a b" and int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, before)
