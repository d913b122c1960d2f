"""Column functions and search against plain Python."""
import datetime as dt
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates, identity, sql, text, urls
from feedloom.functions.porter import stem
from feedloom.operators import search
from feedloom.schemas import ITEMS


def apply(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("raw,want", [
    ("Mon, 24 Aug 2026 06:40:00 -0700", dt.datetime(2026, 8, 24, 13, 40)), ("24 Aug 2026 06:40 EST", dt.datetime(2026, 8, 24, 11, 40)),
    ("Sun, 1 Feb 26 00:00:00 GMT", dt.datetime(2026, 2, 1)), ("2026-08-24", dt.datetime(2026, 8, 24)),
    ("2026-08-24T06:40:00.1239Z", dt.datetime(2026, 8, 24, 6, 40, 0, 123000)), ("2026-08-24T06:40+02:00", dt.datetime(2026, 8, 24, 4, 40)),
    ("August 24, 2026", dt.datetime(2026, 8, 24)), (" 24 August 2026 ", dt.datetime(2026, 8, 24)), ("2026", dt.datetime(2026, 1, 1)),
    ("31 Feb 2026", None), ("yesterday", None), ("", None), (None, None), ("Mon, 24 Xyz 2026 06:40:00 GMT", None)])
def test_dates(spark, raw, want):
    assert apply(spark, dates.parse_date, raw) == [want]


def test_entities(spark):
    raw = "&amp;lt; &#65;&#x1F600;&#xD800; &#1114112; &nope; &NBSP;x &hellip; &#38;#60;"
    assert apply(spark, text.decode_entities, raw) == ["&lt; A😀�  &nope;  x &hellip; &#60;"]
    assert apply(spark, text.decode_page_entities, raw) == ["&lt; A😀� &#1114112; &nope;  x … &#60;"]
    assert apply(spark, text.decode_href, "a?x=1&amp;y=&#34;&amp;lt;") == ['a?x=1&y="&lt;']


def test_plain_text(spark):
    assert apply(spark, text.strip_tags, "<style>p{}</STYLE><p>a<br>b &nbsp; c</p><script>x</script>") == ["a b c"]
    assert apply(spark, text.excerpt, "x" * 260, "y" * 255 + " " * 3 + "z" * 9, "😀" * 131) == [
        "x" * 260, "y" * 255 + " zzzz…", "😀" * 130 + "…"]
    assert apply(spark, lambda c: text.utf16_left(c, 3), "a😀b", "ab😀", "abcd") == ["a😀", "ab�", "abc"]


def test_reading_body(spark):
    body = ('<p>See <a class="q" href="https://x/1">the <b>post</b></a> and <a href="/rel">this</a>.<br>Next</p><script>no</script>'
            "<div>Then <A HREF='http://y/2'></A></div>")
    assert apply(spark, text.reading_paragraphs, body) == [["See \x000\x00 and this .\nNext", "Then \x001\x00"]]
    assert [tuple(x) for x in apply(spark, text.reading_links, body)[0]] == [("https://x/1", "the post"), ("http://y/2", "")]


def test_hash_is_djb2_over_utf16_units(spark):
    def djb2(s):
        h, units = 5381, s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 33 + int.from_bytes(units[i:i + 2], "big")) & 0xFFFFFFFF
        return f"h:{h:x}"

    values = ["", "a|b", "título ß 日本", "😀 astral"]
    assert apply(spark, identity.hash_guid, *values) == [djb2(v) for v in values]


@pytest.mark.parametrize("href,want", [
    ("/a/../b?q#f", "https://h.example/b?q#f"), ("c d.html", "https://h.example/x/c%20d.html"), ("?p=2", "https://h.example/x/y?p=2"),
    ("//o.example", "https://o.example/"), ("HTTP://UP.example:80/A", "http://up.example/A"), ("#top", None), ("mailto:a@b", None),
    ("javascript:void(0)", None), ("data:text/plain,x", None), ("", None), (r"\a\b", "https://h.example/a/b"),
    ("/é?é&amp;x=1", "https://h.example/%C3%A9?%C3%A9&x=1"), ("http://bad host/", None)])
def test_links(spark, href, want):
    row = spark.createDataFrame([(href, "https://h.example/x/y?z=1")], "h string, b string")
    assert urls.with_absolute_link(row, F.col("h"), F.col("b")).first().url == want


def test_clocks(spark):
    seconds = lambda fn: lambda c: fn(c.cast("double"))
    assert apply(spark, seconds(dates.ago), "-3", "59.6", "60", "3599", "11520", "21600", "172800") == [
        "0s", "60s", "1m", "59m", "3h 12m", "6h", "2d"]
    assert apply(spark, seconds(dates.countdown), "0", "61", "600.4") == ["0:00", "1:01", "10:00"]
    assert apply(spark, lambda c: dates.seconds_to_next_poll(c.cast("timestamp")), "2026-01-01 10:00:00", "2026-01-01 10:19:55",
                 "2026-01-01 10:19:56") == [1200, 5, 1204]
    assert apply(spark, dates.duration_seconds, "PT1H2M3S", "PT45S", "P1D", "", "PT") == [3723, 45, 0, 0, 0]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "hissing": "hiss",
             "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
             "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic",
             "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
             "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas",
             "controll": "control", "roll": "roll", "at": "at", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: stem(w) for w in words} == words


def docs(spark):
    texts = [("Running feeds", "A run of feeds", "the feed runs and ran, runs"), ("Café culture", None, "coffee in a cafe, CAFÉ"),
             ("Nothing", "", "else"), ("Feeds", None, "run"), ("run", "run", "run " * 50 + "feeding")]
    return spark.createDataFrame([(i, 1, str(i), None, t, None, s, c, None, dt.datetime(2026, 1, 1), 0, 0, None)
                                  for i, (t, s, c) in enumerate(texts)], ITEMS), texts


@pytest.mark.parametrize("q,stemmed", [("run feeds", True), ("run", False), ("CAFÉ", True), ("running RUN", True), ("absent", True)])
def test_rank_against_brute_force(spark, q, stemmed):
    table, texts = docs(spark)
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    tokens = [[stem(w) if stemmed else w for f in d if f for w in re.findall(r"[^\W_]+", fold(f))] for d in texts]
    terms = search.query_terms(spark, q, stemmed)
    avg, n, want = sum(map(len, tokens)) / len(tokens), len(tokens), {}
    for i, words in enumerate(tokens):
        if all(t in words for t in terms):
            want[i] = sum(max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
                          for t in terms for df in [sum(t in w for w in tokens)] for tf in [words.count(t)])
    index = search.build_index(table, stemmed, buckets=4)
    got = {r.item_id: r.score for r in search.bm25(index, terms).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    feeds = spark.createDataFrame([(1, "F", None, None)], "feed_id bigint, title string, site_url string, folder string")
    page = [r.item_id for r in search.search(table, feeds, q, index, stemmed).collect()]
    assert page == sorted(want, key=lambda i: (-round(want[i], 12), -i))


def test_a_query_without_words_is_the_plain_list(spark):
    assert search.query_terms(spark, "  !? _ ") == [] and len(search.query_terms(spark, " ".join("abcdefghijklmnop"))) == 12
    table, texts = docs(spark)
    feeds = spark.createDataFrame([(1, "F", None, None)], "feed_id bigint, title string, site_url string, folder string")
    assert search.search(table, feeds, "?!", search.build_index(table), view="all").count() == len(texts)


def test_sql_functions(spark):
    sql.register(spark)
    table = spark.createDataFrame([(1, "https://h.example/", "<p>a <b class='x y'>b</b></p>"), (2, "https://h.example/", "<i>c</i>")],
                                  "page_id bigint, url string, html string")
    rows = spark.sql("select n.page_id, n.tag, n.text, n.classes from {pages} p, lateral html_nodes(p.page_id, p.url, p.html) n",
                     pages=table).collect()
    assert sorted((r.page_id, r.tag, r.text, r.classes) for r in rows) == [
        (1, "b", "b", ["x", "y"]), (1, "p", "a b", []), (2, "i", "c", [])]
    bulk = spark.sql("select page_id, tag, text, classes, base_url from page_nodes(table(select page_id, url, html from {pages}))", pages=table).collect()
    assert sorted((r.page_id, r.tag, r.text, r.classes) for r in bulk) == sorted((r.page_id, r.tag, r.text, r.classes) for r in rows)
    assert spark.sql("select porter_stem('running') s, resolve_url('b', 'https://h.example/a/') u").first() == (
        "run", "https://h.example/a/b")
