"""Inputs as they are published: mixed scripts, odd fields, marks, repeats and ties."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_date
from feedloom.functions.markup import scan
from feedloom.operators import actions, search, shorts, state
from feedloom.operators.outcome import codec_of, decode_body
from feedloom.operators.parse import items_of, parse_feeds

ITEMS = "item_id bigint, title string, summary string, content string"
WORDS = {1: "서울에 한국 소식", 2: "новый день", 3: "καλημέρα κόσμε", 4: "がっこう へ", 5: "Café crème", 6: "plain words"}


@pytest.mark.parametrize("q, hit", [("한국", 1), ("новый", 2), ("καλημέρα", 3), ("がっこう", 4), ("cafe", 5), ("CAFÉ", 5)])
def test_search_in_every_script(spark, q, hit):
    index = search.build_index(spark.createDataFrame([(k, v, None, None) for k, v in WORDS.items()], ITEMS), stemmed=False)
    found = search.match(index, search.query_terms(spark, q, stemmed=False))
    assert [r["item_id"] for r in found.collect()] == [hit]


@pytest.mark.parametrize("body, entries", [
    ('{"title":"T","author":"Jane","items":[{"id":1,"title":"a","author":"Bob"},{"id":"b","author":{"name":"N"}}]}',
     [("1", "a", None), ("b", "", "N")]),
    ('﻿{"items":{"id":"lone","title":["x"]}}', [("lone", "", None)]),
    ('<?xml version="1.0"?><!DOCTYPE rss [<!ENTITY a "b"> <!ELEMENT x (y)>]><rss><channel><item><guid>g</guid></item></channel></rss>',
     [("g", "", None)]),
    ("﻿<rss><channel><item><guid>q</guid><title>t</title></item></channel></rss>", [("q", "t", None)])])
def test_feeds_lose_no_entry(spark, body, entries):
    fetches = spark.createDataFrame([("f", body, "")], "fetch_id string, body string, content_type string")
    got = items_of(parse_feeds(fetches)).orderBy("feed_pos").collect()
    assert [(r["guid"], r["title"], r["author"]) for r in got] == entries


@pytest.mark.parametrize("text, when", [
    ("1/15/2024 3:00:00 PM", (2024, 1, 15, 15)), ("Jan 5, 2024 3:00 PM", (2024, 1, 5, 15)), ("2024-01-15 10:00 PM", (2024, 1, 15, 22)),
    ("Mon Jan 15 2024 10:00:00 GMT+0100 (CET)", (2024, 1, 15, 9)), ("1/15/2024 12:00 AM", (2024, 1, 15, 0)),
    ("2024-01-15 13:00 PM", None)])
def test_dates(spark, text, when):
    got = spark.range(1).select(parse_date(F.lit(text)).alias("t")).first()["t"]
    assert got == (when and dt.datetime(*when))


@pytest.mark.parametrize("label, raw, text", [
    ("x-cp1251", b"\xef\xf0\xe8", "при"), ("windows-31j", "日本".encode("cp932"), "日本"), ("windows-1252", b"a\x81\x80", "a\x81€"),
    ("utf-16", "﻿ab".encode("utf-16-le"), "ab"), ("iso8859-1", b"\x93", "“"), ("no-such", b"a", None)])
def test_charset_labels(label, raw, text):
    assert decode_body(raw, label) == text


def test_other_codecs_are_no_charsets():
    assert codec_of("rot13") is None and codec_of("hex") is None


def test_deep_and_long_pages():
    rows = scan("<div>" * 9000 + "x" * 5000 + " &amp;lt; " + "</div>" * 9000)
    assert len(rows) == 9000 and rows[-1]["text"] == "x" * 5000 + " &lt;" and rows[0]["text"] == "x" * 5000 + " <"
    assert rows[-1]["text_len"] == 5005


def test_one_state_row_per_feed(spark):
    outcomes = spark.createDataFrame([(1, "a", "error"), (1, "b", "ok"), (2, "c", "ok")], "feed_id long, fetch_id string, status string")
    assert sorted((r["feed_id"], r["status"]) for r in state.latest(outcomes).collect()) == [(1, "ok"), (2, "ok")]


def test_one_verdict_per_video(spark):
    answers = spark.createDataFrame([("v", 10, 200, None, dt.datetime(2024, 1, 2)), ("v", 10, 301, "/watch?v=v", dt.datetime(2024, 1, 1)),
                                     ("w", 999, None, None, dt.datetime(2024, 1, 1))],
                                    "video_id string, seconds int, http_status int, location string, checked_at timestamp")
    got = shorts.upsert_verdicts(spark.createDataFrame([("v", 0, None), ("x", 1, None)], "video_id string, is_short int, checked_at timestamp"),
                                 shorts.classify(answers))
    assert sorted((r["video_id"], r["is_short"], r["checked_at"] and r["checked_at"].day) for r in got.collect()) == [
        ("v", 1, 2), ("w", 0, 1), ("x", 1, None)]


def test_actions_of_one_second_keep_their_order(spark):
    at = dt.datetime(2024, 1, 1, 12)
    items = spark.createDataFrame([(1, 7, 0, 0, None, at), (2, 7, 0, 0, None, at)],
                                  "item_id long, feed_id long, is_read int, is_starred int, read_at timestamp, fetched_at timestamp")
    log = spark.createDataFrame([(1, at, "mark-all", None, 7, None), (2, at, "mark-read", 1, None, 0)],
                                "action_id long, ts timestamp, act string, item_id long, feed_id long, state int")
    feeds = spark.createDataFrame([(7, "f")], "feed_id long, folder string")
    got = {r["item_id"]: r["is_read"] for r in actions.apply_actions(items, log, feeds).collect()}
    assert got == {1: 0, 2: 1}


def test_plain_links_are_what_the_resolver_says(spark):
    import random

    from feedloom.functions.urls import plain_link, resolve

    rng = random.Random(12)
    parts = ["http://", "https://", "/", "//", "a.org", "A.org", "h:80", "u@", "b", "..", ".", "?", "#", "q=1&r='", ";p", "%20", " ", "é", "[", "\\", ":"]
    bases = ["https://h.example/x/y?z#f", "http://H.example/", "https://h.example", "https://h.example:81/a", "mailto:x", "https://h.example/a/../b"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))), rng.choice(bases)) for _ in range(20000)]
    got = spark.createDataFrame(rows, "href string, base string").select(
        "href", "base", plain_link(F.col("href"), F.col("base")).alias("plain")).filter("plain is not null").collect()
    assert len(got) > 100
    assert [(r["href"], r["base"], r["plain"]) for r in got if resolve(r["href"], r["base"]) != r["plain"]] == []


@pytest.mark.parametrize("href, base, want", [
    ("../a", "http://h.example/d/e/f", "http://h.example/d/a"), ("a//../b", "http://h.example/d/e", "http://h.example/d/a/b"),
    ("..", "http://h.example/d/e/f", "http://h.example/d/"), (".", "http://h.example/d/e", "http://h.example/d/"),
    ("?q=1", "http://h.example/d/e?z#y", "http://h.example/d/e?q=1"), (";x", "http://h.example/d/e", "http://h.example/d/;x"),
    ("x", "http://h.example", "http://h.example/x"), ("x?a=../b", "http://h.example/q/", "http://h.example/q/x?a=../b"),
    ("http://o.example/a/../b", "http://h.example/", "http://o.example/b"), ("/a/b/..", "http://h.example/", "http://h.example/a/"),
    ("../../../x", "http://h.example/a", "http://h.example/x"), ("z", "http://[::1]/a/b", "http://[::1]/a/z"),
    ("./a:b", "http://h.example/", "http://h.example/a:b"), ("/x;y=1", "http://h.example/", "http://h.example/x;y=1"),
    ("x", "http://h.example?to=a/b", "http://h.example/x")])
def test_links_put_together_in_columns(spark, href, base, want):
    from feedloom.functions.urls import plain_link, resolve

    row = spark.createDataFrame([(href, base)], "href string, base string")
    assert row.select(plain_link(F.col("href"), F.col("base")).alias("u")).first().u == want == resolve(href, base)


def test_subscription_lists_of_any_depth(spark):
    import time

    from feedloom.sources.opml import opml_feeds

    deep = "".join(f'<outline text="f{k}">' for k in range(5000)) + '<outline xmlUrl="http://x"/>' + "</outline>" * 5000 + '<outline xmlUrl="http://top"/>'
    mixed = ('<outline text="A"><outline xmlUrl="http://1"><outline xmlUrl="http://2"/></outline><outline><outline xmlUrl="http://3"/></outline>'
             '<outline text="B"/><outline xmlUrl="http://4"/></outline><outline xmlUrl="http://5"/><outline text="C"><outline text="D"></outline>'
             '<outline xmlUrl="http://6"/></outline>')
    files = spark.createDataFrame([("deep", f"<opml><body>{deep}</body></opml>"), ("mixed", f"<opml><body>{mixed}</body></opml>")],
                                  "doc_id string, xml string")
    started = time.time()
    got = {r["feed_url"]: r["folder"] for r in opml_feeds(files).collect()}
    assert time.time() - started < 60
    assert got == {"http://x": "f4999", "http://top": None, "http://1": "A", "http://2": "A", "http://3": "A", "http://4": "A",
                   "http://5": None, "http://6": "C"}


def test_runs_are_logged_also_when_they_fail(spark, tmp_path):
    from feedloom.operators.poll import Poll, recorded
    from feedloom.schemas import RUNS
    from feedloom.sources.tables import Table

    runs = Table(spark, str(tmp_path / "runs"), RUNS)
    stats = spark.createDataFrame([(3, 2, 0, 1, 5, 0, 0, None)], "feeds long, ok long, not_modified long, errored long, inserted long, "
                                  "shorts_swept long, unclassified long, note string")
    recorded(runs, 1, "cron", lambda: Poll(None, None, None, stats))
    with pytest.raises(RuntimeError):
        recorded(runs, 2, "manual", lambda: (_ for _ in ()).throw(RuntimeError("no disk")))
    recorded(runs, 1, "cron", lambda: Poll(None, None, None, stats))
    got = {r["run_id"]: r for r in runs.read().collect()}
    assert sorted(got) == [1, 2] and runs.read().count() == 2
    assert (got[1]["feeds"], got[1]["trigger"], got[1]["note"]) == (3, "cron", None)
    assert got[1]["duration_ms"] >= 0 and got[1]["started_at"] <= got[1]["finished_at"]
    assert got[2]["note"] == "Run failed: no disk" and got[2]["feeds"] == 0

def test_merged_steps_search_like_a_fresh_index(spark, tmp_path):
    """Forty steps of additions, removals and updates; a step that broke off, and steps that come again."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(30)], k=rng.randrange(1, 25)))
    frame = lambda rows: spark.createDataFrame([(i, v, None, None) for i, v in rows.items()], ITEMS)
    saved, held = search.SavedIndex(spark, f"{tmp_path}/index", stemmed=False, buckets=3, fan=3), {}
    for step in range(1, 21):
        old = {i: held[i] for i in rng.sample(sorted(held), len(held) // 4)}
        new = {i: text() for i in [*list(old)[::2], *range(step * 10, step * 10 + 8)]}
        if step == 9:
            # The parts are written, their list is not.
            put, saved.parts.put = saved.parts.put, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            with pytest.raises(RuntimeError):
                saved.add(frame({900: "w0 w1 w1", **new}), step)
            saved.parts.put = put
        if old:
            saved.remove(frame(old), step)
        saved.add(frame(new), step)
        if step in (9, 14):
            saved.add(frame(new), step)
            saved.add(frame({901: "w0 w1"}), step - 1)
        held = {i: v for i, v in held.items() if i not in old} | new
    assert len(saved.live()) <= 2 * 4
    index, fresh = saved.open(), search.build_index(frame(held), stemmed=False)
    assert (index.n, round(index.avgdl, 9)) == (fresh.n, round(fresh.avgdl, 9))
    assert index.counts(vocabulary) == fresh.counts(vocabulary)
    for terms in (["w0"], ["w0", "w7"], ["w29", "w1", "w0"], ["w0", "absent"], ["w2", "w2", "w5"]):
        ranked = [sorted((r.item_id, round(r.score, 9)) for r in search.bm25(i, terms).collect()) for i in (index, fresh)]
        want = {i for i, v in held.items() if set(terms) <= set(v.split())}
        assert ranked[0] == ranked[1] and {i for i, _ in ranked[0]} == want
    opened = {r.f.split("batch=")[1].split("/")[0] for r in index.postings.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened <= {r["name"] for r in saved.live()}
    folders = {d for d in os.listdir(f"{tmp_path}/index/postings/bucket=0")}
    assert len(folders) <= 2 * 4 + 9


def test_a_common_term_does_not_move(spark):
    """The rare term's hits go to the common term's postings, of which only those between its first and last item are read."""
    rows = [(i, "common " + ("rare" if 500 <= i < 520 else "other"), None, None) for i in range(2000)]
    index = search.build_index(spark.createDataFrame(rows, ITEMS), stemmed=False)
    found = search.match(index, ["common", "rare"])
    assert sorted(r.item_id for r in found.collect()) == list(range(500, 520))
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "GreaterThanOrEqual(item_id,500)" in plan and "LessThanOrEqual(item_id,5" in plan
    assert index.of(["common"], lo=500, hi=519).count() == 20


def _entries(spark, body):
    fetches = spark.createDataFrame([("f", body, "")], "fetch_id string, body string, content_type string")
    parsed = parse_feeds(fetches)
    return parsed.first()["parse_error"], [(r["guid"], r["title"]) for r in items_of(parsed).orderBy("feed_pos").collect()]


@pytest.mark.parametrize("subset, title, want", [
    ('<!ENTITY a "Ann &amp; Bo">', "by &a;", "by Ann & Bo"), ("<!ENTITY a 'x'><!ENTITY a 'y'>", "&a;&b;", "x&b;"),
    ('<!ENTITY a "1]2"> <!-- <!ENTITY b "no"> --> <!ENTITY c "&a;&#x33;&a;">', "&c; &b;", "1]231]2 &b;"),
    ('<!ENTITY a SYSTEM "http://h/x"><!ENTITY % p "q">', "&a;", "&a;"), ('<!ENTITY a "in">', "<![CDATA[&a;]]>", "&a;"),
    ('<!ENTITY lt2 "&#38;#60;">', "1 &lt2; 2", "1 < 2")])
def test_declared_entities(spark, subset, title, want):
    body = f'<?xml version="1.0"?><!DOCTYPE rss [{subset}]><rss><channel><item><guid>g</guid><title>{title}</title></item></channel></rss>'
    assert _entries(spark, body) == (None, [("g", want)])


@pytest.mark.parametrize("subset", [
    '<!ENTITY a "&b;"><!ENTITY b "&a;">', "".join(f'<!ENTITY e{k} "{f"&e{k - 1};" * 10}">' if k else '<!ENTITY e0 "lol">' for k in range(12)) + '<!ENTITY a "&e11;">',
    f'<!ENTITY a "{"x" * 3000}">'])
def test_entities_without_end(spark, subset):
    body = f"<!DOCTYPE rss [{subset}]><rss><channel><item><guid>g</guid><title>{'&a;' * 400}</title></item></channel></rss>"
    error, entries = _entries(spark, body)
    assert "entities" in error and entries == []


@pytest.mark.parametrize("href, want", [
    ("http://[::1]/x", "http://[::1]/x"), ("//[2001:DB8:0:0::1]:80/p?q#f", "http://[2001:db8::1]/p?q#f"), ("http://[::1]:8080", "http://[::1]:8080/"),
    ("http://[::zz]/", None), ("http://[fe80::1%25eth0]/", None), ("../a;b?c", "http://h.example/a;b?c"), ("?x", "http://h.example/d/e?x")])
def test_bracketed_hosts(href, want):
    from feedloom.functions.urls import resolve

    assert resolve(href, "http://h.example/d/e") == want
