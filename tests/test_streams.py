"""Streaming forms: many micro-batches give what one batch gives, and a repeated batch changes nothing."""
import datetime as dt
import random

from pyspark.sql import functions as F

from feedloom.operators import state
from feedloom.schemas import FETCHES, ITEMS
from feedloom.sources.landed import stream_fetches
from feedloom.sources.tables import Table
from feedloom.streaming import health, ingest

T0 = dt.datetime(2026, 1, 1)


def plain_health(polls, threshold, backoff):
    """poll_id -> health, and the times feeds fell due, poll by poll."""
    out, due, last = {}, [], {}
    for i, feed, at, status, n, scraped, etag, modified in sorted(polls, key=lambda p: (p[2], p[0])):
        errors, count, tags, before = last.get(feed, (0, None, (None, None), None))
        if before and errors >= threshold and at - before >= backoff:
            due.append((feed, before + backoff))
        decayed = status == "ok" and scraped and count is not None and count >= 4 and n < count * 0.5
        if status == "error" or decayed:
            status, errors, tags = "error", errors + 1, (None, None)
        else:
            errors = 0
            if status == "ok":
                tags, count = (etag, modified), n if scraped else count
        last[feed] = errors, count, tags, at
        out[i] = (feed, status, errors, count, *tags)
    return out, due + [(f, at + backoff) for f, (errors, _, _, at) in last.items() if errors >= threshold]


def test_health_and_due_over_micro_batches(spark, tmp_path):
    """Polls arrive out of order within the delay, in many batches; the stream is stopped and started between them."""
    rng = random.Random(5)
    log = [(i, rng.choice([1, 2, 2, 5]), T0 + dt.timedelta(minutes=7 * i, microseconds=rng.randrange(10**6)), rng.choice(["ok", "error", "error", "not-modified"]),
            rng.randrange(40), False, f"e{i}", rng.choice([None, f"m{i}"])) for i in range(240)]
    log = [(*p[:5], p[1] == 2, *p[6:]) for p in log] + [(1000, 9, T0 + dt.timedelta(days=9), "ok", None, None, None, None)]
    arriving = sorted(log, key=lambda p: p[2] + dt.timedelta(minutes=rng.randrange(55)))
    got, fell_due = {}, []
    for k in range(0, len(arriving), 60):
        spark.createDataFrame(arriving[k:k + 60], health.POLLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:04d}")
        for name, make in (("h", health.feed_health), ("d", health.feeds_due)):
            stream = spark.readStream.schema(health.POLLS).parquet(f"{tmp_path}/in/*")
            out = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/{k}-{n}")
            make(stream, threshold=2, backoff_minutes=30).writeStream.foreachBatch(out).option(
                "checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    want, due = plain_health([(*p[:4], p[4] or 0, p[5] or False, *p[6:]) for p in log if p[0] < 1000], 2, dt.timedelta(minutes=30))
    rows = spark.read.schema(health.HEALTH).parquet(f"{tmp_path}/h/*").collect()
    assert len(rows) == len(want)
    assert {r.poll_id: (r.feed_id, r.last_status, r.error_count, r.last_item_count, r.etag, r.last_modified) for r in rows} == want
    rows = spark.read.schema(health.HEALTH).parquet(f"{tmp_path}/d/*").collect()
    assert sorted((r.feed_id, r.due_at) for r in rows) == sorted(due) and len(due) > 5


def test_silent_feeds_leave_the_state(spark, tmp_path):
    """A feed that comes back after its state went starts anew."""
    at = lambda days: T0 + dt.timedelta(days=days)
    for k, rows in enumerate([[(1, 1, at(0), "error"), (2, 1, at(1), "error"), (3, 2, at(1), "error")], [(4, 2, at(8), "error")],
                              [(5, 2, at(20), "ok")], [(6, 1, at(21), "error"), (7, 3, at(22), "ok")]]):
        spark.createDataFrame([(*r, 1, False, None, None) for r in rows], health.POLLS).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(health.POLLS).parquet(f"{tmp_path}/in/*")
        out = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        health.feed_health(stream, keep_minutes=10 * 24 * 60).writeStream.foreachBatch(out).option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.poll_id: r.error_count for r in spark.read.schema(health.HEALTH).parquet(f"{tmp_path}/out/*").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 0, 6: 1}


def test_health_with_any_state_store(spark, tmp_path):
    """Feeds of many polls, ids and values missing, in a session that names no state store."""
    rows = [(i if i % 7 else None, i % 3, T0 + dt.timedelta(minutes=i), "error" if i % 400 < 40 else "ok", None if i % 5 else 9, None, f"e{i}", None)
            for i in range(3000)]
    spark.createDataFrame(rows, health.POLLS).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9999, 7, T0 + dt.timedelta(days=9), "ok", 1, None, None, None)], health.POLLS).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        for name, make in (("h", health.feed_health), ("d", health.feeds_due)):
            stream = spark.readStream.schema(health.POLLS).parquet(f"{tmp_path}/in")
            out = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/{n}")
            make(stream, threshold=2, backoff_minutes=3).writeStream.foreachBatch(out).option(
                "checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    want, due = plain_health([(i, *r[1:4], r[4] or 0, False, *r[6:]) for i, r in enumerate(rows)], 2, dt.timedelta(minutes=3))
    got = spark.read.schema(health.HEALTH).parquet(f"{tmp_path}/h/*").orderBy("polled_at").collect()
    assert [(r.feed_id, r.last_status, r.error_count, r.last_item_count, r.etag, r.last_modified) for r in got] == [want[i] for i in range(3000)]
    assert [r.poll_id for r in got] == [r[0] for r in rows]
    got = spark.read.schema(health.HEALTH).parquet(f"{tmp_path}/d/*").collect()
    assert sorted((r.feed_id, r.due_at) for r in got) == sorted(due) and len(due) > 5


def response(i, feed, body, kind="feed", rule=None, status=200):
    ctype = "text/html" if kind == "scrape" else "application/rss+xml"
    return (f"f{i}", feed, f"https://h{feed}.example/list", None, kind, rule, status, None, ctype, None, "e", None,
            bytearray(body.encode()), T0 + dt.timedelta(minutes=i))


def rss(*guids):
    return "<rss><channel><title>T</title>" + "".join(f"<item><title>{g}</title><guid>{g}</guid></item>" for g in guids) + "</channel></rss>"


def test_ingest_survives_repeats(spark, tmp_path):
    items = Table(spark, f"{tmp_path}/items", ITEMS, bucket_by="feed_id")
    polls = Table(spark, f"{tmp_path}/polls", ingest.POLL_LOG)
    verdicts = spark.createDataFrame([], "video_id string, is_short int")
    page = '<div class="c"><a href="/1">one</a></div><div class="c"><a href="/2">two</a></div>'
    rule = '{"item":".c"}'
    batches = [
        [response(0, 1, rss("a", "b")), response(1, 2, page, "scrape", rule), response(2, 3, "gone", status=410)],
        [response(3, 1, rss("b", "c")), response(4, 2, page, "scrape", rule), response(5, 4, page, "scrape", "{oops"),
         response(6, 1, "", status=304)]]
    for rows in batches:
        spark.createDataFrame(rows, FETCHES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        ingest.start_ingest(stream_fetches(spark, f"{tmp_path}/landed"), items, verdicts, polls, f"{tmp_path}/cp").awaitTermination()
    held = sorted((r.feed_id, r.guid) for r in items.read().collect())
    assert held == [(1, "a"), (1, "b"), (1, "c"), (2, "https://h2.example/1"), (2, "https://h2.example/2")]
    assert items.read().select("item_id").distinct().count() == 5
    again = spark.createDataFrame(batches[1], FETCHES)
    ingest.ingest_batch(again, items, verdicts, polls, "ingest", 1)
    ingest.ingest_batch(again, items, verdicts, polls, "ingest", 2)
    assert items.read().count() == 5
    log = {(r.feed_id, r.polled_at.minute): r.status for r in polls.read().filter(F.col("polled_at") < T0 + dt.timedelta(minutes=7)).distinct().collect()}
    assert log == {(1, 0): "ok", (2, 1): "ok", (3, 2): "error", (1, 3): "ok", (2, 4): "ok", (4, 5): "error", (1, 6): "not-modified"}


def test_poll_stream_equals_polls_one_by_one(spark, tmp_path):
    """Every table after every batch is that of ``poll_cycle`` over whole tables; a batch that broke off and comes again changes nothing."""
    from feedloom.operators.poll import poll_cycle
    from feedloom.schemas import FEEDS, VERDICTS
    from feedloom.streaming.poll import PollTables, poll_batch

    columns = [c.split()[0] for c in FEEDS.split(", ")]
    video = "https://www.youtube.com/feeds/videos.xml?channel_id=UC"
    feed = lambda i, **k: tuple({"feed_id": i, "feed_url": f"https://h{i}.example/f", "title": "", "error_count": 0, "kind": "feed", **k}.get(c) for c in columns)
    rule = '{"item":".c"}'
    feeds = spark.createDataFrame([feed(1), feed(2, kind="scrape", scrape_rule=rule), feed(3), feed(2**62, feed_url=video), feed(9)], FEEDS)
    none = spark.createDataFrame([], ITEMS)
    verdicts = spark.createDataFrame([("AAAAAAAAAAA", 1, T0)], VERDICTS)
    answers = spark.createDataFrame([("BBBBBBBBBBB", 20, 200, None, T0), ("CCCCCCCCCCC", 900, None, None, T0)],
                                    "video_id string, seconds int, http_status int, location string, checked_at timestamp")
    watch = lambda *ids: "<feed xmlns='http://www.w3.org/2005/Atom'><title>V</title>" + "".join(
        f"<entry><id>{i}</id><title>{i}</title><link href='https://www.youtube.com/watch?v={i}'/></entry>" for i in ids) + "</feed>"
    page = "".join(f'<div class="c"><a href="/{k}">p{k}</a></div>' for k in range(6))
    batches = [
        [response(0, 1, rss("a", "b")), response(1, 2, page, "scrape", rule), response(2, 3, "gone", status=410)],
        [response(3, 2**62, watch("AAAAAAAAAAA", "BBBBBBBBBBB", "CCCCCCCCCCC")), response(4, 2, page[:60], "scrape", rule), response(5, 3, "", status=500)],
        [response(6, 1, rss(*"bcdefgh")), response(7, 2**62, watch("BBBBBBBBBBB", "DDDDDDDDDDD")), response(8, 3, rss("z"))],
        [response(9, 1, "", status=304)]]
    tables = PollTables.at(spark, f"{tmp_path}/tables", buckets=3)
    tables.begin(feeds, verdicts=verdicts)
    rows = lambda df: sorted(map(str, df.collect()))
    items, last = none, 0
    for k, batch in enumerate(batches, 1):
        fetches = spark.createDataFrame(batch, FETCHES)
        now = F.lit(max(r[-1] for r in batch))
        want = poll_cycle(fetches, feeds, items, verdicts, answers, now, force=True, cap=5, last_id=F.lit(last))
        if k == 3:
            # The batch dies after its items were written: nobody sees them, and its repetition writes them again.
            before = [rows(t) for t in tables.read()]
            log, tables.runs.put = tables.runs.put, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            try:
                poll_batch(fetches, tables, answers, k, cap=5)
                raise AssertionError("the batch was to fail")
            except RuntimeError:
                tables.runs.put = log
            assert [rows(t) for t in tables.read()] == before and tables.committed() == 2
        for _ in range(1 + (k == 2)):
            poll_batch(fetches, tables, answers, k, cap=5)
            got = tables.read()
            assert [rows(t) for t in got] == [rows(want.feeds.select(columns)), rows(want.items.select(got[1].columns)), rows(want.verdicts)]
        record, told = tables.runs.read().filter(F.col("run_id") == k).collect(), want.run.first()
        assert len(record) == 1 and all(record[0][c] == told[c] for c in ("feeds", "ok", "not_modified", "errored", "inserted", "shorts_swept"))
        assert record[0].unclassified == {1: 0, 2: 0, 3: 1, 4: 0}[k]
        feeds, items, verdicts = (spark.createDataFrame(t.collect(), t.schema) for t in got)
        last = record[0].last_item_id
    assert {r.feed_id: (r.error_count, r.last_status) for r in feeds.collect()} == {
        1: (0, "not-modified"), 2: (1, "error"), 3: (0, "ok"), 2**62: (0, "ok"), 9: (0, None)}


def test_limits_are_off_unless_given(spark):
    """A page of 5 MB with 150 items, its charset named far down, is read whole; the reader's own limits are arguments."""
    from feedloom.operators.html import READER_LIMITS
    from feedloom.operators.poll import read_responses

    items = "".join(f'<div class="c"><a href="/{k}">p{k} {"x" * 400}</a></div>' for k in range(150))
    pages = {1: items + "<!--" + "y" * 5_000_000 + "-->", 2: items}
    fetches = spark.createDataFrame([response(k, k, body, "scrape", '{"item":".c"}') for k, body in pages.items()], FETCHES)
    status = lambda found: {r.feed_id: (r.status, r.n_items) for r in found[0].collect()}
    whole, cut = read_responses(fetches), read_responses(fetches, **READER_LIMITS)
    assert status(whole) == {1: ("ok", 150), 2: ("ok", 150)} and whole[1].filter(F.length("title") > 400).count() == 300
    assert status(cut) == {1: ("error", 0), 2: ("ok", 100)}


def test_batches_leave_no_scratch(spark, tmp_path):
    from feedloom import session

    items = Table(spark, f"{tmp_path}/items", ITEMS, bucket_by="feed_id", buckets=4)
    polls = Table(spark, f"{tmp_path}/polls", ingest.POLL_LOG)
    verdicts = spark.createDataFrame([], "video_id string, is_short int")
    before = list(session._STORED)
    for k in range(3):
        ingest.ingest_batch(spark.createDataFrame([response(k, 1, rss(f"g{k}", "same"))], FETCHES), items, verdicts, polls, "s", k)
    assert session._STORED == before
    assert sorted(r.guid for r in items.read().collect()) == ["g0", "g1", "g2", "same"] and polls.read().count() == 3


def test_ingest_writes_no_body_again(spark, tmp_path, monkeypatch):
    """A batch's bodies stay where they landed."""
    kept = []
    monkeypatch.setattr(ingest, "stored", lambda df, *by, f=ingest.stored: kept.append(df.columns) or f(df, *by))
    body = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>https://x.example/{i}</link></item>" for i in range(3)) + "</channel></rss>"
    spark.createDataFrame([response(1, 1, body), response(2, 2, body)], FETCHES).write.parquet(f"{tmp_path}/in")
    items, polls = Table(spark, f"{tmp_path}/items", ITEMS, bucket_by="feed_id"), Table(spark, f"{tmp_path}/polls", ingest.POLL_LOG)
    verdicts = spark.createDataFrame([], "video_id string, is_short int")
    ingest.start_ingest(stream_fetches(spark, f"{tmp_path}/in"), items, verdicts, polls, f"{tmp_path}/cp").awaitTermination()
    assert items.read().count() == 6 and polls.read().count() == 2
    assert kept and all("body" not in columns for columns in kept)


def test_polls_of_the_tables_read_landed_responses(spark, monkeypatch):
    """The feeds of a poll are read from its landed responses, and a part of the stream is a file for each core."""
    from feedloom.plans import streams
    from feedloom.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    given = []
    monkeypatch.setattr(streams, "poll_cycle", lambda *frames, **limits: given.extend(frames))
    streams.polled(t)
    assert given[0].inputFiles() and set(given[0].inputFiles()) == set(given[1].inputFiles())
    path = streams._folder(t)
    assert streams._land(t, path, 3) == spark.sparkContext.defaultParallelism
    landed = spark.read.parquet(path)
    assert 3 < len(landed.inputFiles()) <= 3 * spark.sparkContext.defaultParallelism and landed.count() == given[0].count()
