"""Ingest, retention, feed state, short videos and actions against plain Python on small tables."""
import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from feedloom.operators import actions, ingest, ranking, retention, shorts, state
from feedloom.schemas import FEEDS, ITEMS
from feedloom.sources import opml
from feedloom.sources.tables import Table

T0 = dt.datetime(2026, 1, 1)
ENTRY = ("feed_id bigint, fetch_id string, feed_pos int, guid string, url string, title string, author string, "
         "summary string, content string, published_at timestamp")


def entries(spark, rows):
    """rows: (feed, pos, guid, minutes or None)"""
    return spark.createDataFrame([(f, str(f), p, g, None, g, None, None, None, None if m is None else T0 + dt.timedelta(minutes=m))
                                  for f, p, g, m in rows], ENTRY)


def items(spark, rows):
    """rows: (id, feed, guid, minutes, starred)"""
    return spark.createDataFrame([(i, f, g, None, g, None, None, None, T0 + dt.timedelta(minutes=m), T0, 0, s, None)
                                  for i, f, g, m, s in rows], ITEMS)


def verdicts(spark, *rows):
    return spark.createDataFrame(list(rows), "video_id string, is_short int")


def test_oldest_duplicate_wins_and_duplicates_take_places(spark):
    batch = entries(spark, [(1, 0, "new", 9), (1, 1, "dup", 8), (1, 2, "dup", 5), (1, 3, "old", 1), (1, 4, "undated", None)])
    got = ingest.new_items(batch, items(spark, []), verdicts(spark), ["feed_id"], cap=3).collect()
    assert sorted((r.guid, r.feed_pos) for r in got) == [("dup", 2), ("new", 0)]


def test_stored_rows_are_left_alone_and_replay_inserts_nothing(spark):
    batch = entries(spark, [(1, 0, "a", 1), (1, 1, "b", 2), (2, 0, "a", 3)])
    fresh = ingest.new_items(batch, items(spark, [(1, 1, "a", 0, 0)]), verdicts(spark), ["feed_id"])
    assert sorted((r.feed_id, r.guid) for r in fresh.collect()) == [(1, "b"), (2, "a")]
    again = ingest.new_items(batch, fresh.select("feed_id", "guid").union(fresh.select(F.lit(1), F.lit("a"))),
                             verdicts(spark), ["feed_id"])
    assert again.count() == 0


def test_ids_grow_with_recency(spark):
    fresh = entries(spark, [(1, 0, "c", 3), (1, 1, "b", 2), (1, 2, "tie", 2), (1, 3, "none", None), (7, 0, "x", 1)])
    got = ingest.with_ids(fresh, items(spark, [(40, 1, "z", 0, 0)]))
    by_id = [r.guid for r in got.filter("feed_id = 1").orderBy("item_id").collect()]
    assert by_id == ["none", "tie", "b", "c"]
    assert got.select("item_id").distinct().count() == 5 and got.agg(F.min("item_id")).first()[0] > 40


def test_ids_for_feeds_of_any_id(spark):
    """Hashed feed ids, over many ranges: no gap, no overflow, oldest first."""
    rows = [(f * (2**62 - 57), k, f"g{k}", (k * 7) % 50 if k % 9 else None) for f in (-2, -1, 0, 1) for k in range(60)]
    fresh = entries(spark, rows).repartition(5)
    got = ingest.with_ids(fresh, items(spark, []), F.lit(10**15)).orderBy("item_id").collect()
    assert [r.item_id for r in got] == list(range(10**15 + 1, 10**15 + 241))
    want = sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, -r[1], r[0], r[2]))
    assert [(r.feed_id, r.guid) for r in got] == [(r[0], r[2]) for r in want]


def test_known_shorts_are_not_ingested(spark):
    batch = entries(spark, [(1, 0, "v", 1), (1, 1, "w", 1), (1, 2, "p", 1)]).withColumn("url", F.expr(
        "case guid when 'v' then 'https://youtu.be/AAAAAAAAAAA' when 'w' then 'https://youtu.be/BBBBBBBBBBB' end"))
    got = ingest.without_shorts(batch, verdicts(spark, ("AAAAAAAAAAA", 1), ("BBBBBBBBBBB", 0)))
    assert sorted(r.guid for r in got.collect()) == ["p", "w"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=40), st.integers(1, 5))
def test_retention(spark, rows, cap):
    table = [(i, f, str(i), m, s) for i, (f, m, s) in enumerate(rows)]
    want = set()
    for feed in {r[1] for r in table}:
        mine = sorted((r for r in table if r[1] == feed), key=lambda r: (-r[3], -r[0]))
        want |= {r[0] for k, r in enumerate(mine) if k < cap or r[4]}
    kept = retention.retention(items(spark, table), cap)
    assert {r.item_id for r in kept.collect()} == want
    assert retention.retention(kept, cap).count() == len(want)


def test_a_hot_key_is_ranked_exactly(spark):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 40), rng.randrange(50), i) for i in range(4000)]
    table = spark.createDataFrame(rows, "k int, v int, id int")
    got = ranking.top_per_key(table, ["k"], [F.col("v").desc(), F.col("id")], 25, ["id"]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:25], 1):
            want[r[2]] = place
    assert {r.id: r["rank"] for r in got} == want
    numbered = ranking.ordinals(table, ["k"], F.floor(F.col("id") / 100), [F.col("id")]).collect()
    for k in (0, 5):
        assert [r.ordinal for r in sorted((r for r in numbered if r.k == k), key=lambda r: r.id)] == list(
            range(1, 1 + sum(r[0] == k for r in rows)))


def test_feed_state(spark):
    cols = [p.split()[0] for p in FEEDS.split(", ")]

    def feed(i, **over):
        return tuple({"feed_id": i, "feed_url": f"f{i}", "title": "", "error_count": 3, "etag": "old", "last_modified": "then",
                      "kind": "feed", "last_error": "was", **over}.get(c) for c in cols)

    feeds = spark.createDataFrame([
        feed(1), feed(2, title="Mine", site_url="https://mine"), feed(3), feed(4), feed(5, kind="scrape", last_item_count=10),
        feed(6, kind="scrape", last_item_count=10), feed(7, kind="scrape", last_item_count=3), feed(8)], FEEDS)
    out = spark.createDataFrame([
        (1, "ok", None, "new", None, "T", "https://s", 4), (2, "ok", None, "new", None, "T", "https://s", 0),
        (3, "not-modified", None, None, None, None, None, 0), (4, "error", "HTTP 500", "new", None, None, None, 0),
        (5, "ok", None, "new", None, "T", None, 4), (6, "ok", None, "new", None, "T", None, 5), (7, "ok", None, "new", None, "T", None, 1)],
        "feed_id bigint, status string, error string, etag string, last_modified string, feed_title string, site_url string, n_items int")
    got = {r.feed_id: r for r in state.next_feed_state(feeds, out, F.lit(T0)).collect()}
    brief = lambda i: (got[i].last_status, got[i].error_count, got[i].etag, got[i].title, got[i].site_url, got[i].last_item_count)
    assert brief(1) == ("ok", 0, "new", "T", "https://s", None)
    assert brief(2) == ("ok", 0, "new", "Mine", "https://mine", None)
    assert brief(3) == ("not-modified", 0, "old", "", None, None) and got[3].last_error is None
    assert brief(4) == ("error", 4, None, "", None, None) and got[4].last_error == "HTTP 500"
    assert brief(5) == ("error", 4, None, "T", None, 10) and "4 of the 10" in got[5].last_error
    assert brief(6) == ("ok", 0, "new", "T", None, 5) and brief(7) == ("ok", 0, "new", "T", None, 1)
    assert brief(8) == (None, 3, "old", "", None, None) and got[8].last_error == "was"
    run = state.run_stats(state.judged(feeds, out), F.lit(9), F.lit(2), F.lit(40)).first()
    assert (run.feeds, run.ok, run.not_modified, run.errored, run.inserted) == (7, 4, 1, 2, 9)
    assert run.note == "40 YouTube video(s) still unclassified, carried to the next poll"


def test_chained_decay_steps_equal_the_fold(spark):
    rng = random.Random(8)
    cases = [([rng.randrange(rng.choice([6, 41])) for _ in range(rng.randrange(31))], rng.randrange(-1, 61)) for _ in range(300)]
    rows = spark.createDataFrame([(k, [(n,) for n in counts], start) for k, (counts, start) in enumerate(cases)],
                                 "k int, polls array<struct<n_items:int>>, start bigint")
    halves = [state._run_steps(F.slice("polls", *cut)) for cut in ((F.lit(1), F.lit(9)), (F.lit(10), F.lit(30)))]
    got = rows.select("k", state._run_counts(F.col("polls"), F.col("start")).alias("counts"),
                      state._run_steps(F.col("polls")).alias("steps"),
                      state._folded(F.array(*halves)).alias("joined"), "start").withColumn(
        "after", state._after(F.col("joined"), F.col("start"))).collect()
    for r in got:
        counts, fold = cases[r.k]
        folds = [fold]
        for n in counts:
            fold = fold if fold >= 4 and n < fold * 0.5 else n
            folds.append(fold)
        assert r.counts == folds and r.after == fold
        assert r.joined == r.steps and len(r.steps) < 10


def test_decay_across_runs_of_polls(spark):
    """More polls a day than a run holds, several feeds, ties of time, runs beyond one level."""
    rng = random.Random(5)
    log = [(i, rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(minutes=i // 3), "ok", rng.choice([None, *range(60)]))
           for i in range(4000)]
    polls = spark.createDataFrame(log, "poll_id bigint, feed_id bigint, polled_at timestamp, status string, n_items int")
    count, folds = {}, {}
    for i, f, _, _, n in log:
        if n is not None:
            before = count.get(f)
            decayed = before is not None and before >= 4 and n < before * 0.5
            folds[i] = (before, bool(decayed) if before is not None else None)
            count[f] = before if decayed else n
    decays = state.scrape_decay(polls, chunk_seconds=20_000)
    assert {r.poll_id: r.before for r in decays.collect()} == {i: b for i, (b, _) in folds.items()}
    assert {r.poll_id: bool(r.decayed) for r in decays.collect()} == {i: bool(d) for i, (_, d) in folds.items()}
    assert "InPandas" not in decays._jdf.queryExecution().toString()
    assert state.scrape_decay(polls.limit(0)).count() == 0


def test_marks_reach_items_after_them_whatever_the_slices(spark):
    """Next marks by slices of time against a search of all marks: hot slices, ties, items without a time."""
    rng = random.Random(11)
    at = lambda: rng.choice([T0 + dt.timedelta(seconds=rng.randrange(40_000)), T0 + dt.timedelta(seconds=5000)])
    waiting = [(i, rng.randrange(4), (at() if rng.random() > .02 else None, rng.randrange(50))) for i in range(900)]
    marks = [(rng.randrange(4), (at(), 100 + i)) for i in range(60)]
    seq = "struct<ts:timestamp,action_id:bigint>"
    items = spark.createDataFrame(waiting, f"item_id bigint, feed_id bigint, since {seq}")
    given = spark.createDataFrame(marks, f"feed_id bigint, seq {seq}")
    low = dt.datetime(1, 1, 1)
    key = lambda p: (p[0] or low, p[1])
    for keys in (["feed_id"], []):
        want = {}
        for i, f, since in waiting:
            later = [m for g, m in marks if (not keys or g == f) and key(m) > key(since)]
            if later:
                want[i] = min(later)
        for rows in (7, 100_000):
            got = actions._next_mark(items, given, keys, slice_seconds=3600, slice_rows=rows).collect()
            assert len(got) == len(want) and {r.item_id: (r.next.ts, r.next.action_id) for r in got} == want


def test_streaks_and_decay_over_days(spark):
    rng = random.Random(3)
    log = [(i, rng.choice([1, 1, 1, 2]), T0 + dt.timedelta(hours=5 * i), rng.choice(["ok", "error", "not-modified"]),
            rng.randrange(40)) for i in range(300)]
    polls = spark.createDataFrame(log, "poll_id bigint, feed_id bigint, polled_at timestamp, status string, n_items int")
    streak, count, want, folds = {}, {}, {}, {}
    for i, f, _, status, n in log:
        streak[f] = streak.get(f, 0) + 1 if status == "error" else 0
        want[i] = streak[f]
        if status == "ok":
            before = count.get(f)
            decayed = before is not None and before >= 4 and n < before * 0.5
            folds[i] = (before, decayed)
            count[f] = before if decayed else n
    assert {r.poll_id: r.error_count for r in state.error_streaks(polls).collect()} == want
    assert {r.poll_id: (r.before, r.decayed) for r in state.scrape_decay(polls).collect()} == folds


def test_short_videos(spark):
    feeds = spark.createDataFrame([(f, f"https://www.youtube.com/feeds/videos.xml?channel_id=UC{f}") for f in range(6)]
                                  + [(9, "https://blog")], "feed_id bigint, feed_url string")
    held = spark.createDataFrame([(f * 1000 + i, f, f"https://www.youtube.com/watch?v=V{f}{i:02}xxxxxxx") for f in range(6) for i in range(41)]
                                 + [(99999, 9, "https://youtu.be/V000xxxxxxx")], "item_id bigint, feed_id bigint, url string")
    work = shorts.unknown_videos(held, feeds, verdicts(spark))
    plan = shorts.probe_plan(work).collect()
    assert len(plan) == 200 and {r.feed_id for r in plan} == set(range(5)) and max(r["rank"] for r in plan) == 40
    assert [r.n for r in shorts.api_batches(work.filter("feed_id = 3"), size=20).orderBy("batch").collect()] == [20, 20, 1]
    answers = spark.createDataFrame([
        ("long", True, 723, None, None), ("short", True, 108, 200, None), ("watch", True, 150, 303, "/watch?v=x"),
        ("limited", True, 150, 429, None), ("wall", True, 60, 302, "/consent"), ("gone", True, None, None, None),
        ("failed", False, None, 200, None), ("edge", True, 195, 200, None), ("over", True, 196, 200, None)],
        "video_id string, answered boolean, seconds int, http_status int, location string")
    keyed = {r.video_id: r.is_short for r in shorts.classify(answers).collect()}
    assert keyed == {"long": 0, "short": 1, "watch": 0, "gone": 0, "edge": 1, "over": 0}
    keyless = {r.video_id: r.is_short for r in shorts.classify(answers, keyed=False).collect()}
    assert keyless == {"short": 1, "watch": 0, "failed": 1, "edge": 1, "over": 1}
    left = shorts.sweep(held, feeds, verdicts(spark, ("V000xxxxxxx", 1), ("V001xxxxxxx", 0)))
    assert held.count() - left.count() == 1 and left.filter("item_id = 99999").count() == 1


def test_actions(spark):
    # item, feed, starting read state and stamp
    held = spark.createDataFrame([(1, 1, 0, 0, T0, None), (2, 1, 1, 0, T0, T0), (3, 1, 0, 1, T0 + dt.timedelta(hours=5), None),
                                  (4, 2, 0, 0, T0, None), (5, 3, 0, 0, T0, None), (6, 4, 0, 0, T0, None)],
                                 "item_id bigint, feed_id bigint, is_read int, is_starred int, fetched_at timestamp, read_at timestamp")
    feeds = spark.createDataFrame([(1, None), (2, "A"), (3, "B"), (4, None)], "feed_id bigint, folder string")
    at = lambda h: T0 + dt.timedelta(hours=h)
    log = spark.createDataFrame([
        (1, at(1), "open", 1, None, None, 1), (2, at(2), "mark-read", 1, None, None, 1),
        (3, at(1), "mark-read", 2, None, None, 0), (4, at(3), "mark-all", None, 1, None, 1),
        (5, at(1), "star", 3, None, None, 0), (6, at(2), "mark-all", None, None, "A", 1),
        (7, at(1), "mark-read", 5, None, None, 1), (8, at(2), "mark-read", 5, None, None, 0)],
        "action_id bigint, ts timestamp, act string, item_id bigint, feed_id bigint, folder string, state int")
    got = {r.item_id: (r.is_read, r.is_starred, r.read_at) for r in actions.apply_actions(held, log, feeds).collect()}
    assert got == {1: (1, 0, at(2)), 2: (1, 0, at(3)), 3: (0, 0, None), 4: (1, 0, at(2)), 5: (0, 0, None), 6: (0, 0, None)}
    everything = log.union(spark.createDataFrame([(9, at(6), "mark-all", None, None, None, 1)], log.schema))
    got = {r.item_id: (r.is_read, r.read_at) for r in actions.apply_actions(held, everything, feeds).collect()}
    assert got == {1: (1, at(2)), 2: (1, at(3)), 3: (1, at(6)), 4: (1, at(2)), 5: (1, at(6)), 6: (1, at(6))}
    merged = actions.merge_state(held, actions.apply_actions(held, log, feeds)).collect()
    assert {r.item_id: (r.feed_id, r.is_read, r.read_at) for r in merged}[4] == (2, 1, at(2)) and len(merged) == 6


def test_folders_and_subscriptions(spark):
    feeds = spark.createDataFrame([(1, "https://a/f", "Á Title", "Café"), (2, "https://b/f", "", None)],
                                  "feed_id bigint, feed_url string, title string, folder string")
    asked = spark.createDataFrame([(1, "cafe", "x"), (2, " New ", None), (3, "", "Tech"), (4, None, None)],
                                  "request_id int, folder_new string, folder string")
    assert {r.request_id: r.folder for r in actions.canonical_folders(asked, feeds).collect()} == {
        1: "Café", 2: "New", 3: "Tech", 4: None}
    adds = spark.createDataFrame([(1, "https://a/f", None, "x", "News"), (2, "https://c/f", None, "C", "News"),
                                  (3, "https://c/f", None, "C2", None), (4, "https://b/f", None, "", "")],
                                 "request_id int, feed_url string, site_url string, title string, folder string")
    assert {r.request_id: r.message for r in actions.add_feeds(adds, feeds).collect()} == {
        1: "Already subscribed: Á Title (in Café). Change its folder from Manage feeds.", 2: "C → News",
        3: "Already subscribed: C (in News). Change its folder from Manage feeds.",
        4: "Already subscribed: https://b/f (ungrouped). Change its folder from Manage feeds."}


def test_subscription_lists(spark):
    files = spark.createDataFrame([("a", """<opml><head><outline xmlUrl="https://head"/></head><body>
      <outline text="News"><outline title="" text="ignored"><outline text="P" xmlUrl="https://p" htmlUrl="https://ps"/></outline>
        <outline text="Parent" xmlUrl="https://q"><outline text="Kid" xmlurl='https://r?a=1&amp;b=2'/></outline></outline>
      <outline text="Top" xmlUrl="ftp://t"/><outline text="Deep"><outline text="Er"><outline text="Est">
        <outline xmlUrl="https://p"/></outline></outline></outline></body></opml>"""), ("b", "<opml><head/></opml>")],
        "doc_id string, xml string")
    listed = opml.opml_feeds(files)
    assert [(r.feed_url, r.title, r.folder) for r in listed.orderBy("pos").collect()] == [
        ("https://p", "P", "News"), ("https://q", "Parent", "News"), ("https://r?a=1&b=2", "Kid", "News"),
        ("ftp://t", "Top", None), ("https://p", "", "Est")]
    known = spark.createDataFrame([("https://q",)], "feed_url string")
    [summary] = opml.import_summary(opml.to_add(listed, known)).collect()
    assert (summary.added, summary.skipped) == (2, 3)


def test_a_repeated_batch_replaces_itself_and_reads_are_pruned(spark, tmp_path):
    path = tmp_path / "t"
    table = Table(spark, str(path), "feed_id bigint, v int", bucket_by="feed_id", buckets=16)
    assert table.read().count() == 0
    rows = spark.range(400).select((F.col("id") % 100).alias("feed_id"), F.col("id").cast("int").alias("v"))
    for batch in ("s-0", "s-0", "s-1"):
        table.put(rows, batch)
    assert table.read().count() == 800 and table.read(without="s-1").count() == 400
    assert len(list(path.glob("bucket=*/batch=s-0/*.parquet"))) <= 16
    one = table.of_keys(spark.createDataFrame([(7,)], "feed_id bigint"), without="s-1")
    assert sorted(r.v for r in one.collect()) == [7, 107, 207, 307]
    assert len({f.split("bucket=")[1].split("/")[0] for f in table.rows().filter(F.col("bucket") == 3).inputFiles()}) >= 1
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_versions_replace_buckets(spark, tmp_path):
    """Reads see the newest version before theirs, an emptied bucket is empty, and what an unfinished version left is written over."""
    from feedloom.sources.tables import Snapshots

    table = Snapshots(spark, f"{tmp_path}/t", "feed_id bigint, v int", "feed_id", 4)
    frame = lambda rows: spark.createDataFrame(rows, "feed_id bigint, v int")
    look = lambda n=None: sorted(map(tuple, table.as_of(n).collect()))
    assert look() == []
    table.replace(frame([(k, 0) for k in range(12)]), [0, 1, 2, 3], 0)
    of = {k: table.asked(frame([(k, 0)]))[0] for k in range(12)}
    gone, kept = of[0], [(k, 0) for k in range(12) if of[k] != of[0]]
    table.replace(frame([(0, 5)]), [gone], 1)
    table.replace(frame([]), [gone], 2)
    assert look(1) == [(k, 0) for k in range(12)] and look(2) == sorted([(0, 5), *kept]) and look() == kept
    # Version 3 breaks off half way, then comes again.
    table.replace(frame([(0, 99)]), [gone], 3)
    assert look(3) == kept
    table.replace(frame([(0, 7)]), [gone], 3)
    assert look() == sorted([(0, 7), *kept])
    table.expire(3)
    assert look(3) == kept and look() == sorted([(0, 7), *kept])
    assert table.rows().filter(F.col("bucket") == gone).select("batch").distinct().count() == 2
