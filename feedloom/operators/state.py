"""Feed health: the state after a poll, failure streaks, scrape decay, run statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedloom.functions.text import let
from feedloom.schemas import POLL_INTERVAL_MIN, RUNS, SCRAPE_DECAY_FLOOR, SCRAPE_DECAY_RATIO
from feedloom.session import stored


def is_decayed(kind: Column, before: Column, found: Column) -> Column:
    """A scrape that found under half of what it last found, where that was enough to judge by."""
    return F.coalesce((kind == "scrape") & (before >= SCRAPE_DECAY_FLOOR) & (found < before * SCRAPE_DECAY_RATIO),
                      F.lit(False))


def judged(feeds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes next to their feed's kind and last count, with ``decayed`` settled."""
    known = feeds.select("feed_id", F.col("kind"), F.col("last_item_count").alias("before"))
    decayed = (F.col("status") == "ok") & is_decayed(F.col("kind"), F.col("before"), F.col("n_items"))
    return outcomes.join(known, "feed_id").withColumn("decayed", decayed)


def latest(outcomes: DataFrame) -> DataFrame:
    """One outcome per feed: the one fetched last, or the greatest ``fetch_id`` where no time is known."""
    order = [c for c in ("fetched_at", "fetch_id") if c in outcomes.columns] or ["status"]
    return outcomes.groupBy("feed_id").agg(F.max_by(F.struct(*outcomes.columns), F.struct(*order)).alias("_o")).select("_o.*")


def next_feed_state(feeds: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The feed table after one poll; feeds without an outcome stay as they are, and of several the last counts.

    A 304 clears the error and keeps the validators. Any error, decay included, drops them and counts up. The title
    is adopted while empty, the site only while missing, the item count only from a healthy scrape.
    """
    polled = judged(feeds, latest(outcomes)).select(
        "feed_id", F.lit(True).alias("polled"), "status", "error", "decayed", "n_items", "before",
        *[F.col(c).alias(f"new_{c}") for c in ("etag", "last_modified", "feed_title", "site_url")])
    same, failed = F.col("status") == "not-modified", (F.col("status") == "error") | F.col("decayed")
    healthy = (F.col("status") == "ok") & ~F.col("decayed")
    ok = F.col("status") == "ok"
    decay_text = F.concat(F.lit("The scrape rule now matches "), F.col("n_items").cast("string"), F.lit(" of the "),
                          F.col("before").cast("string"), F.lit(" items it last found; check the page's markup."))
    empty_title = F.coalesce(F.col("title"), F.lit("")) == ""
    changed = {
        "etag": F.when(same, F.col("etag")).when(healthy, F.col("new_etag")),
        "last_modified": F.when(same, F.col("last_modified")).when(healthy, F.col("new_last_modified")),
        "last_polled_at": now,
        "last_status": F.when(failed, "error").otherwise(F.col("status")),
        "last_error": F.when(F.col("decayed"), decay_text)
        .when(failed, F.coalesce(F.col("error"), F.lit("unknown error"))),
        "error_count": F.when(failed, F.col("error_count") + 1).otherwise(0),
        "title": F.when(ok & empty_title & (F.col("new_feed_title") != ""), F.col("new_feed_title"))
        .otherwise(F.col("title")),
        "site_url": F.when(ok, F.coalesce(F.col("site_url"), F.col("new_site_url"))).otherwise(F.col("site_url")),
        "last_item_count": F.when(healthy & (F.col("kind") == "scrape"), F.col("n_items"))
        .otherwise(F.col("last_item_count")),
    }
    merged = feeds.join(polled, "feed_id", "left")
    return merged.select(*[
        F.when(F.col("polled"), changed[c]).otherwise(F.col(c)).cast(feeds.schema[c].dataType).alias(c)
        if c in changed else F.col(c) for c in feeds.columns])


def run_stats(judged_outcomes: DataFrame, inserted: Column, swept: Column, unclassified: Column) -> DataFrame:
    """One row of tallies. A decayed scrape counts as errored."""
    failed = (F.col("status") == "error") | F.col("decayed")
    tallies = judged_outcomes.agg(
        F.count(F.lit(1)).alias("feeds"), F.count_if((F.col("status") == "ok") & ~failed).alias("ok"),
        F.count_if(F.col("status") == "not-modified").alias("not_modified"), F.count_if(failed).alias("errored"))
    note = F.when(unclassified > 0, F.concat(
        unclassified.cast("string"), F.lit(" YouTube video(s) still unclassified, carried to the next poll")))
    return tallies.select("*", inserted.alias("inserted"), swept.alias("shorts_swept"),
                          unclassified.alias("unclassified"), note.alias("note"))


def run_record(stats: DataFrame, run_id: int, trigger: str, started: Column, finished: Column) -> DataFrame:
    """A row of the run log: the tallies with the run's id, trigger, times and duration."""
    given = {"run_id": F.lit(run_id).cast("bigint"), "started_at": started, "finished_at": finished, "trigger": F.lit(trigger),
             "duration_ms": F.unix_millis(finished) - F.unix_millis(started)}
    columns = [part.split() for part in RUNS.split(", ")]
    return stats.withColumns(given).select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


def failed_run(spark: SparkSession, run_id: int, trigger: str, started: Column, finished: Column, error: str) -> DataFrame:
    """The row of a run that ended early: no tallies, and the error as its note."""
    zero = ("feeds", "ok", "not_modified", "errored", "inserted", "shorts_swept", "unclassified")
    stats = spark.range(1).select(*[F.lit(0).alias(c) for c in zero], F.lit(f"Run failed: {error}").alias("note"))
    return run_record(stats, run_id, trigger, started, finished)


def poll_windows(polls: DataFrame) -> DataFrame:
    """Poll outcomes per cadence window."""
    return (polls.groupBy(F.window("polled_at", f"{POLL_INTERVAL_MIN} minutes").alias("w"))
            .agg(F.count(F.lit(1)).alias("polls"), F.count_if(F.col("status") == "ok").alias("ok"),
                 F.count_if(F.col("status") == "not-modified").alias("not_modified"),
                 F.count_if(F.col("status") == "error").alias("errored"))
            .select(F.col("w.start").alias("window_start"), "polls", "ok", "not_modified", "errored"))


def error_streaks(polls: DataFrame, chunk: str = "day") -> DataFrame:
    """The consecutive-failure count after every poll.

    Polls are numbered inside (feed, day), and a second window over one row per (feed, day) carries open streaks
    across days, so a feed with a third of the log is spread over its days.
    """
    order = ["polled_at", "poll_id"]
    good = F.col("status") != "error"
    inside = Window.partitionBy("feed_id", "_chunk").orderBy(*order)
    numbered = (
        polls.withColumn("_chunk", F.date_trunc(chunk, "polled_at"))
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_good_at", F.max(F.when(good, F.col("_n"))).over(inside)))
    sums = numbered.groupBy("feed_id", "_chunk").agg(F.count(F.lit(1)).alias("_rows"), F.max("_good_at").alias("_last"))
    upto = Window.partitionBy("feed_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("feed_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # _total counts polls up to and with the day, _mark the polls up to and with the last good one.
    carried = (
        sums.withColumn("_total", F.sum("_rows").over(upto))
        .withColumn("_mark", F.when(F.col("_last").isNotNull(), F.col("_total") - F.col("_rows") + F.col("_last")))
        .withColumn("_carry", zero(F.max("_total").over(before)) - zero(F.max("_mark").over(before))))
    streak = F.col("_n") - zero(F.col("_good_at")) + F.when(F.col("_good_at").isNull(), F.col("_carry")).otherwise(0)
    return numbered.join(carried.select("feed_id", "_chunk", "_carry"), ["feed_id", "_chunk"]).select(
        "poll_id", "feed_id", "status", F.when(good, 0).otherwise(streak).cast("bigint").alias("error_count"))


# The last healthy count is a fold: a poll either keeps the count before it (decay) or replaces it. Seen as a function
# of the count before, one poll finding n keeps counts above max(2n, 3) and maps the rest to n. Chaining such functions
# gives a step function with the identity on top; the steps left standing more than double each time, so any run of polls
# shrinks to a few dozen numbers. Runs chain to greater runs, and starting counts are handed back down to the polls.

_STEPS = "array<struct<upper:bigint,value:bigint>>"
_RUN = 256


def _after(steps: Column, count: Column) -> Column:
    """The count after ``steps``, (upper bound of the count before, count after) ascending; -1 stands for none yet."""
    return F.coalesce(F.get(F.filter(steps, lambda s: count <= s["upper"]), F.lit(0))["value"], count)


def _top(steps: Column) -> Column:
    return F.coalesce(F.get(steps, F.size(steps) - 1)["upper"], F.lit(-2).cast("bigint"))


def _merged(steps: Column) -> Column:
    """Of neighbours with one value the upper one stands for both."""
    return let(steps, lambda c: F.filter(
        c, lambda s, i: (i + 1 == F.size(c)) | (F.get(c, i + 1)["value"] != s["value"])))


def _joined(first: Column, then: Column) -> Column:
    """``first``, then ``then``, as one list of steps."""
    mapped = F.transform(first, lambda s: F.struct(s["upper"].alias("upper"), _after(then, s["value"]).alias("value")))
    return _merged(F.concat(mapped, F.filter(then, lambda s: s["upper"] > _top(first))))


def _folded(parts: Column) -> Column:
    """A list of step lists as one."""
    return F.aggregate(parts, F.array().cast(_STEPS), _joined)


def _starts(parts: Column, start: Column) -> Column:
    """The count before each of a list of step lists (and, last, the one after all)."""
    return F.aggregate(parts, F.array(start), lambda seen, p: F.concat(seen, F.array(_after(p, F.element_at(seen, -1)))))


def _polled(polls: Column) -> Column:
    """A poll's count and the greatest count before it that it replaces."""
    return F.transform(polls, lambda p: F.struct(p["n_items"].cast("bigint").alias("value"), F.greatest(
        F.floor(p["n_items"] / SCRAPE_DECAY_RATIO), F.lit(SCRAPE_DECAY_FLOOR - 1)).cast("bigint").alias("upper")))


def _run_steps(polls: Column) -> Column:
    """The steps of a run of polls, one after the other."""
    def chain(steps: Column, p: Column) -> Column:
        mapped = F.transform(steps, lambda s: F.struct(
            s["upper"].alias("upper"), F.when(s["value"] > p["upper"], s["value"]).otherwise(p["value"]).alias("value")))
        more = F.when(_top(steps) < p["upper"], F.array(F.struct(p["upper"].alias("upper"), p["value"].alias("value"))))
        return _merged(F.concat(mapped, F.coalesce(more, F.array().cast(_STEPS))))
    return F.aggregate(_polled(polls), F.array().cast(_STEPS), chain)


def _run_counts(polls: Column, start: Column) -> Column:
    """The count before each poll of a run, and the one after it."""
    return F.aggregate(_polled(polls), F.array(start), lambda seen, p: let(F.element_at(seen, -1), lambda c: F.concat(
        seen, F.array(F.when(c > p["upper"], c).otherwise(p["value"])))))


def _with_start(runs: DataFrame, levels: int = 2) -> DataFrame:
    """``feed_id, run, start`` for ``feed_id, run, steps``, runs numbered from 0 in time order.

    256 neighbours make a run of the next level, whose start is settled first. A feed's last list holds one entry for
    each 65,536 runs.
    """
    into = F.floor(F.col("run") / _RUN) if levels else F.lit(0).cast("bigint")
    lists = runs.groupBy("feed_id", into.alias("up")).agg(F.array_sort(F.collect_list(F.struct("run", "steps"))).alias("parts"))
    if levels:
        whole = lists.select("feed_id", F.col("up").alias("run"), _folded(F.col("parts.steps")).alias("steps"))
        above = _with_start(whole, levels - 1).withColumnsRenamed({"run": "up", "start": "begin"})
        lists = lists.join(above, ["feed_id", "up"])
    else:
        lists = lists.withColumn("begin", F.lit(-1).cast("bigint"))
    each = lists.select("feed_id", F.explode(F.arrays_zip(F.col("parts.run").alias("run"), F.slice(
        _starts(F.col("parts.steps"), F.col("begin")), F.lit(1), F.size("parts")).alias("start"))).alias("r"))
    return each.select("feed_id", "r.run", "r.start")


def scrape_decay(polls: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """Every answered scrape poll with the last healthy count before it and whether it had decayed.

    Polls are numbered inside (feed, day) and cut into runs of at most 256, so no feed or day is held as a group; a
    window over the feeds' runs numbers these. Polls without a count are left out.
    """
    answered = polls.filter("status = 'ok' and n_items is not null").select(
        "poll_id", "feed_id", "polled_at", "n_items",
        F.floor(F.unix_seconds("polled_at") / chunk_seconds).alias("day"))
    within = Window.partitionBy("feed_id", "day").orderBy("polled_at", "poll_id")
    cut = answered.withColumn("part", F.floor((F.row_number().over(within) - 1) / _RUN))
    held = cut.groupBy("feed_id", "day", "part").agg(
        F.array_sort(F.collect_list(F.struct("polled_at", "poll_id", "n_items"))).alias("polls"))
    in_time = Window.partitionBy("feed_id").orderBy("day", "part")
    # Written once: every level above and the way back down read it.
    runs = stored(held.withColumn("steps", _run_steps(F.col("polls"))))
    numbered = runs.select("feed_id", "day", "part", "steps", (F.row_number().over(in_time) - 1).cast("bigint").alias("run"))
    starts = numbered.select("feed_id", "day", "part", "run").join(_with_start(
        numbered.select("feed_id", "run", "steps")), ["feed_id", "run"]).select("feed_id", "day", "part", "start")
    before = _run_counts(F.col("polls"), F.col("start"))
    rows = runs.drop("steps").join(starts, ["feed_id", "day", "part"]).select("feed_id", F.inline(F.arrays_zip(
        F.col("polls.poll_id").alias("poll_id"), F.col("polls.n_items").alias("n_items"),
        F.slice(before, F.lit(1), F.size("polls")).alias("before"))))
    decayed = (F.col("before") >= SCRAPE_DECAY_FLOOR) & (F.col("n_items") < F.col("before") * SCRAPE_DECAY_RATIO)
    return rows.select("poll_id", "feed_id", "n_items", F.when(F.col("before") >= 0, F.col("before")).alias("before"),
                       decayed.alias("decayed"))
