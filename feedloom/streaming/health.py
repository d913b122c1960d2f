"""Feed health kept as stream state, feeds due again after a slowdown, and poll outcomes per cadence window."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.schemas import BACKOFF_MINUTES, ERROR_BACKOFF_THRESHOLD, POLL_INTERVAL_MIN, SCRAPE_DECAY_FLOOR, SCRAPE_DECAY_RATIO

#: What a poll brought, as the health stream takes it.
POLLS = "poll_id bigint, feed_id bigint, polled_at timestamp, status string, n_items int, scraped boolean, etag string, last_modified string"
HEALTH = ("feed_id bigint, poll_id bigint, polled_at timestamp, last_status string, error_count bigint, last_item_count bigint, "
          "etag string, last_modified string, due_at timestamp")
_STATE = "health string, waiting string"
# Times and ids leave as whole numbers and text, so that a missing one changes no column's type on the way.
_OUT = ("feed_id bigint, poll_id string, polled_us bigint, last_status string, error_count bigint, last_item_count bigint, "
        "etag string, last_modified string, due_us bigint")
_NEW = [None, 0, None, None, None, None, None]
_MINUTE = 60_000
_ROWS = 10_000


def _ms(us: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-us // 1000)


def _order(poll: list) -> tuple:
    us, poll_id, status, found, *rest = poll
    return us, poll_id is None, poll_id or 0, status or "", found, [str(v) for v in rest]


def _applied(health: list, poll: list, threshold: int, backoff: int) -> list:
    """A 304 clears the error and keeps the validators; an error, decay included, drops them and counts up."""
    _, errors, count, etag, last_modified, _, _ = health
    us, _, status, found, scraped, new_etag, new_modified = poll
    decayed = status == "ok" and scraped and count is not None and count >= SCRAPE_DECAY_FLOOR and found < count * SCRAPE_DECAY_RATIO
    if status == "error" or decayed:
        status, errors, etag, last_modified = "error", errors + 1, None, None
    else:
        errors = 0
        if status == "ok":
            etag, last_modified, count = new_etag, new_modified, found if scraped else count
    return [status, errors, count, etag, last_modified, us, _ms(us) + backoff if errors >= threshold else None]


def _feed(emit: str, threshold: int, backoff: int, keep: int) -> Callable:
    """Applies a feed's polls in the order of their times, whatever order they arrive in.

    A poll waits in the feed's state until the watermark has passed it; then the waiting ones are applied in order, the time a
    failed feed is due again standing between them, and one timeout is set for whatever comes next: the first poll that still waits,
    that time, or the end of a state not asked for in ``keep``. So a feed costs one call in a batch that brings it polls or passes its
    timeout, however many polls it has, and holds the polls of the watermark's delay and of the batch, in a few dozen bytes each.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        health, waiting = [json.loads(text) for text in state.get] if state.exists else [_NEW, []]
        if not state.hasTimedOut:
            text = lambda v: v if isinstance(v, str) else None
            for frame in frames:
                columns = [frame[c].tolist() for c in ("polled_us", "poll_id", "status", "n_items", "scraped", "etag", "last_modified")]
                waiting += [[us, int(poll) if isinstance(poll, str) else None, text(status), found, scraped, text(etag), text(modified)]
                            for us, poll, status, found, scraped, etag, modified in zip(*columns)]
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=_order)
        out, used = [], 0
        row = lambda poll, due: (key[0], poll, health[5], *health[:5], due)

        def rest_until(at: int) -> None:
            """What happens to the feed up to ``at``, before a poll at that time: it falls due, and its state ends."""
            nonlocal health
            if health[6] is not None and health[6] <= at:
                health = [*health[:6], None]
                if emit == "due":
                    out.append(row(None, health[5] + backoff * 1000))
            if health[5] is not None and _ms(health[5]) + keep < at:
                health = _NEW

        frame_of = lambda: pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")], dtype=object)
        for poll in waiting:
            if _ms(poll[0]) > passed:
                break
            rest_until(_ms(poll[0]))
            health, used = _applied(health, poll, threshold, backoff), used + 1
            if emit == "health":
                out.append(row(None if poll[1] is None else str(poll[1]), None))
            if len(out) >= _ROWS:
                yield frame_of()
                out = []
        rest_until(passed)
        waiting = waiting[used:]
        ends = [_ms(waiting[0][0]) - 1] if waiting else []
        ends += [] if health[6] is None else [health[6] - 1]
        ends += [] if health[5] is None else [_ms(health[5]) + keep]
        if ends:
            state.update((json.dumps(health), json.dumps(waiting)))
            # A timeout goes off once the watermark is behind it.
            state.setTimeoutTimestamp(max(min(ends), passed, 1))
        elif state.exists:
            state.remove()
        if out:
            yield frame_of()

    return step


def _run(polls: DataFrame, emit: str, delay: str, threshold: int, backoff_minutes: int, keep_minutes: int) -> DataFrame:
    if keep_minutes <= backoff_minutes:
        raise ValueError("a feed's state must outlive its slowdown")
    given = polls.withColumns({
        "n_items": F.coalesce("n_items", F.lit(0)), "scraped": F.coalesce("scraped", F.lit(False)), "poll_id": F.col("poll_id").cast("string"),
        "polled_us": F.unix_micros("polled_at")})
    names = [*[c.split()[0] for c in POLLS.split(", ")], "polled_us"]
    slim = given.select(*[F.col(c) if c in given.columns else F.lit(None).cast("string").alias(c) for c in names])
    # One value for each feed, which any state store holds.
    states = slim.filter("polled_at is not null and feed_id is not null").withWatermark("polled_at", delay).groupBy("feed_id").applyInPandasWithState(
        _feed(emit, threshold, backoff_minutes * _MINUTE, keep_minutes * _MINUTE), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return states.select("feed_id", F.col("poll_id").cast("bigint").alias("poll_id"), F.timestamp_micros("polled_us").alias("polled_at"), "last_status",
                         "error_count", "last_item_count", "etag", "last_modified", F.timestamp_micros("due_us").alias("due_at"))


def feed_health(polls: DataFrame, delay: str = "1 hour", threshold: int = ERROR_BACKOFF_THRESHOLD, backoff_minutes: int = BACKOFF_MINUTES,
                keep_minutes: int = 180 * 24 * 60) -> DataFrame:
    """A feed's health after every poll of a stream (``POLLS``; validators may be missing), once ``delay`` has passed."""
    return _run(polls, "health", delay, threshold, backoff_minutes, keep_minutes)


def feeds_due(polls: DataFrame, delay: str = "1 hour", threshold: int = ERROR_BACKOFF_THRESHOLD, backoff_minutes: int = BACKOFF_MINUTES,
              keep_minutes: int = 180 * 24 * 60) -> DataFrame:
    """One row (``due_at`` set) whenever a feed slowed by ``threshold`` failures in a row has gone ``backoff_minutes`` without a poll."""
    return _run(polls, "due", delay, threshold, backoff_minutes, keep_minutes)


def poll_windows(polls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Outcomes per cadence window of a poll stream; a window is final once ``delay`` has passed."""
    window = F.window("polled_at", f"{POLL_INTERVAL_MIN} minutes").alias("w")
    return (polls.withWatermark("polled_at", delay).groupBy(window).agg(
        F.count(F.lit(1)).alias("polls"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "not-modified").alias("not_modified"),
        F.count_if(F.col("status") == "error").alias("errored"))
        .select(F.col("w.start").alias("window_start"), "polls", "ok", "not_modified", "errored"))
