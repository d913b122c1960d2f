"""Dates and clocks. ``now`` is always an argument; the session time zone is UTC."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions.text import let
from feedloom.schemas import POLL_INTERVAL_MIN

_TIME = r"(?:[,\sT]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3})\d*)?)?(?:\s*([ap]m))?)?"
_ZONE = r"\s*(?:(?:UTC|GMT)(?=[+-]))?(Z|UTC?|GMT|[ECMP][SD]T|[+-]\d{2}:?\d{2})?(?:\s*\([^)]*\))?$"
_DAY = r"(?i)^(?:[a-z]{3,9}\.?,?\s+)?"
# Day first (RFC 822), month first, month/day/year, ISO. Groups 4-9 are hour, minute, second, fraction, half, zone in all.
_RFC = _DAY + r"(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?,?[\s-]+(\d{4}|\d{2})" + _TIME + _ZONE
_US = _DAY + r"([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})" + _TIME + _ZONE
_SLASH = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME + _ZONE
_ISO = r"(?i)^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?" + _TIME + _ZONE

# Zone names of RFC 822 and month names.
_ZONES = {"Z": "Z", "UT": "Z", "UTC": "Z", "GMT": "Z", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00",
          "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _month(name: Column) -> Column:
    return _lookup({m.lower(): str(i) for i, m in enumerate(_MONTHS, 1)}, F.lower(F.left(name, F.lit(3))))


def _assemble(s: Column, pattern: str, year: Column, month: Column, day: Column) -> Column:
    def part(g: int, default: str) -> Column:
        found = F.regexp_extract(s, pattern, g)
        return F.when(found == "", default).otherwise(found)

    zone, half = F.upper(part(9, "Z")), F.lower(part(8, ""))
    given = part(4, "0").try_cast("int")
    clock = given % 12 + F.when(half == "pm", 12).otherwise(0)
    hour = F.when(half == "", given).when(given.between(1, 12), clock).cast("string")
    offset = F.coalesce(_lookup(_ZONES, zone), F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    two = lambda c: F.lpad(c, 2, "0")
    iso = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"),
                   part(5, "00"), F.lit(":"), part(6, "00"), F.lit("."), F.rpad(part(7, "0"), 3, "0"), offset)
    return F.when(s.rlike(pattern), iso.try_cast("timestamp"))


def parse_date(c: Column) -> Column:
    """RFC 822, month-first (``Jan 5, 2024``, ``1/5/2024``) or ISO text, with a 24-hour or AM/PM clock, to a timestamp in whole milliseconds, else null."""
    return let(F.trim(c), _parse_date)


def _parse_date(s: Column) -> Column:
    group = lambda pattern, g: F.regexp_extract(s, pattern, g)
    first = lambda v: F.when(v == "", "1").otherwise(v)
    year = group(_RFC, 3)
    century = F.when(F.length(year) == 4, "").when(year.try_cast("int") < 50, "20").otherwise("19")
    return F.coalesce(
        _assemble(s, _ISO, group(_ISO, 1), first(group(_ISO, 2)), first(group(_ISO, 3))),
        _assemble(s, _RFC, F.concat(century, year), _month(group(_RFC, 2)), group(_RFC, 1)),
        _assemble(s, _US, group(_US, 3), _month(group(_US, 1)), group(_US, 2)),
        _assemble(s, _SLASH, group(_SLASH, 3), group(_SLASH, 1), group(_SLASH, 2)),
    )


def publication_day(text: Column) -> Column:
    """The UTC day of a date text, or the text itself where it is no date."""
    return F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), text)


def _round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def relative_date(ts: Column, now: Column) -> Column:
    """``now`` / ``5m`` / ``3h`` / ``2d`` within a week, else ``7 Jan``; empty for null."""
    minutes = _round_half_up((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    hours = _round_half_up(minutes / 60)
    days = _round_half_up(hours / 24)
    unit = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    return (
        F.when(ts.isNull(), "")
        .when(minutes < 1, "now")
        .when(minutes < 60, unit(minutes, "m"))
        .when(hours < 24, unit(hours, "h"))
        .when(days < 7, unit(days, "d"))
        .otherwise(F.date_format(ts, "d MMM"))
    )


def masthead_date(now: Column) -> Column:
    return F.upper(F.date_format(now, "d MMM yyyy"))


def ago(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    s = lambda n: n.cast("string")
    return (
        F.when(seconds < 60, F.concat(s(F.greatest(F.lit(0).cast("bigint"), _round_half_up(seconds))), F.lit("s")))
        .when(minutes < 60, F.concat(s(minutes), F.lit("m")))
        .when(hours < 6, F.concat(s(hours), F.lit("h "), s(minutes % 60), F.lit("m")))
        .when(hours < 24, F.concat(s(hours), F.lit("h")))
        .otherwise(F.concat(s(F.floor(hours / 24)), F.lit("d")))
    )


def countdown(seconds: Column) -> Column:
    n = F.greatest(F.lit(0).cast("bigint"), _round_half_up(seconds))
    return F.concat(F.floor(n / 60).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))


def seconds_to_next_poll(now: Column) -> Column:
    """Seconds to the next wall-clock poll; a boundary under five seconds away is skipped."""
    step = POLL_INTERVAL_MIN * 60_000
    ms = F.unix_millis(now)
    left = F.ceil(ms / step) * step - ms
    return _round_half_up(F.when(left < 5000, left + step).otherwise(left) / 1000)


def duration_seconds(c: Column) -> Column:
    """``PT#H#M#S`` to seconds; 0 for anything else."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda g: F.coalesce(F.regexp_extract(c, pattern, g).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(c.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.lit(0).cast("bigint"))
