"""Item identity: the feed's own id, else the link, else a hash of title and publication day."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.functions.dates import publication_day


def hash_guid(*parts: Column) -> Column:
    """``h:`` and the 32-bit djb2 hash over the UTF-16 units of the parts joined by a bar."""
    step = lambda h, unit: (h * 33 + unit).bitwiseAND(F.lit(0xFFFFFFFF))

    def fold(h: Column, char: Column) -> Column:
        cp = F.ascii(char).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(cp > 0xFFFF, step(step(h, high), low)).otherwise(step(h, cp))

    chars = F.filter(F.split(F.concat_ws("|", *parts), ""), lambda c: c != "")
    return F.concat(F.lit("h:"), F.lower(F.hex(F.aggregate(chars, F.lit(5381).cast("bigint"), fold))))


def item_guid(raw: Column, link: Column, channel_link: Column, title: Column, when: Column) -> Column:
    """Arguments are non-null texts; a link equal to the channel's own link identifies nothing."""
    return (F.when(raw != "", raw)
            .when((link != "") & (link != channel_link), link)
            .otherwise(hash_guid(title, publication_day(when))))
