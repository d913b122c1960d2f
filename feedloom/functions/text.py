"""Text columns: escaping, entity decoding, tag stripping, excerpts, reading blocks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from feedloom.schemas import EXCERPT_LENGTH

# The whitespace class of ECMAScript, wider than Java's \s.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

# The named references the page scraper knows.
NAMED = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "hellip": "…", "middot": "·", "eacute": "é",
}


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit every length cap is stated in."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_left(c: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; a pair cut in half leaves U+FFFD, as storing it would."""
    units = F.encode(c, "UTF-16BE")
    cut_pair = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    head = lambda k: F.decode(F.substring(units, 1, 2 * k), "UTF-16BE")
    return (
        F.when(F.length(c) * 2 <= n, c)
        .when(utf16_length(c) <= n, c)
        .when(cut_pair, F.concat(head(n - 1), F.lit("�")))
        .otherwise(head(n))
    )


# The predefined entities, and the patterns by which a reader's text and a page's title are told.
PREDEFINED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_ANCHOR = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?(https?://[^"'\s>]+)["']?[^>]*>([\s\S]*?)</a>"""
_UNREAD = r"(?i)<(script|style)[\s\S]*?</\1>"
_BLOCK_END = "(?i)</(p|div|h[1-6]|li|blockquote|section|article|tr)>"
_LINE_END = r"(?i)<br\s*/?>"
_TAG = "<[^>]+>"
_TITLE = r"(?i)<title[^>]*>([\s\S]{count})</title>"


def esc(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; without it a nested expression is repeated wherever it is used."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def splice(c: Column, pattern: str, render: Callable[[Column, Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``render(match, ordinal)``, in one pass over the text."""
    def weave(x: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), render)
        woven = F.zip_with(F.split(x, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
        return F.when(x.rlike(pattern), F.array_join(woven, "")).otherwise(x)

    return let(c, weave)


def _code_point(digits: Column, base: int, invalid: Column) -> Column:
    """Character for a numeric reference; ``invalid`` past the end of Unicode."""
    bare = F.regexp_replace(digits, "^0+", "")
    n = F.conv(F.when(F.length(bare) > 9, "0").when(bare == "", "0").otherwise(bare), base, 10).cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((F.length(bare) > 9) | (n > 0x10FFFF), invalid)
        .when(n.between(0xD800, 0xDFFF), F.lit("�"))
        .otherwise(char)
    )


def _numeric(c: Column, keep_invalid: bool) -> Column:
    bad = (lambda m: m) if keep_invalid else (lambda m: F.lit(""))
    hexed = splice(c, "(?i)&#x[0-9a-f]+;",
                   lambda m, _: _code_point(F.regexp_extract(m, "(?i)&#x([0-9a-f]+);", 1), 16, bad(m)))
    return splice(hexed, "&#[0-9]+;", lambda m, _: _code_point(F.regexp_extract(m, "&#([0-9]+);", 1), 10, bad(m)))


def decode_entities(c: Column) -> Column:
    """Reader's decoder: no-break space first, ``&amp;`` last, a bad reference vanishes."""
    def decode(x: Column) -> Column:
        out = _numeric(F.regexp_replace(x, "(?i)&nbsp;", " "), keep_invalid=False)
        for pattern, char in (("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            out = F.regexp_replace(out, f"(?i){pattern}", char)
        return F.when(x.contains("&"), out).otherwise(x)

    return let(c, decode)


def decode_page_entities(c: Column) -> Column:
    """Scraper's decoder: fifteen names, a bad reference stays as text."""
    table = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    name = lambda m: F.lower(F.regexp_extract(m, "(?i)&([a-z]+);", 1))
    named = lambda x: splice(x, "(?i)&[a-z]+;", lambda m, _: F.coalesce(F.try_element_at(table, name(m)), m))
    return let(c, lambda x: F.when(x.contains("&"), named(_numeric(x, keep_invalid=True))).otherwise(x))


def decode_href(c: Column) -> Column:
    """The five predefined characters inside an attribute, by name or by number, in one pass; other references stay."""
    spelt = {ref: char for name, char in PREDEFINED.items() for ref in (f"&{name};", f"&#{ord(char)};", f"&#x{ord(char):x};")}
    table = F.create_map(*[F.lit(x) for pair in spelt.items() for x in pair])
    return splice(c, "&#?[A-Za-z0-9]+;", lambda m, _: F.coalesce(F.try_element_at(table, F.lower(m)), m))


def strip_tags(c: Column) -> Column:
    """Feed HTML to one line of plain text."""
    bare = F.regexp_replace(c, _UNREAD, " ")
    return squeeze(decode_entities(F.regexp_replace(bare, _TAG, " ")))


def excerpt(c: Column, n: int = EXCERPT_LENGTH) -> Column:
    return let(strip_tags(c), lambda text: F.when(
        utf16_length(text) > n, F.concat(F.rtrim(utf16_left(text, n)), F.lit("…"))).otherwise(text))


def reading_links(c: Column) -> Column:
    """Safe links of a body in order: ``array<struct<url,text>>``."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(_ANCHOR), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, _ANCHOR, 1).alias("url"),
                           strip_tags(F.regexp_extract(m, _ANCHOR, 2)).alias("text")),
    )


def reading_paragraphs(c: Column) -> Column:
    """Body as an array of paragraphs; the n-th safe link stands as NUL n NUL inside its paragraph."""
    nul = F.lit("\u0000")
    out = splice(c, _ANCHOR, lambda _, i: F.concat(nul, i.cast("string"), nul))
    out = F.regexp_replace(out, _UNREAD, " ")
    out = F.regexp_replace(out, _BLOCK_END, "\n\n")
    out = F.regexp_replace(out, _LINE_END, "\n")
    out = decode_entities(F.regexp_replace(out, _TAG, " "))
    inline_ws = WS.replace("\\n", "")

    def tidy(p: Column) -> Column:
        return js_trim(F.regexp_replace(F.regexp_replace(p, f"[{inline_ws}]+", " "), " *\n *", "\n"))

    return F.filter(F.transform(F.split(out, "\n{2,}", -1), tidy), lambda p: p != "")


def page_title(html: Column, longest: int | None = None) -> Column:
    """The page's title; with ``longest`` a longer one counts as none."""
    count = "*?" if longest is None else f"{{0,{longest}}}?"
    raw = F.regexp_extract(html, _TITLE.replace("{count}", count), 1)
    return blank_to_null(squeeze(decode_page_entities(raw)))
