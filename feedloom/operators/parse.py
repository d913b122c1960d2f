"""Feed bodies to items: RSS 2.0, Atom, RSS 1.0 and JSON Feed in one scan of the body column."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from feedloom.functions.dates import parse_date
from feedloom.functions.identity import hash_guid, item_guid
from feedloom.functions.text import WS, blank_to_null
from feedloom.session import bound_batches

_T = "array<struct<_VALUE:string>>"
_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"

# The fields read from each format. Every field is an array, since any element may repeat.
_RSS = f"""channel struct<title:{_T},link:{_T},item:array<struct<title:{_T},link:{_T},`atom:link`:{_LINK},guid:{_T},
 `dc:creator`:{_T},author:{_T},description:{_T},`content:encoded`:{_T},pubDate:{_T},`dc:date`:{_T}>>>"""
_ATOM = f"""title {_T}, link {_LINK}, entry array<struct<id:{_T},title:{_T},link:{_LINK},updated:{_T},published:{_T},
 author:array<struct<name:{_T}>>,summary:{_T},content:{_T},
 `media:group`:array<struct<`media:title`:{_T},`media:description`:{_T}>>>>"""
_RDF = f"""channel array<struct<title:{_T},link:{_T}>>, item array<struct<`_rdf:about`:string,title:{_T},link:{_T},
 `dc:creator`:{_T},description:{_T},`content:encoded`:{_T},`dc:date`:{_T}>>"""
_JSON = "title variant, home_page_url variant, author variant, items variant, _corrupt_record string"
_ENTRY = ("raw_id string, link string, title string, author string, summary string, content string, id_when string, "
          "pub_when string")

# References outside XML's own five that a feed may use undeclared.
_UNDECLARED = {"nbsp": " ", "cent": "¢", "pound": "£", "yen": "¥", "euro": "€", "copy": "©", "reg": "®", "inr": "₹"}
_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>"
                     r"""|</?[A-Za-z_](?:[^<>"']|"[^"]*"|'[^']*')*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([A-Za-z_][\w:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


#: Characters that declared entities may add to one body.
EXPANSION = 1 << 20
_SUBSET = re.compile(r"""<!DOCTYPE[^>\[]*\[((?:"[^"]*"|'[^']*'|<!--.*?-->|[^\]"'])*)\]""", re.S | re.I)
_ENTITY = re.compile(r"""<!ENTITY\s+([A-Za-z_][\w:.-]*)\s+(?:"([^"]*)"|'([^']*)')\s*>""")
_OPAQUE = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", re.S)
_REFERENCE = re.compile(r"&([A-Za-z_][\w:.-]*);")
_NUMBER = re.compile(r"&#(?:x([0-9a-fA-F]{1,6})|(\d{1,7}));")


class _Entities:
    """The entities of a document's own subset. Those of other files and of the subset itself (``%name;``) are not read."""

    def __init__(self, subset: str):
        self.raw, self.whole, self.left = {}, {}, EXPANSION
        for name, a, b in _ENTITY.findall(re.sub(r"<!--.*?-->", "", subset, flags=re.S)):
            # The first declaration binds; numbers in a value are read where it is declared.
            self.raw.setdefault(name, _NUMBER.sub(lambda m: chr(min(int(m[1], 16) if m[1] else int(m[2]), 0x10FFFF)), a or b))

    def value(self, name: str, inside: tuple[str, ...]) -> str:
        if name in inside:
            raise ValueError(f"entity {name} holds itself")
        if name not in self.whole:
            self.whole[name] = self.fill(self.raw[name], (*inside, name))
        return self.whole[name]

    def fill(self, text: str, inside: tuple[str, ...] = ()) -> str:
        """The text with its references replaced; more than ``EXPANSION`` characters from entities are an error."""
        out, at, added = [], 0, 0
        for m in _REFERENCE.finditer(text):
            if m[1] in self.raw:
                out += text[at:m.start()], self.value(m[1], inside)
                at, added = m.end(), added + len(out[-1])
                if added > EXPANSION:
                    raise ValueError("entities too large")
        return "".join([*out, text[at:]])

    def body(self, body: str, begin: int) -> str:
        """The document with the references behind ``begin`` replaced, but for sections that hold none."""
        out, at, size = [body[:begin]], begin, 0
        for m in [*_OPAQUE.finditer(body, begin), None]:
            part = body[at:m.start() if m else len(body)]
            out.append(self.fill(part))
            size += len(out[-1]) - len(part)
            if size > EXPANSION:
                raise ValueError("entities too large")
            if m:
                out.append(m[0])
                at = m.end()
        return "".join(out)


def _mend_text(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    text = re.sub(r"&(\w+);", lambda m: _UNDECLARED.get(m[1], m[0]), text)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;", text)
    return text.replace("<", "&lt;")


def _mend(body: str | None) -> str | None:
    """A well-formed document out of a broken one: declared entities put in, other references spelt out, open elements closed,
    stray close tags dropped. Null where a CDATA section, comment or instruction never ends, and where an entity holds itself
    or entities grow beyond bounds."""
    if body is not None and (subset := _SUBSET.search(body)):
        try:
            body = _Entities(subset[1]).body(body[:subset.start(1)] + body[subset.end(1):], subset.start(1))
        except (ValueError, RecursionError):
            return None
    if body is None or re.search(r"<!\[CDATA\[|<!--|<\?", _MARKUP.sub("", body)):
        return None
    out, open_tags, at = [], [], 0
    for m in _MARKUP.finditer(body):
        if open_tags:
            out.append(_mend_text(body[at:m.start()]))
        at, token = m.end(), m[0]
        if token.startswith("<![CDATA["):
            out.append(token if open_tags else "")
        elif token.startswith("</"):
            name = token[2:-1].strip()
            while name in open_tags:
                last = open_tags.pop()
                out.append(f"</{last}>")
                if last == name:
                    break
            if out and not open_tags:
                return "".join(out)
        elif token[1] not in "!?":
            name = re.match(r"[\w:.-]+", token[1:])[0]
            attrs = dict(reversed(_ATTRIBUTE.findall(token[1 + len(name):])))
            out.append("<" + name + "".join(f' {k}="{_mend_text(v.strip(chr(34) + chr(39))).replace(chr(34), "&quot;")}"'
                                            for k, v in attrs.items()))
            closed = token.endswith("/>")
            out.append("/>" if closed else ">")
            if not closed:
                open_tags.append(name)
    if open_tags:
        out.append(_mend_text(body[at:]))
    return "".join(out) + "".join(f"</{t}>" for t in reversed(open_tags)) or None


@pandas_udf(StringType())
def mend_xml(body: pd.Series) -> pd.Series:
    return body.map(_mend, na_action="ignore").astype(object)


# Marked so that filters on the entries stay above the parse, which would otherwise run once more inside the filter.
mend_xml_udf = mend_xml.asNondeterministic()


# Entry mappings are SQL texts: they are built once and parsed by Spark, not assembled call by call.

def _text(field: str) -> str:
    """The text of an element that occurs once; a repeated or absent one has none."""
    return f"coalesce(if(size({field}) = 1, get({field}, 0)._VALUE, null), '')"


def _either(*texts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({t}, '')" for t in texts) + ", '')"


def _link(links: str) -> str:
    """The alternate link (a link without ``rel`` counts as one), else the first; a link without attributes is its text."""
    chosen = f"coalesce(get(filter({links}, l -> coalesce(l._rel, 'alternate') = 'alternate'), 0), get({links}, 0))"
    return f"coalesce({chosen}._href, if({chosen}._rel is null, {chosen}._VALUE, null), '')"


def _once(field: str) -> str:
    return f"if(size({field}) = 1, get({field}, 0), null)"


def _entries(source: str, **fields: str) -> str:
    """The entries of a format: ``source`` is its list, ``i`` stands for one element of it."""
    pairs = ", ".join(f"'{name}', {fields[name]}" for name in _FIELDS)
    return f"transform({source}, i -> named_struct({pairs}))"


_FIELDS = [part.split()[0] for part in _ENTRY.split(", ")]
_GROUP = f"{_once('i.`media:group`')}"


def _json_text(value: str, path: str = "$") -> str:
    """A text of a JSON feed. A field of another kind than the format asks for has none; numbers are spelt out."""
    kind = f"schema_of_variant(try_variant_get({value}, '{path}', 'variant'))"
    return f"if({kind} in ('OBJECT<>', 'VOID') or {kind} like 'OBJECT%' or {kind} like 'ARRAY%', null, try_variant_get({value}, '{path}', 'string'))"


_JSON_URL = f"coalesce({_json_text('i', '$.url')}, {_json_text('i', '$.external_url')})"
# A lone object stands for a list of one.
_JSON_ITEMS = "if(schema_of_variant(_json.items) like 'OBJECT%', array(_json.items), try_variant_get(_json.items, '$', 'array<variant>'))"

# What each format's entries, title and link are read from.
_READ = {
    "rss": (
        _entries("_rss.channel.item", raw_id=_text("i.guid"), link=_either(_text("i.link"), _link("i.`atom:link`")),
                 title=_text("i.title"), author=_either(_text("i.`dc:creator`"), _text("i.author")),
                 summary=_text("i.description"), content=_text("i.`content:encoded`"), id_when=_text("i.pubDate"),
                 pub_when=_either(_text("i.pubDate"), _text("i.`dc:date`"))),
        _text("_rss.channel.title"), _text("_rss.channel.link")),
    "atom": (
        _entries("_atom.entry", raw_id=_text("i.id"), link=_link("i.link"),
                 title=_either(_text("i.title"), _text(f"{_GROUP}.`media:title`")),
                 author=_text(f"{_once('i.author')}.name"),
                 summary=_either(_text("i.summary"), _text(f"{_GROUP}.`media:description`")),
                 content=_text("i.content"), id_when=_text("i.updated"),
                 pub_when=_either(_text("i.published"), _text("i.updated"))),
        _text("_atom.title"), _link("_atom.link")),
    "rdf": (
        _entries("_rdf.item", raw_id="coalesce(i.`_rdf:about`, '')", link=_text("i.link"), title=_text("i.title"),
                 author=_text("i.`dc:creator`"), summary=_text("i.description"), content=_text("i.`content:encoded`"),
                 id_when=_text("i.`dc:date`"), pub_when=_text("i.`dc:date`")),
        _text(f"{_once('_rdf.channel')}.title"), _text(f"{_once('_rdf.channel')}.link")),
    "json": (
        _entries(_JSON_ITEMS, raw_id=f"coalesce({_json_text('i', '$.id')}, {_JSON_URL})", link=_JSON_URL,
                 title=f"coalesce({_json_text('i', '$.title')}, '')",
                 author=f"coalesce({_json_text('i', '$.author.name')}, {_json_text('_json.author', '$.name')})",
                 summary=_json_text("i", "$.summary"),
                 content=f"coalesce({_json_text('i', '$.content_html')}, {_json_text('i', '$.content_text')})",
                 id_when=f"coalesce({_json_text('i', '$.date_published')}, '')",
                 pub_when=f"coalesce({_json_text('i', '$.date_published')}, '')"),
        f"coalesce({_json_text('_json.title')}, '')", _json_text("_json.home_page_url")),
}


_PROLOG = rf"^﻿?(?:[{WS}]+|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|(?i:<!DOCTYPE)[^>\[]*(?:\[[\s\S]*?\]\s*)?>)*"


def _root(body: Column) -> Column:
    return F.regexp_extract(body, _PROLOG + r"<([A-Za-z_][\w:.-]*)", 1)


def parse_feeds(fetches: DataFrame) -> DataFrame:
    """One row per response, in place of its body: format, parse error, channel title and link, entries.

    ``fetches`` needs ``body`` (text) and ``content_type``. The strict parser runs first; only bodies it rejects are
    sent to Python, which mends them for a second strict pass, so one scan serves every format and both passes.
    """
    bound_batches(fetches.sparkSession)
    # A byte order mark is no part of the document.
    fetches = fetches.withColumn("body", F.regexp_replace("body", "^﻿", ""))
    body = F.col("body")
    json_like = F.col("content_type").contains("json") | F.ltrim(body).startswith("{")
    staged = fetches.withColumn("content_type", F.coalesce("content_type", F.lit(""))).withColumn(
        "_json", F.when(json_like, F.from_json(body, _JSON, {"mode": "PERMISSIVE"})))
    is_json = F.col("_json").isNotNull() & F.col("_json._corrupt_record").isNull()
    staged = staged.withColumn("format", F.when(is_json, "json").when(_root(body) == "rss", "rss")
                               .when(_root(body) == "feed", "atom")
                               .when(_root(body).isin("rdf:RDF", "RDF"), "rdf").otherwise("none"))

    def strict(text: Column, fmt: str, schema: str) -> Column:
        wanted = F.when(F.col("format") == fmt, text)
        return F.from_xml(wanted, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})

    schemas = {"rss": _RSS, "atom": _ATOM, "rdf": _RDF}
    staged = staged.withColumns({f"_{fmt}": strict(body, fmt, schema) for fmt, schema in schemas.items()})
    # A document with no element of the wanted names also reads as corrupt: mending leaves it as it is.
    rejected = F.coalesce(*[F.col(f"_{f}._corrupt_record") for f in schemas]).isNotNull()
    endless = body.rlike(r"<!\[CDATA\[(?![\s\S]*\]\]>)|<!--(?![\s\S]*-->)")
    # The strict parser leaves declared entities out.
    declares = (F.col("format") != "json") & body.rlike(r"(?i)^[^<]*(?:<[?!][^<]*)*<!DOCTYPE[^<>\[]*\[[^<]*(?:<!(?!ENTITY)[^<]*)*<!ENTITY")
    staged = staged.withColumn("_broken", rejected | ((F.col("format") == "none") & endless) | declares)
    staged = staged.withColumn("_mended", mend_xml_udf(F.when(F.col("_broken"), body)))
    staged = staged.withColumns({
        f"_{fmt}": F.when(F.col("_broken"), strict(F.col("_mended"), fmt, schema)).otherwise(F.col(f"_{fmt}"))
        for fmt, schema in schemas.items()})

    def pick(part: int, default: str) -> Column:
        cases = " ".join(f"when '{fmt}' then {read[part]}" for fmt, read in _READ.items())
        return F.expr(f"case format {cases} else {default} end")

    kept = [c for c in fetches.columns if c != "body"]
    no_entries = f"cast(array() as array<struct<{_ENTRY.replace(' string', ':string')}>>)"
    return staged.select(
        *kept, "format",
        F.when(F.col("_broken") & F.col("_mended").isNull(), "a section of the document never ends, or its entities do").alias("parse_error"),
        F.when(F.col("_mended").isNotNull(), "mended").otherwise("strict").alias("parse_mode"),
        pick(1, "''").alias("feed_title"), blank_to_null(pick(2, "null")).alias("site_url"),
        F.coalesce(pick(0, "null"), F.expr(no_entries)).alias("entries"))


def items_of(parsed: DataFrame) -> DataFrame:
    """One row per entry with identity and dates; ``feed_pos`` is the entry's place in its body."""
    kept = [c for c in ("fetch_id", "feed_id", "fetched_at") if c in parsed.columns]
    e = F.col("e")
    # The channel link is taken as the body states it: a missing one equals no item's link.
    channel = F.coalesce(F.col("site_url"), F.lit(""))
    none = lambda name: F.coalesce(e[name], F.lit(""))
    xml_guid = item_guid(none("raw_id"), none("link"), channel, none("title"), none("id_when"))
    json_guid = F.coalesce(e["raw_id"], hash_guid(e["title"], none("id_when")))
    text = lambda name: F.when(F.col("format") == "json", e[name]).otherwise(blank_to_null(e[name])).alias(name)
    return parsed.select(*kept, "format", "site_url", F.posexplode("entries").alias("feed_pos", "e")).select(
        *kept, "feed_pos",
        F.when(F.col("format") == "json", json_guid).otherwise(xml_guid).alias("guid"),
        F.when(F.col("format") == "json", e["link"]).otherwise(blank_to_null(e["link"])).alias("url"),
        e["title"].alias("title"), text("author"), text("summary"), text("content"),
        parse_date(none("pub_when")).alias("published_at"))
