"""Page markup to element rows: the one per-page step that needs Python, streamed in Arrow batches."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from feedloom.functions.text import NAMED, WS

# Elements without content, elements whose content is no markup, and implied end tags.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template"}
IMPLIED = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}

_START = re.compile(rf"<([a-zA-Z][^{WS}/>]*)")
_ATTR = re.compile(rf"""[{WS}]*(?:(/?>)|([^{WS}=/>]+)[{WS}]*(=[{WS}]*("[^"]*"?|'[^']*'?|[^{WS}>]*))?|[=/])""")
_SPACE = re.compile(f"[{WS}]+")
_REF = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([a-zA-Z]+));")

SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("error", pa.string()), ("base_url", pa.string()), ("node_id", pa.int32()),
    ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()),
    ("open_end", pa.int32()), ("close_start", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
    ("text_len", pa.int32()), ("links", pa.int32())])


def _decode(m: re.Match) -> str:
    if m[3]:
        return NAMED.get(m[3].lower(), m[0])
    n = int(m[1], 16) if m[1] else int(m[2])
    return m[0] if n > 0x10FFFF else "�" if 0xD800 <= n <= 0xDFFF else chr(n)


def _clean(text: str) -> str:
    return _SPACE.sub(" ", _REF.sub(_decode, text) if "&" in text else text).strip(" ")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    attrs: dict[str, str] = {}
    while m := _ATTR.match(html, at):
        at = m.end()
        if m[1]:
            return attrs, at, m[1] == "/>"
        if m[2]:
            value = m[4] or ""
            quoted = value[:1] in ("'", '"')
            attrs[m[2].lower()] = (value[1:-1] if value[-1] == value[0] and len(value) > 1 else value[1:]) if quoted else value
    return attrs, len(html), False


class _Element:
    __slots__ = ("row", "tag", "pieces", "cursor", "links", "begin")

    def __init__(self, row: dict, cursor: int, begin: int):
        self.row, self.tag, self.pieces, self.cursor, self.links, self.begin = row, row["tag"], [], cursor, 0, begin


class _PageText:
    """The text of a page, written once. An element's text is a slice of it: what is written between its start and end,
    without outer space. Space at an element's start is never written, and space at its end is taken back."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0

    def write(self, raw: str, begin: int) -> None:
        """Add the text of a gap between tags to the element whose text begins at ``begin``."""
        text = _SPACE.sub(" ", _REF.sub(_decode, raw) if "&" in raw else raw)
        if text[:1] == " " and (self.length == begin or self.parts[-1][-1] == " "):
            text = text[1:]
        if text:
            self.parts.append(text)
            self.length += len(text)

    def end(self, begin: int) -> int:
        """Take back the space that ends an element's text, and say where the text ends."""
        if self.length > begin and self.parts[-1][-1] == " ":
            last = self.parts.pop()[:-1]
            if last:
                self.parts.append(last)
            self.length -= 1
        return self.length


def _utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "replace")) // 2


def scan(html: str) -> list[dict]:
    """Elements in document order with their extents and whole text, however deep they nest.

    An element's text is the text between its children and the children's own texts, references decoded and space
    collapsed at each level. The page's text is written once and elements are slices of it. Only where a decoded
    reference left another one behind (``&amp;lt;``) does a level above decode further, and texts are joined level by
    level instead.
    """
    rows: list[dict] = []
    page = _PageText()
    top = _Element({"tag": "#root", "node_id": -1}, 0, 0)
    stack, open_tags, at = [top], {}, 0

    def close(close_start: int, end: int) -> None:
        el = stack.pop()
        open_tags[el.tag] -= 1
        page.write(html[el.cursor:close_start], el.begin)
        el.pieces.append((el.cursor, close_start))
        finish(el, stack[-1], (el.begin, page.end(el.begin)), close_start, end)

    def finish(el: _Element, parent: _Element, span: tuple[int, int] | str, close_start: int, end: int) -> None:
        el.row.update(close_start=close_start, end=end, text=span, links=el.links, pieces=el.pieces)
        if el.tag not in RAW:
            parent.pieces.append(el.row)
        parent.cursor = end
        parent.links += el.links + (el.tag == "a")

    def enter(parent: _Element, start: int) -> None:
        """The parent's text up to the element that starts there."""
        page.write(html[parent.cursor:start], parent.begin)
        parent.pieces.append((parent.cursor, start))

    while (lt := html.find("<", at)) != -1:
        if html.startswith("<!", lt):
            stop = "-->" if html.startswith("<!--", lt) else ">"
            found = html.find(stop, lt + (4 if stop == "-->" else 0))
            at = len(html) if found == -1 else found + len(stop)
            continue
        if html.startswith("</", lt):
            gt = html.find(">", lt)
            at = len(html) if gt == -1 else gt + 1
            tag = html[lt + 2:len(html) if gt == -1 else gt].strip().lower()
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    close(lt, lt)
                close(lt, at)
            continue
        m = _START.match(html, lt)
        if not m:
            at = lt + 1
            continue
        tag = m[1].lower()
        attrs, at, self_closing = _attributes(html, m.end())
        while len(stack) > 1 and stack[-1].tag in IMPLIED.get(tag, ()):
            close(lt, lt)
        row = {"node_id": len(rows), "parent_id": stack[-1].row["node_id"], "depth": len(stack), "tag": tag,
               "id": attrs["id"].strip() if attrs.get("id") else None,
               "classes": [c for c in _SPACE.split(attrs.get("class", "")) if c],
               "attrs": list(attrs.items()), "start": lt, "open_end": at}
        rows.append(row)
        enter(stack[-1], lt)
        el = _Element(row, at, page.length)
        if self_closing or tag in VOID:
            finish(el, stack[-1], "", at, at)
        elif tag in RAW:
            body = at
            stop = re.compile(f"</{tag}", re.I | re.A).search(html, body)
            gt = html.find(">", stop.start()) if stop else -1
            at = len(html) if gt == -1 else gt + 1
            inner = stop.start() if stop else len(html)
            finish(el, stack[-1], _clean(html[body:inner]), inner, at)
        else:
            stack.append(el)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            # Markup that is passed over (comments, stray tags) stays part of the text between tags, as it always was.
    while len(stack) > 1:
        close(len(html), len(html))
    _give_texts(rows, "".join(page.parts), html)
    return rows


def _give_texts(rows: list[dict], page: str, html: str) -> None:
    """Turn spans into texts. Children come after their parents, so going backwards finds their texts ready."""
    again = "&" in page and _REF.search(page)
    for row in reversed(rows):
        pieces, span = row.pop("pieces"), row["text"]
        if not isinstance(span, str):
            row["text"] = _clean("".join(p["text"] if isinstance(p, dict) else html[p[0]:p[1]] for p in pieces)) \
                if again else page[span[0]:span[1]]
        row["text_len"] = _utf16_length(row["text"])


#: Pages held as Python text at once, and what one batch of element rows may hold: rows, and characters of their texts.
_PAGES, _ROWS, _CHARACTERS = 16, 2_000, 2 << 20


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, error) in, element rows out; a page that cannot be read is one row with an error."""
    for batch in (whole.slice(at, _PAGES) for whole in batches for at in range(0, whole.num_rows, _PAGES)):
        out: list[dict] = []
        for page_id, url, html, error in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "error"))):
            if error:
                out.append({"page_id": page_id, "error": error})
                continue
            size = 0
            for row in scan(html or ""):
                row["page_id"] = page_id
                row["base_url"] = url if any(name == "href" for name, _ in row["attrs"]) else None
                out.append(row)
                size += len(row["text"])
                if len(out) >= _ROWS or size >= _CHARACTERS:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
