"""One parse of a landed page or sitemap with the standard library's parsers, as an Arrow column of structs.

``page(html)`` gives everything the page operators need (B05, B14, B18, B20, B24), so that a query which uses several of them
parses each page once; Catalyst evaluates equal calls of one projection together.  Comments, scripts and styles hold
neither links nor text, attributes may hold any character, a bare ``<`` is text, and all character references are decoded.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text a page's visible text leaves out: blocks that the pages' readers skip, and what no browser shows.
SKIPPED = frozenset("script style nav footer header noscript template".split())
UNSEEN = frozenset("script style noscript template".split())

#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre search section summary table ul""".split())

PAGE = "struct<links: array<string>, meta: array<struct<property: string, content: string>>, h1: string, paragraphs: array<string>, text: string>"
ENTRY = "array<struct<kind: string, loc: string>>"
#: Documents that are parsed at a time.
SLICE = 32


class PageReader(HTMLParser):
    """Links, meta properties, first heading, paragraphs and visible text of one page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.links, self.meta, self.paragraphs, self.text = [], [], [], []
        self.h1 = None
        self.open: list[str] = []
        self.in_h1, self.in_p = False, False
        cut = html.rfind("<")
        if cut > html.rfind(">") and html[cut + 1:cut + 2].isascii() and (html[cut + 1:cut + 2].isalpha() or html[cut + 1:cut + 2] in ("/", "!", "?")):
            html = html[:cut]  # a tag that the page's end cuts off is no text
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href is not None and not UNSEEN.intersection(self.open):
                self.links.append(href.strip())
        elif tag == "meta":
            found = dict(reversed(attrs))  # the first of repeated attributes counts
            if found.get("property") is not None:
                self.meta.append({"property": found["property"], "content": found.get("content")})
        if tag in ENDS_P and self.in_p:
            self.handle_endtag("p")
        if tag == "h1" and self.h1 is None:
            self.h1, self.in_h1 = [], True
        elif tag == "p":
            self.paragraphs.append([])
            self.in_p = True
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.in_h1 = self.in_h1 and tag != "h1"
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                self.in_p = self.in_p and "p" not in self.open[k:]
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and not UNSEEN.isdisjoint(self.open):
            return
        if self.in_h1:
            self.h1.append(data)
        if self.in_p:
            self.paragraphs[-1].append(data)
        if SKIPPED.isdisjoint(self.open):
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def row(self) -> dict:
        flat = lambda parts: "".join(parts).replace("\xa0", " ")
        return {"links": self.links, "meta": self.meta, "h1": None if self.h1 is None else flat(self.h1),
                "paragraphs": [flat(p) for p in self.paragraphs], "text": " ".join(self.text).replace("\xa0", " ")}


class _Loose(PageReader):
    """A document that is no XML: its links and what its ``loc`` elements hold."""

    def __init__(self, html: str):
        self.locs: list[str] = []
        super().__init__(html)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].rsplit(":", 1)[-1] == "loc":
            self.locs.append(data.strip())


def sitemap_entries(xml: str) -> list[dict]:
    """Entries of one sitemap: ``url/loc`` of a urlset are pages, ``sitemap/loc`` of a sitemapindex nested sitemaps, in any
    namespace; another well-formed document has none.  What is not well-formed gives its absolute links (nested ones end in
    a slash), then its ``loc`` texts as pages."""
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    try:
        root = ElementTree.fromstring(xml.strip())
    except (ElementTree.ParseError, ValueError):
        loose = _Loose(xml)
        links = [{"kind": "nested" if h.endswith("/") else "url", "loc": h} for h in loose.links if h.startswith("http")]
        return links + [{"kind": "url", "loc": x} for x in loose.locs if x]
    kind, parent = {"sitemapindex": ("nested", "sitemap"), "urlset": ("url", "url")}.get(local(root).lower(), (None, None))
    found = [(c.text or "").strip() for e in root.iter() if kind and e is not root and local(e) == parent for c in e if local(c) == "loc"]
    return [{"kind": kind, "loc": x} for x in found if x]


def _arrow(ddl: str, read: Callable) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    out = to_arrow_type(DataType.fromDDL(ddl))

    @F.arrow_udf(ddl)
    def kernel(docs: pa.Array) -> pa.Array:
        # a few documents at a time are Python objects, whatever the batch holds
        parts = [pa.array([None if d is None else read(d) for d in docs.slice(at, SLICE).to_pylist()], out) for at in range(0, len(docs), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], out)

    return kernel


def page(html) -> Column:
    """PAGE of a page; NULL for a NULL page."""
    return _arrow(PAGE, lambda h: PageReader(h).row())(html)


def links(html) -> Column:
    """The links of a page alone, by the same parse; NULL for a NULL page."""
    return _arrow("array<string>", lambda h: PageReader(h).links)(html)


def sitemap(xml) -> Column:
    """ENTRY of a landed sitemap; NULL for a NULL document."""
    return _arrow(ENTRY, sitemap_entries)(xml)
