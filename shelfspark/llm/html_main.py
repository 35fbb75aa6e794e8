"""Main text of web pages by site template removal (operator 12).

Each page is parsed once per pass into a tree; every element's subtree (tags and text, no attributes) has a hash. Spark counts, per
host, on how many pages of different main text a subtree occurs, so that copies of one article count once; subtrees that
recur are the host's template and are deleted from its pages. What the template cannot show - a menu or notice that occurs
once - goes by its element, role, or words of its class and id. Running text inside an article is never deleted for recurring.

Defined results: a null page is empty; a page without address belongs to no site, so only its own structure counts; repeated
rows are pages of their own; text that all deletions would empty keeps what its structure alone leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, store

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
td template tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("""head script style noscript template title nav footer aside form button select option textarea input iframe frame frameset
object embed applet svg math canvas audio video dialog menu search datalist""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that name furniture, and those that name readers' comments.
FURNITURE = frozenset("""ad ads adsense adslot adunit advert adverts advertisement advertisements advertising adbox dfp sponsor sponsors sponsored promo promos promotion
banner banners nav navs navbar navigation menu menus submenu topmenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footers
masthead topbar header siteheader cookie cookies cookiebar consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter
subscribe subscription signup login share sharing sharebar social socials related recommended recommendations pagination pager toolbar skip copyright disclaimer""".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply responses discussion".split())
#: Running text: an element of these is deleted for recurring only outside articles and on a large share of the host.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead figcaption caption".split())
#: A start tag of the key ends open elements of the values (up to the nearest list, table or section).
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "head", "title"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody", "p"]), "tfoot": frozenset(["tr", "td", "th", "thead", "tbody", "p"]),
    "thead": frozenset(["caption", "p"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
WALLS = frozenset("ul ol dl table div section article main body html nav aside footer header form blockquote td th select menu".split())
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: A subtree is a template where it recurs on this many pages of different text and this share of the host's such pages.
MIN_PAGES, MIN_SHARE = 3, 0.01
TEXT_PAGES, TEXT_SHARE = 5, 0.3


class Page(HTMLParser):
    """Elements in document order (``tag``, ``parent``, ``own``: words that speak against it) and their text runs."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.why, self.kids, self.runs = ["#page"], [-1], [""], [[]], []
        self.open, self.segment = [0], 0
        html = html or ""
        cut = html.rfind("<")
        if cut > html.rfind(">") and re.match("[A-Za-z/!?]", html[cut + 1:cut + 2]):  # a tag that the page's end cuts off is no text
            html = html[:cut]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = ENDS.get(tag)
        if ends:
            k = len(self.open) - 1
            while k > 0:
                name = self.tag[self.open[k]]
                if name in ends:
                    del self.open[k:]
                elif name in WALLS:
                    break
                k -= 1
        if tag in BLOCK:
            self.segment += 1
        elif tag == "br":
            self.runs.append((self.open[-1], self.segment, " "))
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.why.append(verdict(tag, attrs))
        self.kids.append([])
        self.kids[self.open[-1]].append(len(self.tag) - 1)
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.segment += 1
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                del self.open[k:]
                return
            if name in WALLS and tag not in WALLS:  # a stray end tag closes nothing outside its section
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.runs.append((self.open[-1], self.segment, data))
            self.kids[self.open[-1]].append(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    # ---- what the structure says

    def structure(self) -> None:
        """``dead``: elements that go by their own structure (with all below); ``inside``: article each element lies in, or -1."""
        n = len(self.tag)
        chars = [0] * n
        for at, _, data in self.runs:
            chars[at] += len(data)
        good, holds = [False] * n, [False] * n
        for i in range(n):
            good[i] = self.tag[i] in ("article", "main") and self.why[i] == ""
        bad = [False] * n  # below an element that never holds main text
        for i in range(1, n):
            bad[i] = bad[self.parent[i]] or self.why[i] in ("never", "comment") and self.tag[i] not in ("html", "body")
        for i in range(n - 1, 0, -1):
            holds[i] = holds[i] or good[i] and not bad[i]
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
            if self.tag[i] not in NEVER:
                chars[self.parent[i]] += chars[i]
        self.dead, self.inside = [False] * n, [-1] * n
        for i in range(1, n):
            up, why = self.parent[i], self.why[i]
            self.inside[i] = i if self.tag[i] == "article" and good[i] else self.inside[up]
            own = why == "never" or why == "comment" and not holds[i]
            own = own or why == "furniture" and not holds[i] and (self.inside[up] >= 0 or 2 * chars[i] < chars[0])
            own = own or why == "header" and not holds[i] and self.inside[up] < 0
            self.dead[i] = self.dead[up] or own and self.tag[i] not in ("html", "body")
        articles = [i for i in range(1, n) if self.tag[i] == "article" and good[i] and not self.dead[i] and self.inside[self.parent[i]] < 0]
        mains = [i for i in range(1, n) if self.tag[i] == "main" and not self.dead[i]]
        if articles and mains and 2 * sum(chars[i] for i in articles) < sum(chars[i] for i in mains):
            articles = []
        self.roots = set(articles or mains)

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """Blocks of the main text; elements whose hash is in ``template`` go."""
        n = len(self.tag)
        gone, rooted = self.dead[:], [not self.roots] * n
        marks = self.hashes if template else None
        for i in range(1, n):
            up = self.parent[i]
            rooted[i] = rooted[up] or i in self.roots
            gone[i] = gone[i] or gone[up] or marks is not None and marks[i] in template and self.may_recur(i)
        out, block, last = [], [], -1
        for at, segment, data in self.runs:
            if gone[at] or not rooted[at]:
                continue
            if segment != last:
                out.append("".join(block))
                block, last = [], segment
            block.append(data)
        out.append("".join(block))
        return "\n".join(filter(None, (" ".join(b.split()) for b in out)))

    # ---- what the site says

    def may_recur(self, i: int) -> bool:
        """Whether recurring can delete the element: no article or what holds one, and no running text of an article."""
        return self.tag[i] in BLOCK and self.tag[i] not in ("html", "body", "article", "main") and not (self.inside[i] >= 0 and self.tag[i] in TEXT)

    def hash_subtrees(self) -> None:
        """64-bit hash of each element with text below it, else 0."""
        n = len(self.tag)
        self.hashes = [0] * n
        for i in range(n - 1, 0, -1):
            parts = [k if isinstance(k, str) else self.hashes[k] for k in self.kids[i]]
            parts = [" ".join(k.split()) if isinstance(k, str) else "\0%d" % k for k in parts]
            parts = [k for k in parts if k and k != "\0" "0"]
            if parts:
                key = "\1".join([self.tag[i], *parts]).encode(errors="surrogatepass")
                self.hashes[i] = int.from_bytes(blake2b(key, digest_size=8).digest(), "little", signed=True)


def verdict(tag: str, attrs: list) -> str:
    """never, comment, furniture, header or nothing: what an element's start tag says about it."""
    if tag in NEVER:
        return "never"
    found = "header" if tag == "header" else ""
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            words = set(WORDS.findall(CAMEL.sub(" ", value).lower()))
            if words & COMMENTS:
                return "comment"
            if words & FURNITURE and tag not in ("article", "main"):
                found = "header" if not words & (FURNITURE - {"header"}) else "furniture"
        elif name == "role" and value.strip().lower() in ROLES:
            return "never"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "never"
    return found


def read(html: str | None) -> Page:
    page = Page(html)
    page.structure()
    page.hash_subtrees()
    return page


def subtree_rows(pages: DataFrame) -> DataFrame:
    """host, hash, body, text: the distinct subtrees of each page that recurring may delete; body is the hash of its main text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, html in zip(b["host"].to_pylist(), b["html"]):
                page = read(html.as_py())
                body = int.from_bytes(blake2b(page.text().encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)
                marks = {(page.hashes[i], page.tag[i] in TEXT) for i in range(1, len(page.tag)) if page.hashes[i] and page.may_recur(i)}
                rows += [(host, h, body, t) for h, t in marks] + [(host, 0, body, False)]  # 0 counts the page itself
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "hash", "body", "text"])

    return pages.where("host is not null").select("host", "html").mapInArrow(kernel, "host string, hash long, body long, text boolean")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_pages: int = TEXT_PAGES, text_share: float = TEXT_SHARE) -> DataFrame:
    """host, template (hashes of its recurring subtrees: at most a page's mean number of elements / ``min_share``)."""
    rows = subtree_rows(pages).distinct().groupBy("host", "hash", "text").agg(F.count("*").alias("n"))
    rows = store(rows.where((F.col("n") >= min_pages) | (F.col("hash") == 0)), "subtrees")
    total = rows.where("hash = 0").select("host", F.col("n").alias("total"))
    least = F.when(F.col("text"), F.greatest(F.lit(text_pages), F.col("total") * text_share)).otherwise(F.greatest(F.lit(min_pages), F.col("total") * min_share))
    return rows.where("hash <> 0").join(total, "host").where(F.col("n") >= least).groupBy("host").agg(F.collect_set("hash").alias("template"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **thresholds) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``thresholds`` are those of ``site_templates``."""
    host = F.lower(F.regexp_extract(column(pages, url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(column(pages, id_col).alias("page_id"), column(pages, url_col).alias("url"), F.nullif(host, F.lit("")).alias("host"), column(pages, html_col).alias("html"))
    templates = store(site_templates(rows, **thresholds), "templates")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = []
            for host, template, html in zip(b["host"].to_pylist(), b["template"], b["html"]):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = frozenset(template.as_py() or ())
                page = read(html.as_py())
                texts.append(page.text(known[host]) or page.text())
            text = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], text, pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    url_type = rows.schema["url"].dataType.simpleString()
    return rows.join(templates, "host", "left").select("page_id", "url", "host", "template", "html").mapInArrow(kernel, f"page_id {id_type}, url {url_type}, text string, n_chars long")
