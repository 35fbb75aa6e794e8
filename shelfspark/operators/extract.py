"""Corpus extraction over landed pages, listings and service replies.

Every parser is a Column expression over one row (regex, JSON path, array
functions), so extraction is a narrow, codegen'd projection of the scan:
no shuffle unless an operator needs "first occurrence wins" across rows
(B08), which is a keyed window.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import markup
from ..functions import text as TX
from ..functions import urls as U

WS_TRIM = r"^\s+|\s+$"


def strip_ws(c) -> Column:
    return F.regexp_replace(TX.col(c), WS_TRIM, "")


# B05 ------------------------------------------------------------------------
def origin(url) -> Column:
    return F.regexp_extract(TX.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def fold_dots(url) -> Column:
    """``url`` without ``.`` and ``..`` path segments, as a browser shows it."""
    u = TX.col(url)
    root, path = origin(u), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    tail = F.regexp_extract(u, r"([?#].*)$", 1)
    segs = F.split(path, "/")
    folded = F.aggregate(segs, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(
        s == ".", acc).otherwise(F.array_append(acc, s)))
    folded = F.when(F.element_at(segs, -1).isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(root, F.array_join(folded, "/"), tail)).otherwise(u)


def resolve(href, base) -> Column:
    """Absolute URL of ``href`` on page ``base`` (scheme, host-relative, path-relative, dot segments)."""
    h, b = TX.col(href), TX.col(base)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base_dir = F.regexp_extract(b, r"^([^?#]*/)", 1)
    return fold_dots(F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
                     .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
                     .when(h.startswith("/"), F.concat(origin(b), h))
                     .when(h.startswith("#") | h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
                     .otherwise(F.concat(base_dir, h)))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every ``<a href>`` of a page (any quoting, references decoded), resolved, with its position: ``(url, pos, href)``."""
    out = pages.select(F.col(url_col).alias("url"), F.posexplode(markup.links(F.col(html_col))).alias("pos", "raw_href"))
    return out.select("url", (F.col("pos") + 1).alias("pos"), resolve(F.col("raw_href"), F.col("url")).alias("href"))


# B04 ------------------------------------------------------------------------
def url_filter(urls: DataFrame, base: Column | str, pattern: str = "/", regex: str | None = None,
               limit: int = 0, col: str = "href") -> DataFrame:
    """URLs containing ``pattern``, on the same host as ``base``, matching ``regex``;
    sorted, optionally the first ``limit``."""
    b = F.col(base) if isinstance(base, str) and base in urls.columns else F.lit(base) if isinstance(base, str) else base
    out = urls.where(F.col(col).contains(pattern) & (U.url_host(F.col(col)) == U.url_host(b)))
    if regex:
        out = out.where(F.col(col).rlike(regex))
    out = out.orderBy(col)
    return out.limit(limit) if limit > 0 else out


# B06 / B07 ------------------------------------------------------------------
def category_links(links: DataFrame, patterns: list[str]) -> DataFrame:
    """Same-origin links without '#'/'?', not the site root, containing a store pattern,
    not a product-under-collection link; distinct and sorted per page."""
    h = F.col("href")
    pats = F.array(*[F.lit(p) for p in patterns])
    keep = ((origin(h) == origin(F.col("url"))) & ~h.contains("#") & ~h.contains("?")
            & (F.regexp_replace(h, "/+$", "") != origin(F.col("url")))
            & F.exists(pats, lambda p: h.contains(p))
            & ~h.rlike(r"/collections/[^/]+/products/"))
    return links.where(keep).select("url", F.col("href").alias("category_url")).distinct()


def product_links(links: DataFrame, product_regex: str, url_regex: str | None = None) -> DataFrame:
    """Product links (store-type pattern, optional regex), query string cut, distinct;
    each with the first category page that showed it."""
    h = F.split(F.col("href"), r"\?").getItem(0)
    out = links.where(F.col("href").rlike(product_regex)).select("url", "pos", h.alias("product_url"))
    if url_regex:
        out = out.where(F.col("product_url").rlike(url_regex))
    # first occurrence as an aggregate (min of (page, position)): combined map-side, so a link
    # shown on every page does not gather all its rows in one task
    return out.groupBy("product_url").agg(F.min(F.struct("url", "pos")).alias("_f")).select(
        "product_url", F.col("_f.url").alias("first_category"))


def store_category_links(links: DataFrame, store: str) -> DataFrame:
    """B06 with the link patterns of a store type."""
    return category_links(links, fixed.STORE_CATEGORY_PATTERNS[store])


def store_product_links(links: DataFrame, store: str, url_regex: str | None = None) -> DataFrame:
    """B07 with the product pattern of a store type."""
    return product_links(links, fixed.STORE_PRODUCT_PATTERNS[store], url_regex)


def new_per_category(links: DataFrame, products: DataFrame) -> DataFrame:
    """Per category page, in url order, how many product links it showed first: ``(category, new_products)``;
    pages that added none count zero."""
    pages = links.select(F.col("url").alias("category")).distinct()
    added = products.groupBy(F.col("first_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return pages.join(added, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("new_products"))


# B08 / B09 ------------------------------------------------------------------
def category_path(url) -> dict[str, Column]:
    """First two path segments as title-cased category / subcategory ('-' -> ' ')."""
    path = F.regexp_extract(TX.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    seg = lambda i: F.try_element_at(segs, F.lit(i))
    return {
        "category": TX.python_title(F.replace(seg(1), F.lit("-"), F.lit(" "))),
        "subcategory": F.when(seg(2).isNotNull(), TX.python_title(F.replace(seg(2), F.lit("-"), F.lit(" ")))),
    }


def listing_links(links: DataFrame, home_links: DataFrame | None = None) -> DataFrame:
    """In-domain listing links (no /category/, /tag/, '#'); the first category page
    (by page order, then link order) wins per URL; homepage links, but the site's root, only when unseen."""
    h = F.col("href")
    ok = (origin(h) == origin(F.col("url"))) & ~h.contains("/category/") & ~h.contains("/tag/") & ~h.contains("#")
    cand = links.where(ok)
    first = cand.groupBy("href").agg(F.min(F.struct("url", "pos")).alias("_f")).select(
        F.col("href").alias("listing_url"), F.col("_f.url").alias("category_page"))
    cp = category_path(F.col("category_page"))
    found = first.select("listing_url", "category_page", cp["category"].alias("category"), cp["subcategory"].alias("subcategory"))
    if home_links is None:
        return found
    root = F.regexp_replace(h, "/+$", "") == origin(h)
    extra = home_links.where(ok & ~root).select(F.col("href").alias("listing_url")).distinct().join(first, "listing_url", "left_anti")
    return found.unionByName(extra.select("listing_url", F.lit(None).cast("string").alias("category_page"),
                                          F.lit(fixed.HOMEPAGE_CATEGORY).alias("category"), F.lit("").alias("subcategory")))


# B18 ------------------------------------------------------------------------
def page_text(html, max_len: int | None = None, min_len: int = 50, markdown=None) -> Column:
    """The page's markdown where there is any, else its visible text: no script/style/nav/footer/header blocks or
    comments, whitespace squeezed; shorter than ``min_len`` -> NULL."""
    x = TX.squeeze(F.coalesce(markup.page(TX.col(html))["text"], F.lit("")))
    x = F.when(TX.col(html).isNotNull(), x)
    if markdown is not None:
        x = F.when(F.coalesce(TX.col(markdown), F.lit("")) != "", TX.col(markdown)).otherwise(x)
    if max_len:
        x = F.left(x, F.lit(max_len))
    return F.when(F.length(x) >= min_len, x)


# B20 ------------------------------------------------------------------------
def title_name(html) -> Column:
    """Text of the first <h1> without marker emoji; the part after the first ':' if any."""
    h1 = markup.page(TX.col(html))["h1"]
    t = h1
    for m in fixed.TITLE_MARKERS:
        t = F.replace(t, F.lit(m), F.lit(""))
    t = strip_ws(t)
    after = strip_ws(F.substr(t, F.instr(t, ":") + 1))
    return F.when(h1 == "", F.lit(None).cast("string")).when(t.contains(":"), after).otherwise(t)


# B24 ------------------------------------------------------------------------
def description(html) -> Column:
    """Paragraph texts not starting with a field label, joined by spaces."""
    paras = markup.page(TX.col(html))["paragraphs"]
    keep = F.filter(F.transform(paras, strip_ws), lambda t: ~F.exists(F.array(*[F.lit(s) for s in fixed.DESCRIPTION_SKIP_PREFIXES]),
                                                                      lambda s: t.startswith(s)))
    return F.when(F.size(paras) > 0, F.array_join(keep, " "))


# B21 / B22 / B25 -------------------------------------------------------------
def labelled_fields(text, website_full_line: bool = False) -> dict[str, Column]:
    """The six 'Label: value' fields (first match, case-insensitive), plus ``found``."""
    t = TX.col(text)
    out = {}
    found = F.lit(0)
    for field, pat in fixed.LISTING_FIELD_PATTERNS.items():
        if field == "website" and website_full_line:
            pat = fixed.WEBSITE_PATTERN_FULL_LINE
        p = "(?iu)" + pat
        hit = t.rlike(p)
        out[field] = F.when(hit, strip_ws(F.regexp_extract(t, p, 1)))
        found = found + F.when(hit, 1).otherwise(0)
    out["canadian_owned"] = TX.owned_flag(out["canadian_owned_text"])
    out["found"] = found
    return out


def needs_enrichment(found, website) -> dict[str, Column]:
    """A listing needs a second source when < 3 fields were found or the website is missing."""
    missing = F.coalesce(TX.col(website), F.lit("")) == ""
    need = (TX.col(found) < 3) | missing
    reason = F.when(~need, F.lit(None).cast("string")).when(TX.col(website).isNull(), F.lit("website missing")).otherwise(
        F.concat(F.lit("regex found only "), TX.col(found).cast("string"), F.lit(" fields")))
    return {"needs_enrichment": need, "reason": reason}


# B23 ------------------------------------------------------------------------
def website_fallback(listings: DataFrame, links: DataFrame, own_prefix: str) -> DataFrame:
    """First absolute external link of the page when the website field is empty."""
    ext = links.where(F.col("href").startswith("http") & ~F.col("href").startswith(own_prefix)).groupBy("url").agg(
        F.min_by("href", "pos").alias("first_external"))
    j = listings.join(ext, "url", "left")
    return j.withColumn("website", F.coalesce(F.nullif(F.col("website"), F.lit("")), F.col("first_external"))).drop(
        "first_external")


# B26 ------------------------------------------------------------------------
ENRICH_FIELDS = ["name", "products", "manufactured_in", "where_to_buy", "website", "description"]


def fill_missing(listings: DataFrame, extra: DataFrame) -> DataFrame:
    """Fill only the missing fields from a second source keyed by url; ownership
    from the second source is tagged with its provenance."""
    for c in ENRICH_FIELDS:
        if c not in listings.columns:
            listings = listings.withColumn(c, F.lit(None).cast("string"))
    e = extra.select("url", *[F.col(c).alias("_x_" + c) for c in ENRICH_FIELDS], F.col("canadian_owned").alias("_x_co"))
    j = listings.join(e, "url", "left")
    cols = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col("_x_" + c), F.lit(""))) for c in ENRICH_FIELDS}
    took = F.col("canadian_owned").isNull() & F.col("_x_co").isNotNull()
    co = F.when(took, F.col("_x_co")).otherwise(F.col("canadian_owned"))
    text = F.coalesce(F.col("canadian_owned_text"), F.lit("None"))
    reason = (F.when(took, F.lit(fixed.REASON_SECOND_SOURCE))
              .when(co == F.lit(True), TX.filled(fixed.REASON_OWNED, text))
              .when(co == F.lit(False), TX.filled(fixed.REASON_NOT_OWNED, text))
              .otherwise(F.lit(fixed.REASON_OWNERSHIP_UNKNOWN)))
    out = j.withColumns({**cols, "canadian_owned": co, "canadian_owned_reason": reason})
    return out.drop(*[c for c in out.columns if c.startswith("_x_")])


# B27 ------------------------------------------------------------------------
def origin_from_location(location) -> dict[str, Column]:
    """Ordered rules over the lower-cased location: Canadian place -> true,
    Canadian-made phrase -> true, foreign place -> false, otherwise NULL."""
    loc = TX.col(location)
    low = F.lower(loc)
    # one pass: the first rule, in order, whose needle the text holds
    rules = ([(n, True, True, fixed.REASON_CANADIAN_PLACE.format(lab)) for n, lab in fixed.CANADIAN_INDICATORS]
             + [(p, True, False, fixed.REASON_CANADIAN_PHRASE.format(p)) for p in fixed.CANADIAN_PHRASES]
             + [(n, False, True, fixed.REASON_FOREIGN_PLACE.format(n)) for n in fixed.NON_CANADIAN_INDICATORS])
    table = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(f).alias("flag"), F.lit(q).alias("quoted"), F.lit(r).alias("said"))
                      for n, f, q, r in rules])
    hit = F.try_element_at(F.filter(table, lambda r: low.contains(r["needle"])), F.lit(1))
    reason = F.when(hit["quoted"], F.concat(F.lit("Location '"), loc, hit["said"])).otherwise(hit["said"])
    empty = F.coalesce(loc, F.lit("")) == ""
    return {"made_in_canada": F.when(empty, F.lit(None).cast("boolean")).otherwise(hit["flag"]),
            "made_in_canada_reason": F.when(empty, F.lit(fixed.REASON_NO_LOCATION)).otherwise(reason)}


# B28 ------------------------------------------------------------------------
def parse_verdict(response, compat: bool = False, fallback: bool = True) -> dict[str, Column]:
    """``ANSWER:`` / ``REASON:`` lines of a model reply (the last decisive answer and the
    last reason win).  By default only the tokens YES / NO decide (UNKNOWN -> NULL);
    ``compat`` uses substring tests, where 'NO' inside 'UNKNOWN' means false."""
    r = strip_ws(TX.col(response))
    lines = F.transform(F.split(r, "\n"), lambda l: strip_ws(l))

    def decide(a):
        if compat:
            return F.when(a.contains("YES"), F.lit(True)).when(a.contains("NO"), F.lit(False))
        tok = F.regexp_extract(a, r"^([A-Z]+)", 1)
        return F.when(tok == "YES", F.lit(True)).when(tok == "NO", F.lit(False))

    answers = F.transform(F.filter(lines, lambda l: F.upper(l).startswith("ANSWER:")),
                          lambda l: decide(F.upper(strip_ws(F.substr(l, F.lit(8))))))
    answer = F.try_element_at(F.filter(answers, lambda a: a.isNotNull()), F.lit(-1))
    reasons = F.transform(F.filter(lines, lambda l: F.upper(l).startswith("REASON:")), lambda l: strip_ws(F.substr(l, F.lit(8))))
    reason = F.try_element_at(reasons, F.lit(-1))
    if fallback:
        up = F.upper(r)
        none = answer.isNull() & reason.isNull()
        fb = F.when(up.contains("YES"), F.lit(True)).when(up.contains("NO"), F.lit(False))
        answer = F.when(none, fb).otherwise(answer)
        reason = F.when(none & fb.isNotNull(), r).otherwise(reason)
    return {"flag": answer, "reason": reason}


# B29 ------------------------------------------------------------------------
EXTRACTION_SCHEMA = ("name STRING, products STRING, manufactured_in STRING, where_to_buy STRING, website STRING, "
                     "canadian_owned BOOLEAN, description STRING")


def parse_extraction_json(response) -> Column:
    """Model JSON reply -> typed struct; undecodable -> all fields NULL."""
    return F.from_json(TX.col(response), EXTRACTION_SCHEMA, {"mode": "PERMISSIVE"})


# B30 ------------------------------------------------------------------------
def storefront_detect(website, status, body) -> dict[str, Column]:
    """Storefront probe result -> (flag, meta, reason)."""
    w, s, b = TX.col(website), TX.col(status), TX.col(body)
    keys = F.json_object_keys(b)
    valid = F.try_parse_json(b).isNotNull()
    is_shop = F.coalesce(F.array_contains(keys, "myshopify_domain") | F.array_contains(keys, "id"), F.lit(False))
    myshop = F.coalesce(F.get_json_object(b, "$.myshopify_domain"), F.lit("N/A"))
    no_site = F.coalesce(strip_ws(w), F.lit("")) == ""
    fetched = s.isNotNull() & (s < 400)
    flag = (F.when(no_site | ~F.coalesce(fetched, F.lit(False)), F.lit(None).cast("boolean"))
            .when(s == 200, F.when(valid & is_shop, F.lit(True)).otherwise(F.lit(False)))
            .otherwise(F.lit(False)))
    reason = (F.when(no_site, F.lit(fixed.REASON_NO_WEBSITE))
              .when(~F.coalesce(fetched, F.lit(False)), F.lit(fixed.REASON_FETCH_FAILED))
              .when((s == 200) & valid & is_shop, TX.filled(fixed.REASON_STOREFRONT, myshop))
              .when((s == 200) & valid, F.lit(fixed.REASON_NO_STOREFRONT_FIELDS))
              .when(s == 200, F.lit(fixed.REASON_NO_JSON))
              .otherwise(TX.filled(fixed.REASON_HTTP_STATUS, s)))
    meta = F.when(flag == F.lit(True), b)
    return {"is_shopify_store": flag, "shopify_meta": meta, "shopify_reason": reason}


# B01 / B02 ------------------------------------------------------------------
FALLBACK_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``(base, body)`` -> sitemap URLs: 'sitemap:' lines (case-insensitive, value after
    the first ':'), then three conventional paths; first occurrence wins, order kept."""
    lines = robots.select("base", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("i", "line"))
    declared = lines.where(F.lower(strip_ws("line")).startswith("sitemap:")).select(
        "base", F.col("i").cast("long").alias("ord"), strip_ws(F.substr(strip_ws("line"), F.lit(9))).alias("sitemap_url"))
    base = F.regexp_replace(F.col("base"), "/+$", "")
    fb = robots.select("base", F.posexplode(F.array(*[F.lit(p) for p in FALLBACK_SITEMAPS])).alias("j", "p")).select(
        "base", (F.lit(1 << 40) + F.col("j")).alias("ord"), F.concat(base, F.col("p")).alias("sitemap_url"))
    allu = declared.unionByName(fb)
    first = allu.groupBy("base", "sitemap_url").agg(F.min("ord").alias("ord"))
    return first.select("base", F.dense_rank().over(Window.partitionBy("base").orderBy("ord")).alias("ord"), "sitemap_url")


def sitemap_parse(sitemaps: DataFrame) -> DataFrame:
    """``(url, xml)`` -> ``(url, kind, loc)`` (see ``markup.sitemap_entries``)."""
    e = sitemaps.select("url", F.explode(markup.sitemap(F.col("xml"))).alias("e"))
    return e.select("url", F.col("e.kind").alias("kind"), F.col("e.loc").alias("loc"))


# B17 ------------------------------------------------------------------------
def _num(html: Column, pat: str, kind: str) -> Column:
    return F.when(html.rlike(pat), F.regexp_extract(html, pat, 1).try_cast(kind))


def reviews(html, jsonld_rating: Column | None = None, jsonld_count: Column | None = None) -> dict[str, Column]:
    """Five-source cascade -> (num_reviews, average_rating, source).

    Each later source runs only while the rating is still NULL, and then overwrites the
    count (so a count found without a rating keeps cascading and may be replaced)."""
    h = TX.col(html)
    meta = F.regexp_extract(h, fixed.REVIEW_JSON_VAR, 1)
    n = F.when(meta != "", F.get_json_object(meta, "$.rating_count").try_cast("int"))
    r = F.when(meta != "", F.get_json_object(meta, "$.rating.value").try_cast("double"))
    src = F.when(n.isNotNull() | r.isNotNull(), F.lit("MetafieldReviews (Stamped)"))
    for name, rk, ck in fixed.REVIEW_VENDORS:
        vr = _num(h, rk + fixed.REVIEW_RATING_VALUE, "double")
        vc = _num(h, ck + fixed.REVIEW_COUNT_VALUE, "int")
        run = r.isNull()
        hit = vr.isNotNull() | vc.isNotNull()
        src = F.when(run & hit, F.lit(name)).otherwise(src)
        n = F.when(run & vc.isNotNull(), vc).otherwise(n)
        r = F.when(run & vr.isNotNull(), vr).otherwise(r)
    if jsonld_rating is not None:
        run = r.isNull()
        jr, jc = jsonld_rating.try_cast("double"), jsonld_count.try_cast("int")
        found = (F.coalesce(jr, F.lit(0.0)) != 0) | (F.coalesce(jc, F.lit(0)) != 0)
        src = F.when(run & found, F.lit("Schema.org AggregateRating")).otherwise(src)
        n = F.when(run & jc.isNotNull(), jc).otherwise(n)
        r = F.when(run & jr.isNotNull(), jr).otherwise(r)
    return {"num_reviews": n, "average_rating": r, "source": src}


# B19 ------------------------------------------------------------------------
CONTENT_CLASSES = ("entry-content", "post-content")
CONTENT_MIN = 100


class _Blocks(HTMLParser):
    """Text of the first element of each wanted class, of the first ``article`` and of the whole page."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text = {k: [] for k in (*CONTENT_CLASSES, "article", "page")}
        self.open: dict[str, list] = {}  # block -> [its tag, depth of that tag inside it]
        self.met: set[str] = set()
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        for block in self.open.values():
            block[1] += block[0] == tag
        classes = (dict(attrs).get("class") or "").split()
        for k in (*CONTENT_CLASSES, "article"):
            wanted = tag == "article" if k == "article" else k in classes and tag not in self.VOID
            if wanted and k not in self.met:
                self.met.add(k)
                self.open[k] = [tag, 1]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for k, block in list(self.open.items()):
            block[1] -= block[0] == tag
            if not block[1]:
                del self.open[k]

    def handle_data(self, data):
        if not self.skip:
            lines = [x for x in (x.replace("\xa0", " ").strip() for x in data.split("\n")) if x]
            for k in (*self.open, "page"):
                self.text[k] += lines


def main_text(html: str | None) -> str | None:
    """B19 for one page; nested elements belong to the block that holds them."""
    if html is None:
        return None
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    texts = {k: "\n".join(v) for k, v in parser.text.items()}
    return next((texts[k] for k in (*CONTENT_CLASSES, "article") if len(texts[k]) > CONTENT_MIN), texts["page"])


def content_block(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``content_text`` (and the same as ``raw_text``): the text of the first ``entry-content`` /
    ``post-content`` element or ``<article>`` whose text exceeds 100 characters, else of the whole page without scripts
    and styles; lines joined by newlines.  An Arrow kernel with the standard library's parser: nesting is beyond regex."""
    at = pages.columns.index(html_col)
    schema = pages.withColumns({"content_text": F.lit(None).cast("string"), "raw_text": F.lit(None).cast("string")}).schema

    def kernel(batches):
        for b in batches:
            text = pa.array([main_text(h) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text, text], names=[*b.schema.names, "content_text", "raw_text"])

    return pages.mapInArrow(kernel, schema)


# B03 ------------------------------------------------------------------------
def sitemap_docs(sitemaps: DataFrame) -> DataFrame:
    """B02 with positions: ``(url, kind, pos, loc)`` for every entry of every landed sitemap."""
    e = sitemaps.select("url", F.posexplode(markup.sitemap(F.col("xml"))).alias("pos", "e"))
    return e.select("url", F.col("e.kind").alias("kind"), "pos", F.col("e.loc").alias("loc"))


def _walk_all(roots: DataFrame, nested: DataFrame) -> DataFrame:
    """``(base, doc)`` of every sitemap reachable from the roots.  One join per level; only the level's new documents
    are written (checkpoint in the shared folder), earlier levels are read as they lie."""
    level = roots.select("base", F.col("sitemap_url").alias("doc")).distinct().checkpoint()
    seen = level
    while True:
        grown = level.join(nested, "doc").select("base", F.col("child").alias("doc")).distinct()
        level = grown.join(seen, ["base", "doc"], "left_anti").checkpoint()
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def _walk_first(roots: DataFrame, nested: DataFrame, max_docs: int) -> DataFrame:
    """``(base, doc)`` of the first ``max_docs`` documents per site in exact FIFO order with first-discovery de-dupe:
    each level's new documents are numbered after all earlier ones by (parent order, position).  Numbering needs a
    site's documents in order, so this optional form suits a small ``max_docs``."""
    by_base = Window.partitionBy("base")
    r = roots.groupBy("base", F.col("sitemap_url").alias("doc")).agg(F.min("ord").alias("ord"))
    level = r.select("base", "doc", F.row_number().over(by_base.orderBy("ord")).alias("order")).checkpoint()
    seen = level
    while True:
        grow = level.where(F.col("order") <= max_docs).join(nested, "doc").select(
            "base", F.col("child").alias("doc"), F.col("order").alias("parent_order"), "pos")
        grow = grow.join(seen.select("base", "doc"), ["base", "doc"], "left_anti")
        grow = grow.groupBy("base", "doc").agg(F.min(F.struct("parent_order", "pos")).alias("_f"))
        top = seen.groupBy("base").agg(F.max("order").alias("_top"))
        order = F.col("_top") + F.dense_rank().over(by_base.orderBy("_f.parent_order", "_f.pos"))
        level = grow.join(top, "base").select("base", "doc", order.alias("order")).checkpoint()
        if level.isEmpty():
            return seen.where(F.col("order") <= max_docs).select("base", "doc")
        seen = seen.unionByName(level)


def sitemap_closure(roots: DataFrame, docs: DataFrame, pattern: str = "/", max_docs: int | None = None) -> DataFrame:
    """Breadth-first walk from each site's root sitemaps over nested sitemaps, all of them unless ``max_docs``
    documents per site are asked for; returns ``(base, url)`` of the distinct page URLs they list that contain
    ``pattern`` and are on the site's host."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(roots.sparkSession)
    nested = docs.where(F.col("kind") == "nested").select(F.col("url").alias("doc"), "pos", F.col("loc").alias("child"))
    visited = _walk_all(roots, nested) if max_docs is None else _walk_first(roots, nested, max_docs)
    pages = docs.where(F.col("kind") == "url").select(F.col("url").alias("doc"), F.col("loc").alias("url"))
    found = visited.join(pages, "doc").where(
        F.col("url").contains(pattern) & (U.url_host(F.col("url")) == U.url_host(F.col("base"))))
    return found.select("base", "url").distinct()
