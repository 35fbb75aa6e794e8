"""Registered extraction queries.

Service replies and crawl artefacts that the test tables lack (model verdicts,
extraction replies, storefront probes, robots files, sitemaps) are rendered
from test tables by the ``*_input`` builders below, so each query's work grows
with its source table; the oracle either re-applies the same rules in SQL
(S) or selects the source columns the rendering started from (round trip).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import extract as X
from ..operators import jsonld as J
from ..sources import adapters
from ..sources.tables import Tables, spread
from . import oracle as O
from .registry import register


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _pages(spark, sf_dir):
    return spread(Tables(spark, sf_dir).pages)


def _re(p):
    return "'" + p.replace("'", "''") + "'"


def _resolve_sql(h, b):
    return (f"(case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h}"
            f" when starts_with({h}, '//') then concat(regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), ':', {h})"
            f" when starts_with({h}, '/') then concat(regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), {h})"
            f" when starts_with({h}, '#') or starts_with({h}, '?') then concat(regexp_extract({b}, '^([^?#]*)', 1), {h})"
            f" else concat(regexp_extract({b}, '^([^?#]*/)', 1), {h}) end)")


def link_pages(pages):
    """The pages with their anchors written in all forms: double quotes (page_id % 3 = 0), single quotes (1), none (2),
    and one more anchor with a dot segment, an entity and another attribute before it."""
    m, h = F.col("page_id") % 3, F.col("html")
    html = (F.when(m == 1, F.regexp_replace(h, 'href="([^"]*)"', "href='$1'"))
            .when(m == 2, F.regexp_replace(h, 'href="([^" >]*)"', "href=$1")).otherwise(h))
    return pages.withColumn("html", F.concat(html, F.lit('<a class=x href=" ../z?a=1&amp;b=2 ">z</a>')))


_LINK_PAGES_SQL = """(select url, concat(case page_id % 3 when 1 then regexp_replace(html, 'href="([^"]*)"', 'href=''\\1''', 'g')
   when 2 then regexp_replace(html, 'href="([^" >]*)"', 'href=\\1', 'g') else html end,
   '<a class=x href=" ../z?a=1&amp;b=2 ">z</a>') as html from pages)"""


def _strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _decode_sql(x):
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"), ("&amp", "&")]:  # the last: titles cut inside a reference
        x = f"replace({x}, '{a}', '{b}')"
    return x


# the value of an anchor's href in double, single or no quotes, in the rendered pages
HREF_RE = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
DROP_BLOCKS = ["script", "style", "nav", "footer", "header"]
_HREF_SQL = _strip_sql(_decode_sql("""regexp_replace(quoted, '^["'']|["'']$', '', 'g')"""))
LINKS_SQL = f"""select url, pos, case when starts_with(raw_href, '../')
   then regexp_replace({_resolve_sql('raw_href', 'url')}, '/[^/]+/[.][.]/', '/') else {_resolve_sql('raw_href', 'url')} end as href from (
 select url, {_HREF_SQL} as raw_href, pos from (
 select url, unnest(h) as quoted, generate_subscripts(h, 1) as pos from (
 select url, regexp_extract_all(html, {_re(HREF_RE)}, 1) as h from {_LINK_PAGES_SQL})))"""


def _links(spark, sf_dir):
    return X.page_links(link_pages(_pages(spark, sf_dir)))


@register("b05_page_links", O.with_views("select url, pos, href from links", extra={"links": LINKS_SQL}))
def b05(spark, sf_dir):
    return _links(spark, sf_dir)


def _title_sql(x):
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: case when i = 1 or "
            f"lower(substr({x}, i - 1, 1)) = upper(substr({x}, i - 1, 1)) then case when substr({x}, i, 1) = 'ß' then 'Ss' else upper(substr({x}, i, 1)) end "
            f"else lower(substr({x}, i, 1)) end), '')")


_SEGS = "list_filter(string_split(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '')"


@register("b09_category_path", O.with_views(f"""select url, pos, href,
 {_title_sql("replace(segs[1], '-', ' ')")} as category,
 case when len(segs) >= 2 then {_title_sql("replace(segs[2], '-', ' ')")} end as subcategory
 from (select *, {_SEGS} as segs from links) where len(segs) >= 1""", extra={"links": LINKS_SQL}))
def b09(spark, sf_dir):
    links = _links(spark, sf_dir)
    cp = X.category_path(F.col("href"))
    segs = F.filter(F.split(F.regexp_extract("href", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/"), lambda s: s != "")
    return links.where(F.size(segs) >= 1).select("url", "pos", "href", cp["category"].alias("category"),
                                                  cp["subcategory"].alias("subcategory"))


@register("b04_url_filter", O.with_views("""select url, href from links
 where contains(href, '/en/') and regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)
 and regexp_matches(href, '/[a-z]+$')""", extra={"links": LINKS_SQL}))
def b04(spark, sf_dir):
    return X.url_filter(_links(spark, sf_dir), "url", pattern="/en/", regex="/[a-z]+$").select("url", "href")


@register("b06_category_links", O.with_views("""select distinct url, href as category_url from links
 where regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) = regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)
 and not contains(href, '#') and not contains(href, '?')
 and regexp_replace(href, '/+$', '') <> regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)
 and (contains(href, '/the') or contains(href, '/en'))
 and not regexp_matches(href, '/collections/[^/]+/products/')""", extra={"links": LINKS_SQL}))
def b06(spark, sf_dir):
    return X.category_links(_links(spark, sf_dir), ["/the", "/en"])


@register("b08_listing_links", O.with_views(f"""select listing_url, category_page,
 {_title_sql("replace(segs[1], '-', ' ')")} as category,
 case when len(segs) >= 2 then {_title_sql("replace(segs[2], '-', ' ')")} end as subcategory
 from (select href as listing_url, url as category_page,
   {_SEGS.replace('href', 'url')} as segs
   from links where regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) = regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)
   and not contains(href, '/category/') and not contains(href, '/tag/') and not contains(href, '#')
   qualify row_number() over (partition by href order by url, pos) = 1)""", extra={"links": LINKS_SQL}))
def b08(spark, sf_dir):
    return X.listing_links(_links(spark, sf_dir))


def _page_text_sql(h):
    x = h
    for t in DROP_BLOCKS:
        x = f"regexp_replace({x}, {_re('(?is)<' + t + chr(92) + 'b[^>]*>.*?</' + t + '>')}, ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    x = _decode_sql(x)
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@register("b18_page_text", O.with_views(f"""select page_id, case when length(t) >= 50 then t end as content,
 length(t) as n_chars from (select page_id, {_page_text_sql('html')} as t from pages)"""))
def b18(spark, sf_dir):
    p = _pages(spark, sf_dir)
    t = X.page_text(F.col("html"), min_len=0)
    return p.select("page_id", F.when(F.length(t) >= 50, t).alias("content"), F.length(t).alias("n_chars"))


@register("b18_page_text_markdown", O.with_views(f"""select page_id, case when length(t) >= 50 then t end as content
 from (select page_id, case when page_id % 2 = 0 then concat('# ', url, chr(10), chr(10), repeat('* item ', cast(page_id % 20 as int))) else {_page_text_sql('html')} end as t from pages)"""))
def b18m(spark, sf_dir):
    """Every second page comes with markdown, which is preferred."""
    p = _pages(spark, sf_dir)
    markdown = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("# "), F.col("url"), F.lit("\n\n"), F.repeat(F.lit("* item "), (F.col("page_id") % 20).cast("int"))))
    return p.select("page_id", X.page_text(F.col("html"), markdown=markdown).alias("content"))


@register("b20_title_name", O.with_views(f"""select page_id, case when h1 = '' then null
 when contains(t, ':') then {_strip_sql("substr(t, instr(t, ':') + 1)")} else t end as name
 from (select page_id, h1, {_strip_sql("replace(replace(" + _decode_sql("regexp_replace(h1, '<[^>]*>', '', 'g')") + ", '🍁', ''), '📈', '')")} as t
 from (select page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as h1 from pages))"""))
def b20(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", X.title_name(F.col("html")).alias("name"))


_SKIP = " or ".join(f"starts_with(t, '{s}')" for s in fixed.DESCRIPTION_SKIP_PREFIXES)


@register("b24_description", O.with_views(f"""select page_id, case when len(paras) > 0 then
 array_to_string(list_filter(list_transform(paras, lambda p: {_strip_sql(_decode_sql("regexp_replace(p, '<[^>]*>', '', 'g')"))}),
   lambda t: not ({_SKIP})), ' ') end as description
 from (select page_id, regexp_extract_all(regexp_replace(html, '(<p>|</article>)', '</p>\\1', 'g'), '(?is)<p>(.*?)</p>', 1) as paras from pages)"""))
def b24(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", X.description(F.col("html")).alias("description"))


# --- listings ------------------------------------------------------------------
def _field_sql(pat, body="body"):
    p = _re("(?i)" + pat)
    return f"case when regexp_matches({body}, {p}) then {_strip_sql(f'regexp_extract({body}, {p}, 1)')} end"


_FIELDS_SQL = ",\n ".join(f"{_field_sql(p)} as {k}" for k, p in fixed.LISTING_FIELD_PATTERNS.items())
_FOUND_SQL = " + ".join(f"case when regexp_matches(body, {_re('(?i)' + p)}) then 1 else 0 end"
                        for p in fixed.LISTING_FIELD_PATTERNS.values())
LISTING_FIELDS_SQL = f"select url, {_FIELDS_SQL},\n {_FOUND_SQL} as found from listing_pages"


def _listing_fields(spark, sf_dir):
    lp = adapters.listing_pages(_t(spark, sf_dir))
    f = X.labelled_fields(F.col("body"))
    return lp.select("url", *[f[k].alias(k) for k in fixed.LISTING_FIELD_PATTERNS], f["canadian_owned"].alias("canadian_owned"),
                     f["found"].alias("found"))


@register("b21_labelled_fields", O.with_views("select * from lf", "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def b21(spark, sf_dir):
    return _listing_fields(spark, sf_dir).drop("canadian_owned")


@register("b22_owned_flag", O.with_views("""select url, canadian_owned_text, case when lower(trim(canadian_owned_text)) in ('yes', 'true', '✓', '✔') then true
 when lower(trim(canadian_owned_text)) in ('no', 'false', '✗', '✘') then false end as canadian_owned from lf""",
                                         "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def b22(spark, sf_dir):
    return _listing_fields(spark, sf_dir).select("url", "canadian_owned_text", "canadian_owned")


@register("b25_needs_enrichment", O.with_views("""select url, found, (found < 3 or coalesce(website, '') = '') as needs_enrichment,
 case when not (found < 3 or coalesce(website, '') = '') then null when website is null then 'website missing'
 else concat('regex found only ', cast(found as varchar), ' fields') end as reason from lf""",
                                               "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def b25(spark, sf_dir):
    lf = _listing_fields(spark, sf_dir)
    n = X.needs_enrichment(F.col("found"), F.col("website"))
    return lf.select("url", "found", n["needs_enrichment"].alias("needs_enrichment"), n["reason"].alias("reason"))


def _origin_sql(loc):
    parts = []
    for n, lab in fixed.CANADIAN_INDICATORS:
        parts.append((n, "true", f"concat('Location ''', {loc}, ''' contains Canadian indicator: {lab.replace(chr(39), chr(39) * 2)}')"))
    for p in fixed.CANADIAN_PHRASES:
        parts.append((p, "true", f"'Text implies Canadian manufacturing: ''{p}'''"))
    for n in fixed.NON_CANADIAN_INDICATORS:
        parts.append((n, "false", f"concat('Location ''', {loc}, ''' indicates non-Canadian manufacturing ({n})')"))
    f_cases = " ".join(f"when contains(lower({loc}), '{n.replace(chr(39), chr(39) * 2)}') then {f}" for n, f, _ in parts)
    r_cases = " ".join(f"when contains(lower({loc}), '{n.replace(chr(39), chr(39) * 2)}') then {r}" for n, _, r in parts)
    empty = f"coalesce({loc}, '') = ''"
    return (f"case when {empty} then null {f_cases} end",
            f"case when {empty} then 'No manufacturing location provided' {r_cases} end")


_OF, _OR = _origin_sql("manufactured_in")


@register("b27_origin_from_location", O.with_views(f"select url, manufactured_in, {_OF} as made_in_canada, {_OR} as made_in_canada_reason from lf",
                                                   "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def b27(spark, sf_dir):
    lf = _listing_fields(spark, sf_dir)
    o = X.origin_from_location(F.col("manufactured_in"))
    return lf.select("url", "manufactured_in", o["made_in_canada"].alias("made_in_canada"),
                     o["made_in_canada_reason"].alias("made_in_canada_reason"))


# --- rendered service replies (round trips) -----------------------------------------
def verdicts_input(t):
    lab = t.labels
    ans = F.when(F.col("quality") == 1, F.lit("YES")).when(F.col("toxic") == 1, F.lit("UNKNOWN")).otherwise(F.lit("NO"))
    return lab.select(F.col("doc_id").alias("url"), F.concat(F.lit("ANSWER: "), ans, F.lit("\nREASON: toxic="),
                                                           F.col("toxic").cast("string")).alias("response"))


@register("b28_parse_verdict", """select doc_id as url, case when quality = 1 then true when toxic = 1 then null else false end as flag,
 concat('toxic=', cast(toxic as varchar)) as reason from labels""")
def b28(spark, sf_dir):
    v = verdicts_input(_t(spark, sf_dir))
    r = X.parse_verdict(F.col("response"))
    return v.select("url", r["flag"].alias("flag"), r["reason"].alias("reason"))


@register("b28_parse_verdict_compat", """select doc_id as url, quality = 1 as flag,
 concat('toxic=', cast(toxic as varchar)) as reason from labels""")
def b28c(spark, sf_dir):
    v = verdicts_input(_t(spark, sf_dir))
    r = X.parse_verdict(F.col("response"), compat=True)
    return v.select("url", r["flag"].alias("flag"), r["reason"].alias("reason"))


def extractions_input(t):
    s = t.supplier
    bad = F.col("s_suppkey") % 7 == 0
    js = F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("goods").alias("products"),
                            F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("manufactured_in"),
                            F.lit("Online").alias("where_to_buy"),
                            F.concat(F.lit("https://shop"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("website"),
                            (F.col("s_suppkey") % 2 == 0).alias("canadian_owned"),
                            F.lit(None).cast("string").alias("description")))
    return s.select(F.concat(F.lit("https://dir.example.com/"), F.col("s_suppkey").cast("string")).alias("url"),
                    F.when(bad, F.lit("{not json")).otherwise(js).alias("response"))


@register("b29_parse_extraction_json", """select concat('https://dir.example.com/', cast(s_suppkey as varchar)) as url,
 case when s_suppkey % 7 <> 0 then s_name end as name,
 case when s_suppkey % 7 <> 0 then concat('Nation ', cast(s_nationkey as varchar)) end as manufactured_in,
 case when s_suppkey % 7 <> 0 then concat('https://shop', cast(s_suppkey as varchar), '.example.com') end as website,
 case when s_suppkey % 7 <> 0 then s_suppkey % 2 = 0 end as canadian_owned,
 cast(null as varchar) as description from supplier""")
def b29(spark, sf_dir):
    e = extractions_input(_t(spark, sf_dir)).select("url", X.parse_extraction_json(F.col("response")).alias("x"))
    return e.select("url", "x.name", "x.manufactured_in", "x.website", "x.canadian_owned", "x.description")


@register("b26_fill_missing", O.with_views("""select lf.url, coalesce(nullif(lf.name, ''), case when s.s_suppkey % 7 <> 0 then s.s_name end) as name,
 coalesce(nullif(lf.where_to_buy, ''), case when s.s_suppkey % 7 <> 0 then 'Online' end) as where_to_buy,
 case when lf.canadian_owned is null and s.s_suppkey % 7 <> 0 then s.s_suppkey % 2 = 0 else lf.canadian_owned end as canadian_owned,
 case when lf.canadian_owned is null and s.s_suppkey % 7 <> 0 then 'AI extraction'
      when lf.canadian_owned then concat('Page explicitly states Canadian-Owned: ''', lf.canadian_owned_text, '''')
      when not lf.canadian_owned then concat('Page states not Canadian-Owned: ''', lf.canadian_owned_text, '''')
      else 'No Canadian ownership information found on page' end as canadian_owned_reason
 from (select *, case when lower(trim(canadian_owned_text)) in ('yes', 'true', '✓', '✔') then true
   when lower(trim(canadian_owned_text)) in ('no', 'false', '✗', '✘') then false end as canadian_owned from lf) lf
 left join supplier s on concat('https://dir.example.com/', cast(s.s_suppkey as varchar)) = lf.url""",
                                           "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def b26(spark, sf_dir):
    t = _t(spark, sf_dir)
    lf = _listing_fields(spark, sf_dir)
    ex = extractions_input(t).select("url", X.parse_extraction_json(F.col("response")).alias("x")).select("url", "x.*")
    out = X.fill_missing(lf, ex)
    return out.select("url", "name", "where_to_buy", "canadian_owned", "canadian_owned_reason")


def probes_input(t):
    c = t.customer
    m = F.col("c_custkey") % 5
    url = F.concat(F.lit("https://shop"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    status = F.when(m <= 2, F.lit(200)).when(m == 3, F.lit(404)).otherwise(F.lit(None).cast("int"))
    body = (F.when(m == 0, F.concat(F.lit('{"myshopify_domain":"shop'), F.col("c_custkey").cast("string"),
                                    F.lit('.myshopify.com","id":'), F.col("c_custkey").cast("string"), F.lit("}")))
            .when(m == 1, F.lit("[]")).when(m == 2, F.lit("{bad")))
    return c.select(url.alias("url"), url.alias("website"), status.alias("status"), body.alias("body"))


@register("b30_storefront_detect", """select concat('https://shop', cast(c_custkey as varchar), '.example.com') as url,
 case c_custkey % 5 when 0 then true when 1 then false when 2 then false end as is_shopify_store,
 case c_custkey % 5 when 0 then concat('Found meta.json (myshopify_domain=shop', cast(c_custkey as varchar), '.myshopify.com)')
  when 1 then 'meta.json missing Shopify fields' when 2 then 'meta.json not valid JSON' else 'meta.json fetch failed' end as shopify_reason
 from customer""")
def b30(spark, sf_dir):
    p = probes_input(_t(spark, sf_dir))
    d = X.storefront_detect(F.col("website"), F.col("status"), F.col("body"))
    return p.select("url", d["is_shopify_store"].alias("is_shopify_store"), d["shopify_reason"].alias("shopify_reason"))


def robots_input(t):
    """One robots file per site, declaring the sitemap of the site's first page (smallest id)."""
    p = t.pages.select(X.origin(F.col("url")).alias("base"), "page_id").groupBy("base").agg(
        F.min("page_id").alias("page_id"))
    base = F.col("base")
    body = F.concat(F.lit("User-agent: *\nDisallow: /cart\nSITEMAP: "), base, F.lit("/sm-"), F.col("page_id").cast("string"),
                    F.lit(".xml\nsitemap: "), base, F.lit("/sitemap.xml\n"))
    return p.select("base", body.alias("body"))


@register("b01_robots_sitemaps", """select base, ord, sitemap_url from (
 select base, row_number() over (partition by base order by o) as ord, sitemap_url from (
  select base, sitemap_url, min(o) as o from (
   select base, 0 as o, concat(base, '/sm-', cast(min(page_id) as varchar), '.xml') as sitemap_url from pb group by base
   union all select base, 1, concat(base, '/sitemap.xml') from pb
   union all select base, 2, concat(base, '/sitemap_index.xml') from pb
   union all select base, 3, concat(base, '/sitemap-index.xml') from pb) group by base, sitemap_url))""".replace(
    "from pb", "from (select regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as base, page_id from pages) pb"))
def b01(spark, sf_dir):
    return X.robots_sitemaps(robots_input(_t(spark, sf_dir)))


def sitemaps_input(t):
    """Landed sitemaps, one per page: a sitemapindex (odd ids), a urlset (even ids), and for ids
    ending in 4 or 9 a broken HTML page (unclosed tags, bare '&') with absolute links and a loc."""
    p = t.pages
    idx = F.col("page_id") % 2 == 1
    broken = F.concat(F.lit("<html><body><p>Tom & Jerry<br><a href=\""), X.origin(F.col("url")), F.lit("/cat/\">c</a>"),
                      F.lit("<a href=\" "), X.origin(F.col("url")), F.lit("/p/"), F.col("page_id").cast("string"),
                      F.lit(" \">p</a><a href=\"/rel\">r</a><loc>"), F.col("url"), F.lit("</loc></body>"))
    xml = F.when(F.col("page_id") % 5 == 4, broken).when(idx, F.concat(F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
                                     '<sitemap><loc>'), X.origin(F.col("url")), F.lit("/sm-"), F.col("page_id").cast("string"),
                               F.lit(".xml</loc></sitemap></sitemapindex>"))).otherwise(
        F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.col("url"),
                 F.lit(" </loc></url><url><loc>"), X.origin(F.col("url")), F.lit("/p/"), F.col("page_id").cast("string"),
                 F.lit("</loc></url></urlset>")))
    return p.select(F.concat(F.lit("sm-"), F.col("page_id").cast("string")).alias("url"), xml.alias("xml"))


@register("b02_sitemap_parse", """select concat('sm-', cast(page_id as varchar)) as url, 'nested' as kind,
 concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), '/sm-', cast(page_id as varchar), '.xml') as loc
 from pages where page_id % 2 = 1 and page_id % 5 <> 4
 union all select concat('sm-', cast(page_id as varchar)), 'url', url from pages where page_id % 2 = 0 and page_id % 5 <> 4
 union all select concat('sm-', cast(page_id as varchar)), 'url',
 concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), '/p/', cast(page_id as varchar)) from pages
 where page_id % 2 = 0 and page_id % 5 <> 4
 union all select concat('sm-', cast(page_id as varchar)), 'nested',
 concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), '/cat/') from pages where page_id % 5 = 4
 union all select concat('sm-', cast(page_id as varchar)), 'url',
 concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), '/p/', cast(page_id as varchar)) from pages where page_id % 5 = 4
 union all select concat('sm-', cast(page_id as varchar)), 'url', url from pages where page_id % 5 = 4""")
def b02(spark, sf_dir):
    return X.sitemap_parse(sitemaps_input(_t(spark, sf_dir)))


# --- JSON-LD round trip over rendered product pages ----------------------------------
def _best(spark, sf_dir):
    pp = spread(adapters.product_pages(_t(spark, sf_dir)))
    return J.best_schema(J.jsonld_products(J.jsonld_blocks(pp)))


@register("b10_jsonld_blocks", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 1 as block_pos from part""")
def b10(spark, sf_dir):
    return J.jsonld_blocks(adapters.product_pages(_t(spark, sf_dir))).select("url", "block_pos")


@register("b11_jsonld_products", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 1 as pos, p_name as name from part""")
def b11(spark, sf_dir):
    pr = J.jsonld_products(J.jsonld_blocks(adapters.product_pages(_t(spark, sf_dir))))
    return pr.select("url", "pos", "name")


@register("b13_product_fields", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 p_name as name, cast(p_partkey as varchar) as sku, p_brand as brand, cast(cast(p_retailprice as decimal(12,2)) as varchar) as price,
 'CAD' as currency, 5 as score from part""")
def b13(spark, sf_dir):
    return _best(spark, sf_dir).select("url", "name", "sku", "brand", "price", "currency", "score")


@register("b15_image_dedupe", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 ['a.jpg', 'b.png'] as images, 1 as images_removed from part""")
def b15(spark, sf_dir):
    return J.image_dedupe(_best(spark, sf_dir)).select("url", "images", "images_removed")


@register("b16_image_manifest", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url, i as idx,
 img as image_url,
 concat('https_shop.example.com_products_', cast(p_partkey as varchar), '_img', cast(i as varchar), case when i = 1 then '.png' else '.jpg' end) as file_name
 from part, (select 0 as i, 'a.jpg' as img union all select 1, 'b.png')""")
def b16(spark, sf_dir):
    return J.image_manifest(J.image_dedupe(_best(spark, sf_dir)))


# --- B07, B12, B17, B19, B23 ---------------------------------------------------------
@register("b07_product_links", O.with_views("""select product_url, min_by(url, struct_pack(url := url, pos := pos)) as first_category
 from (select url, pos, split_part(href, '?', 1) as product_url from links where regexp_matches(href, '/[a-z]{4,}$'))
 group by product_url""", extra={"links": LINKS_SQL}))
def b07(spark, sf_dir):
    return X.product_links(_links(spark, sf_dir), r"/[a-z]{4,}$")


_FIRSTS_SQL = """select first_category, count(*) as n from (select min_by(url, struct_pack(url := url, pos := pos)) as first_category
   from (select url, pos, split_part(href, '?', 1) as product_url from links where regexp_matches(href, '/[a-z]{4,}$')) group by product_url)
  group by first_category"""


@register("b07_new_per_category", O.with_views("""select c.url as category, coalesce(f.n, 0) as new_products
 from (select distinct url from links) c left join firsts f on f.first_category = c.url""", extra={"links": LINKS_SQL, "firsts": _FIRSTS_SQL}))
def b07n(spark, sf_dir):
    """How many product links each page showed first."""
    links = _links(spark, sf_dir)
    return X.new_per_category(links, X.product_links(links, r"/[a-z]{4,}$"))


@register("b12_best_schema", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 1 as block_pos, 1 as pos, 5 as score from part""")
def b12(spark, sf_dir):
    return _best(spark, sf_dir).select("url", "block_pos", "pos", "score")


@register("b23_website_fallback", O.with_views("""select lf.url, coalesce(nullif(lf.website, ''), e.first_external) as website from lf
 left join (select url, min_by(href, pos) as first_external from links where starts_with(href, 'http')
   and not starts_with(href, 'https://dir.example.com') group by url) e on e.url = lf.url""",
                                               "listing_pages", extra={"lf": LISTING_FIELDS_SQL, "links": LINKS_SQL}))
def b23(spark, sf_dir):
    lf = _listing_fields(spark, sf_dir)
    return X.website_fallback(lf, _links(spark, sf_dir), "https://dir.example.com").select("url", "website")


def review_pages_input(t):
    """Product pages carrying review markup of five vendors (by part key), from the line items of
    each part; ratings in JSON-LD lie deep in the second node of a graph, after one with a repeated key."""
    li = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        (F.floor(F.lit(200) + F.sum("l_quantity") * 25 / 4 / F.count(F.lit(1))) / 100).alias("a"))
    n, a = F.col("n").cast("string"), F.col("a").cast("string")
    m = F.col("l_partkey") % 5
    mark = (F.when(m == 0, F.concat(F.lit('MetafieldReviews = {"rating":{"scale_min":"1.0","scale_max":"5.0","value":"'), a,
                                    F.lit('"},"rating_count":'), n, F.lit("};")))
            .when(m == 1, F.concat(F.lit('MetafieldYotpoRating = "'), a, F.lit('"; MetafieldYotpoCount = "'), n, F.lit('";')))
            .when(m == 2, F.concat(F.lit('MetafieldYotpoCount = "7"; MetafieldLooxRating = "'), a,
                                   F.lit('"; MetafieldLooxCount = "'), n, F.lit('";')))
            .when(m == 3, F.concat(F.lit("okendoProductReviewAverageValue = "), a, F.lit("; okendoProductReviewCount = "), n, F.lit(";")))
            .otherwise(F.concat(F.lit("</script><script type='application/ld+json'>"), F.lit('{"@graph":[{"@type":"WebSite","a":1,"a":2},'
                                '{"mainEntity":{"@type":"Product","aggregateRating":{"ratingValue":"'),
                                a, F.lit('","reviewCount":"'), n, F.lit('"}}}]}')))
            )
    return li.select(F.concat(F.lit("https://shop.example.com/products/"), F.col("l_partkey").cast("string")).alias("url"),
                     F.concat(F.lit("<html><head><script>"), mark, F.lit("</script></head><body></body></html>")).alias("html"))


@register("b17_reviews", """select concat('https://shop.example.com/products/', cast(l_partkey as varchar)) as url,
 cast(count(*) as int) as num_reviews, floor(200 + sum(l_quantity) * 25 / 4 / count(*)) / 100 as average_rating,
 case l_partkey % 5 when 0 then 'MetafieldReviews (Stamped)' when 1 then 'Yotpo' when 2 then 'Loox' when 3 then 'Okendo'
   else 'Schema.org AggregateRating' end as source
 from lineitem group by l_partkey""")
def b17(spark, sf_dir):
    pages = review_pages_input(_t(spark, sf_dir))
    agg = J.jsonld_aggregate_rating(J.jsonld_blocks(pages))
    j = pages.join(agg, "url", "left")
    r = X.reviews(F.col("html"), F.col("jr"), F.col("jc"))
    return j.select("url", *[c.alias(k) for k, c in r.items()])


def _text_of_sql(x):
    t = _decode_sql(f"replace(replace(regexp_replace({x}, '<[^>]*>', chr(10), 'g'), '&copy;', '©'), '&middot;', '·')")
    return (f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), "
            f"lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))")


_ART = _text_of_sql("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)")
_WHOLE = _text_of_sql("regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g')")


@register("b19_content_block", O.with_views(f"""select page_id, case when length(a) > 100 then a else w end as content_text
 from (select page_id, {_ART} as a, {_WHOLE} as w from pages)"""))
def b19(spark, sf_dir):
    return X.content_block(_pages(spark, sf_dir).select("page_id", "html")).select("page_id", "content_text")


# --- B03: sitemap closure over sitemaps rendered from pages ----------------------------------
def closure_input(t):
    """Roots: one root sitemap per page (``{origin}/sm-{id}.xml``, ordered by page id per site).
    Documents: sm-{id} is an index pointing to deep-{id} when id % 3 = 0, else a urlset of the
    page URL and ``/p/{id}``; deep-{id} lists ``/d/{id}`` and ``/p/{id}``."""
    p = spread(t.pages)
    o = X.origin(F.col("url"))
    sid = F.col("page_id").cast("string")
    roots = p.select(o.alias("base"), F.col("page_id").alias("ord"), F.concat(o, F.lit("/sm-"), sid, F.lit(".xml")).alias("sitemap_url"))
    ns = '<?xml version="1.0"?><{t} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    sm = F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit(ns.format(t="sitemapindex") + "<sitemap><loc>"), o, F.lit("/deep-"), sid, F.lit(".xml</loc></sitemap></sitemapindex>"))
    ).otherwise(F.concat(F.lit(ns.format(t="urlset") + "<url><loc>"), F.col("url"), F.lit("</loc></url><url><loc>"), o,
                         F.lit("/p/"), sid, F.lit("</loc></url></urlset>")))
    deep = F.concat(F.lit(ns.format(t="urlset") + "<url><loc>"), o, F.lit("/d/"), sid, F.lit("</loc></url><url><loc>"), o,
                    F.lit("/p/"), sid, F.lit("</loc></url></urlset>"))
    docs = p.select(F.concat(o, F.lit("/sm-"), sid, F.lit(".xml")).alias("url"), sm.alias("xml")).unionByName(
        p.where(F.col("page_id") % 3 == 0).select(F.concat(o, F.lit("/deep-"), sid, F.lit(".xml")).alias("url"), deep.alias("xml")))
    return roots, docs


@register("b03_sitemap_closure", """with pg as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as base from pages),
 found as (
  select base, url from pg where page_id % 3 <> 0
  union all select base, concat(base, '/p/', cast(page_id as varchar)) from pg
  union all select base, concat(base, '/d/', cast(page_id as varchar)) from pg where page_id % 3 = 0)
 select distinct base, url from found
 where regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)""")
def b03(spark, sf_dir):
    roots, docs = closure_input(_t(spark, sf_dir))
    return X.sitemap_closure(roots, X.sitemap_docs(docs), pattern="/")


# --- B14: Open Graph fallback over pages rendered from part ------------------------------------
def og_pages_input(t):
    """Product pages whose JSON-LD carries only the sku for odd part keys (name, description
    and images must come from og meta tags, written in both attribute orders)."""
    p = spread(t.part)
    odd = F.col("p_partkey") % 2 == 1
    key = F.col("p_partkey").cast("string")
    ld = F.when(odd, F.concat(F.lit('{"@type":"Product","sku":"'), key, F.lit('"}'))).otherwise(
        F.concat(F.lit('{"@type":"Product","sku":"'), key, F.lit('","name":"'), F.col("p_name"),
                 F.lit('","description":"'), F.col("p_type"), F.lit('","image":"ld.jpg"}')))
    html = F.concat(
        F.lit('<html><head><meta property="og:title" content=" '), F.col("p_name"), F.lit(' ">'),
        F.lit('<meta content="'), F.col("p_type"), F.lit('" property="og:description">'),
        F.lit('<meta property="og:image" content="og-'), key, F.lit('.jpg">'),
        F.lit('<script type="application/ld+json">'), ld, F.lit("</script></head><body></body></html>"))
    return p.select(F.concat(F.lit("https://shop.example.com/products/"), key).alias("url"), html.alias("html"))


@register("b14_og_fallback", """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 p_name as name, p_type as description,
 case when p_partkey % 2 = 1 then [concat('og-', cast(p_partkey as varchar), '.jpg')] else ['ld.jpg'] end as images from part""")
def b14(spark, sf_dir):
    pages = og_pages_input(_t(spark, sf_dir))
    best = J.best_schema(J.jsonld_products(J.jsonld_blocks(pages)))
    return J.og_fallback(best.select("url", "name", "description", "images"), pages)


@register("g04_ordered_distinct", O.with_views("""select url, pos, href from links
 qualify row_number() over (partition by url, href order by pos) = 1""", extra={"links": LINKS_SQL}))
def g04(spark, sf_dir):
    from ..operators.catalog import ordered_distinct
    return ordered_distinct(_links(spark, sf_dir), ["url"], "href", "pos")
