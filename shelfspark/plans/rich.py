"""Queries over fixtures of many shapes (several JSON-LD blocks and products a page, listings with gaps, links of all store
types, homepages, rejects) and over paths that the plainer fixtures do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..functions import urls as U
from ..operators import catalog as C
from ..operators import extract as X
from ..operators import jsonld as J
from ..operators import ranking as RK
from ..sources import adapters
from ..sources.tables import Tables, spread
from . import oracle as O
from .catalog import _NEW, relanded_input
from .extract import _SEGS, _field_sql, _re, _title_sql
from .registry import register
from .search import _enc, _ranked, _reranked
from .search_sql import ranking_sql, ranking_views, views


# --- product pages (B10-B13, B15, B16) ----------------------------------------------------------------------
def rich_product_pages(t):
    """By p_partkey % 4: one product without offers; an undecodable block before a product of two types; a graph and an
    array with three products, one of them lower-cased, nested and with repeated, empty and non-text images; a tie."""
    p, key, name, brand = t.part, F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    block = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[x if not isinstance(x, str) else F.lit(x) for x in parts], F.lit("</script>"))
    forms = [
        block('{"@type":"Product","name":"', name, '","image":"i.jpg"}'),
        F.concat(block('{"@type": broken'), block('{"@type":["Thing","Product"],"name":"', name, '","sku":', key, ',"brand":"', brand,
                                                 '","offers":{"price":', F.col("p_size").cast("string"), ',"priceCurrency":"USD","availability":"InStock"}}')),
        F.concat(block('{"@graph":[{"@type":"Organization","name":"O"},{"@type":"Product","offers":{"price":"1"},"image":["a.jpg"]}]}'),
                 block('[{"@type":"Product","name":"first"},{"@type":"product","name":"', name, '","brand":{"name":"', brand,
                       '"},"offers":[{"price":"9.50","priceCurrency":"CAD"},{"price":"8"}],"image":["x.png","","x.png",5,"y.jpg"],}]')),
        F.concat(block('{"@type":"Product","name":"A-', name, '","offers":{"price":"1"}}'), block('{"@type":"Product","name":"B-', name, '","offers":{"price":"2"}}')),
    ]
    m = F.col("p_partkey") % 4
    html = F.when(m == 0, forms[0]).when(m == 1, forms[1]).when(m == 2, forms[2]).otherwise(forms[3])
    return p.select(F.concat(F.lit("https://shop.example.com/rich/"), key).alias("url"), F.concat(F.lit("<html><head>"), html, F.lit("</head></html>")).alias("html"))


_RICH = "select concat('https://shop.example.com/rich/', cast(p_partkey as varchar)) as url, p_partkey % 4 as m, p_partkey as k, p_name as n, p_brand as b, p_size as s from part"
_PRODUCTS = """select url, k, m, 1 as block_pos, 1 as pos, n as name, cast(null as varchar) as sku, cast(null as varchar) as brand, cast(null as varchar) as price,
  cast(null as varchar) as currency, cast(null as varchar) as availability, 3 as score, ['i.jpg'] as images from rich where m = 0
 union all select url, k, m, 2, 1, n, cast(k as varchar), b, cast(s as varchar), 'USD', 'InStock', 4, cast([] as varchar[]) from rich where m = 1
 union all select url, k, m, 1, 1, null, null, null, '1', null, null, 3, ['a.jpg'] from rich where m = 2
 union all select url, k, m, 2, 1, 'first', null, null, null, null, null, 2, cast([] as varchar[]) from rich where m = 2
 union all select url, k, m, 2, 2, n, null, b, '9.50', 'CAD', null, 5, ['x.png', '', 'x.png', 'y.jpg'] from rich where m = 2
 union all select url, k, m, 1, 1, concat('A-', n), null, null, '1', null, null, 4, cast([] as varchar[]) from rich where m = 3
 union all select url, k, m, 2, 1, concat('B-', n), null, null, '2', null, null, 4, cast([] as varchar[]) from rich where m = 3"""
_BEST = "select * from products qualify row_number() over (partition by url order by score desc, block_pos, pos) = 1"


def _rich_sql(body: str) -> str:
    return f"with rich as ({_RICH}), products as ({_PRODUCTS}), best as ({_BEST}) {body}"


def _products(spark, sf_dir):
    return J.jsonld_products(J.jsonld_blocks(spread(rich_product_pages(Tables(spark, sf_dir)))))


@register("b10_jsonld_blocks_rich", _rich_sql("select distinct url, block_pos from products"))
def b10(spark, sf_dir):
    return J.jsonld_blocks(spread(rich_product_pages(Tables(spark, sf_dir)))).select("url", "block_pos")


@register("b11_jsonld_products_rich", _rich_sql("select url, block_pos, pos, name, price, score from products"))
def b11(spark, sf_dir):
    return _products(spark, sf_dir).select("url", "block_pos", "pos", "name", "price", "score")


@register("b12_best_schema_rich", _rich_sql("select url, block_pos, pos, score from best"))
def b12(spark, sf_dir):
    return J.best_schema(_products(spark, sf_dir)).select("url", "block_pos", "pos", "score")


@register("b13_product_fields_rich", _rich_sql("select url, name, sku, brand, price, currency, availability from best"))
def b13(spark, sf_dir):
    return J.best_schema(_products(spark, sf_dir)).select("url", "name", "sku", "brand", "price", "currency", "availability")


_IMAGES = "select url, k, m, case when m = 2 then ['x.png', 'y.jpg'] else images end as images, case when m = 2 then 2 else 0 end as images_removed from best"


@register("b15_image_dedupe_rich", _rich_sql(f"select url, images, images_removed from ({_IMAGES})"))
def b15(spark, sf_dir):
    return J.image_dedupe(J.best_schema(_products(spark, sf_dir))).select("url", "images", "images_removed")


@register("b16_image_manifest_rich", _rich_sql(f"""select url, cast(i - 1 as int) as idx, image_url, concat('https_shop.example.com_rich_', cast(k as varchar), '_img',
  cast(i - 1 as varchar), regexp_extract(image_url, '[.][a-z]+$')) as file_name
 from (select url, k, unnest(images) as image_url, generate_subscripts(images, 1) as i from ({_IMAGES}))"""))
def b16(spark, sf_dir):
    return J.image_manifest(J.image_dedupe(J.best_schema(_products(spark, sf_dir))))


# --- listings (B23, B25, B31, E13) --------------------------------------------------------------------------
def rich_listings(t):
    """By s_suppkey % 4: all fields; no website; two fields only; a name only.  ``html`` of the second kind links to other
    sites after its own, that of the fourth only to itself."""
    key, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    name, site = F.concat(F.lit("Name: "), F.col("s_name")), F.concat(F.lit("\nWebsite: shop"), key, F.lit(".example.com"))
    body = (F.when(m == 0, F.concat(name, F.lit("\nProducts: goods\nManufactured In: Peru"), site))
            .when(m == 1, F.concat(name, F.lit("\nProducts: goods\nMade In: Ontario")))
            .when(m == 2, F.concat(F.lit("Company: "), F.col("s_name"), site)).otherwise(name))
    own = '<a href="/about">a</a><a href="https://dir.example.com/x">d</a>'
    html = F.when(m == 1, F.concat(F.lit(own + "<!-- <a href='https://no.example.org'> --><a title='a>b' href='https://ext.example.org/"), key, F.lit("'>e</a><a href=https://later.example.org>l</a>")))
    return t.supplier.select(F.concat(F.lit("https://dir.example.com/l/"), key).alias("url"), body.alias("body"), html.when(m == 3, F.lit(own)).otherwise(F.lit("")).alias("html"), "s_suppkey")


_LISTINGS = """select concat('https://dir.example.com/l/', cast(s_suppkey as varchar)) as url, s_suppkey, s_suppkey % 4 as m,
 case s_suppkey % 4 when 0 then concat('Name: ', s_name, chr(10), 'Products: goods', chr(10), 'Manufactured In: Peru', chr(10), 'Website: shop', cast(s_suppkey as varchar), '.example.com')
 when 1 then concat('Name: ', s_name, chr(10), 'Products: goods', chr(10), 'Made In: Ontario')
 when 2 then concat('Company: ', s_name, chr(10), 'Website: shop', cast(s_suppkey as varchar), '.example.com') else concat('Name: ', s_name) end as body from supplier"""
_FIELDS = ", ".join(f"{_field_sql(p)} as {k}" for k, p in fixed.LISTING_FIELD_PATTERNS.items())
_FOUND = " + ".join(f"case when regexp_matches(body, {_re('(?i)' + p)}) then 1 else 0 end" for p in fixed.LISTING_FIELD_PATTERNS.values())


def _listing_sql(body: str) -> str:
    return f"with listings as ({_LISTINGS}), lf as (select url, s_suppkey, m, {_FIELDS}, {_FOUND} as found from listings) {body}"


def _fields(spark, sf_dir):
    lp = rich_listings(Tables(spark, sf_dir))
    f = X.labelled_fields(F.col("body"))
    return lp.select("url", "s_suppkey", *[f[k].alias(k) for k in fixed.LISTING_FIELD_PATTERNS], f["found"].alias("found"))


@register("b25_needs_enrichment_rich", _listing_sql("""select url, found, m <> 0 as needs_enrichment,
 case m when 0 then null when 2 then 'regex found only 2 fields' else 'website missing' end as reason from lf"""))
def b25(spark, sf_dir):
    lf = _fields(spark, sf_dir)
    n = X.needs_enrichment(F.col("found"), F.col("website"))
    return lf.select("url", "found", n["needs_enrichment"].alias("needs_enrichment"), n["reason"].alias("reason"))


@register("e13_extraction_methods_rich", _listing_sql("select case when m = 0 then 'regex' else 'second_source' end as method, count(*) as n from lf group by 1"))
def e13(spark, sf_dir):
    lf = _fields(spark, sf_dir)
    need = X.needs_enrichment(F.col("found"), F.col("website"))["needs_enrichment"]
    return lf.groupBy(F.when(need, F.lit("second_source")).otherwise(F.lit("regex")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


@register("b23_website_fallback_rich", _listing_sql("""select url, case m when 1 then concat('https://ext.example.org/', cast(s_suppkey as varchar)) when 3 then null
 else website end as website from lf"""))
def b23(spark, sf_dir):
    links = X.page_links(rich_listings(Tables(spark, sf_dir)))
    return X.website_fallback(_fields(spark, sf_dir), links, "https://dir.example.com").select("url", "website")


_DESCRIBED = "case when s_suppkey % 2 = 0 then repeat(concat('About ', s_name, '. '), 40) end"


@register("b31_listing_embedding_text_described", _listing_sql(f"""select lf.url, concat_ws(' | ', case when coalesce(name, '') <> '' then concat('Company: ', name) end,
  case when coalesce(products, '') <> '' then concat('Products: ', products) end, case when d is not null then concat('Description: ', left(d, 500)) end,
  case when coalesce(manufactured_in, '') <> '' then concat('Manufactured in: ', manufactured_in) end) as text
 from lf join (select s_suppkey, {_DESCRIBED} as d from supplier) using (s_suppkey)"""))
def b31(spark, sf_dir):
    """B31 of listings with a long description, of which the text takes the first 500 characters."""
    s = Tables(spark, sf_dir).supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.concat(F.lit("About "), "s_name", F.lit(". ")), F.lit(40))).alias("d"))
    lf = _fields(spark, sf_dir).join(s, "s_suppkey")
    return lf.select("url", TX.listing_embedding_text("name", "products", "d", "manufactured_in", "url").alias("text"))


# --- links by store type and of homepages (B06, B07, B08) ----------------------------------------------------
_PATHS = ["/collections/c{m}/products/p{i}?v=1", "/products/p{i}", "/product/q{i}", "/x-{i}.html", "/p/{i}", "/women/w{m}", "/collections/c{m}", "/about", "/category/c{m}", "/tag/t{m}", "/new/n{m}#top"]


def store_pages(t):
    """The pages with links of every store type; every tenth page is a site's homepage."""
    i, m = (F.col("page_id") % 50).cast("string"), (F.col("page_id") % 5).cast("string")
    links = []
    for p in _PATHS:
        href = F.lit("")
        for x in p.replace("{i}", "\0i\0").replace("{m}", "\0m\0").split("\0"):
            href = F.concat(href, i if x == "i" else m if x == "m" else F.lit(x))
        links.append(F.concat(F.lit("<a href='"), href, F.lit("'>x</a>")))
    return t.pages.select("page_id", "url", F.concat(*links).alias("html"))


def _path_sql(p: str) -> str:
    p = p.replace("{i}", "', cast(page_id % 50 as varchar), '").replace("{m}", "', cast(page_id % 5 as varchar), '")
    return f"concat(origin, '{p}')"


_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_STORE_LINKS = f"""select page_id, url, href, pos from (select page_id, url, unnest(h) as href, generate_subscripts(h, 1) as pos from (
 select page_id, url, [{', '.join(_path_sql(p) for p in _PATHS)}] as h from (select page_id, url, {_ORIGIN} as origin from pages)))"""


@register("b07_store_product_links", f"with links as ({_STORE_LINKS}) " + " union all ".join(
    f"select '{s}' as store, split_part(href, '?', 1) as product_url, min(url) as first_category from links where regexp_matches(href, '{p}') group by 2"
    for s, p in fixed.STORE_PRODUCT_PATTERNS.items()))
def b07(spark, sf_dir):
    """B07 with the product pattern of each store type."""
    links = X.page_links(spread(store_pages(Tables(spark, sf_dir))))
    out = [X.store_product_links(links, s).select(F.lit(s).alias("store"), "product_url", "first_category") for s in fixed.STORE_PRODUCT_PATTERNS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("b06_store_category_links", f"with links as ({_STORE_LINKS}) " + " union all ".join(
    f"""select distinct '{s}' as store, url, href as category_url from links where not contains(href, '#') and not contains(href, '?')
 and ({' or '.join(f"contains(href, '{p}')" for p in pats)}) and not regexp_matches(href, '/collections/[^/]+/products/')"""
    for s, pats in fixed.STORE_CATEGORY_PATTERNS.items()))
def b06(spark, sf_dir):
    """B06 with the category patterns of each store type."""
    links = X.page_links(spread(store_pages(Tables(spark, sf_dir))))
    out = [X.store_category_links(links, s).select(F.lit(s).alias("store"), "url", "category_url") for s in fixed.STORE_CATEGORY_PATTERNS]
    return out[0].unionByName(out[1]).unionByName(out[2])


_OK = "not contains(href, '/category/') and not contains(href, '/tag/') and not contains(href, '#')"


@register("b08_listing_links_home", f"""with links as ({_STORE_LINKS}), first as (select href as listing_url, url as category_page from links where page_id % 10 <> 0 and {_OK}
   qualify row_number() over (partition by href order by url, pos) = 1),
 found as (select * from first union all select distinct href, cast(null as varchar) from links where page_id % 10 = 0 and {_OK} and href not in (select listing_url from first))
 select listing_url, category_page, case when category_page is null then 'Homepage' else {_title_sql("replace(segs[1], '-', ' ')")} end as category,
 case when category_page is null then '' when len(segs) >= 2 then {_title_sql("replace(segs[2], '-', ' ')")} end as subcategory
 from (select *, case when category_page is not null then {_SEGS.replace('href', 'category_page')} end as segs from found)""")
def b08(spark, sf_dir):
    """B08 with homepages: their links count only where no category page shows them."""
    pages = spread(store_pages(Tables(spark, sf_dir)))
    home = F.col("page_id") % 10 == 0
    return X.listing_links(X.page_links(pages.where(~home)), X.page_links(pages.where(home)))


# --- quarantine (A08), links without tracking (J03), de-dupe with a cap (H09) --------------------------------
@register("a08_upsert_saved", O.with_views("select url, name, source_site from new where description is not null", extra={"new": _NEW}))
def a08s(spark, sf_dir):
    """The rows of a batch that can be saved."""
    good, _, _ = C.upsert_quarantine(relanded_input(Tables(spark, sf_dir)), F.col("description").isNotNull())
    return good.select("url", "name", "source_site")


@register("a08_upsert_rejects", O.with_views("select url, 'invalid row' as reason from new where description is null", extra={"new": _NEW}))
def a08r(spark, sf_dir):
    """The quarantined rows with their reason."""
    _, rejects, _ = C.upsert_quarantine(relanded_input(Tables(spark, sf_dir)), F.col("description").isNotNull())
    return rejects


_LONG = "concat(repeat(concat(product_name, ' & é '), 8), cast(id as varchar))"


@register("j03_tracked_url_plain", O.with_views(f"""select id, case when id % 2 = 0 then url else concat('http://localhost:8000/click?', concat_ws('&', concat('url=', {_enc("coalesce(url, '')")}),
   concat('source=', {_enc('source')}), concat('product_name=', {_enc(_LONG)}))) end as link from clicks""", "clicks"))
def j03(spark, sf_dir):
    """J03's other forms: the name whole, and no tracking (even ids)."""
    c = adapters.clicks(Tables(spark, sf_dir))
    name = F.concat(F.repeat(F.concat("product_name", F.lit(" & é ")), F.lit(8)), F.col("id").cast("string"))
    on = U.tracked_url("url", truncate_name=False, source=F.col("source"), product_name=name)
    return c.select("id", F.when(F.col("id") % 2 == 0, U.tracked_url("url", enabled=False)).otherwise(on).alias("link"))


_TYPED = [("ring", "jacket"), ("bolt", "boots"), ("plate", "hat")]


def _capped_sql(cap: int) -> str:
    v = views() | ranking_views()
    name = "name"
    for a, b in _TYPED:
        name = f"replace({name}, '{a}', '{b}')"
    kind = O.product_type_sql("name")
    dup = f"(list_contains(dd.names, r.name_key) or list_contains(dd.urls, r.url_base) or (r.bt is not null and len(list_filter(dd.bts, lambda b: b = r.bt)) >= {cap}))"
    v["ranked250"] = f"select * replace ({name} as name) from ({v['ranked250']})"
    v["r"] = v["r"].replace("select query_id, rank,", f"select query_id, rank, case when {kind} <> '' then concat(lower(coalesce(brand, '')), '|', {kind}) end as bt,", 1)
    v["dd"] = f"""select query_id, 0 as step, cast([] as varchar[]) as names, cast([] as varchar[]) as urls, cast([] as varchar[]) as bts, cast([] as bigint[]) as kept
 from (select distinct query_id from r)
 union all
 select dd.query_id, r.rank, case when {dup} then dd.names else list_append(dd.names, r.name_key) end,
  case when {dup} then dd.urls else list_append(dd.urls, r.url_base) end,
  case when {dup} or r.bt is null then dd.bts else list_append(dd.bts, r.bt) end,
  case when {dup} then dd.kept else list_append(dd.kept, r.rank) end
 from dd join r on r.query_id = dd.query_id and r.rank = dd.step + 1"""
    return O.with_views("select query_id, rank, dedupe_rank, url, name from deduped", "catalog", "search_queries", extra=v).replace("WITH ", "WITH RECURSIVE ", 1)


@register("h09_greedy_dedupe_capped", _capped_sql(1))
def h09(spark, sf_dir):
    """H09 with a cap of one row per brand and product type (names are given types to meet it)."""
    name = F.col("name")
    for a, b in _TYPED:
        name = F.replace(name, F.lit(a), F.lit(b))
    ranked = _ranked(spark, sf_dir).withColumn("name", name)
    return RK.greedy_dedupe(ranked, max_per_brand_type=1).select("query_id", "rank", "dedupe_rank", "url", "name")


@register("h15_result_cards_page_text", ranking_sql("""select query_id, rerank_rank as ordinal, url,
 case when length(description) > 500 then concat(left(description, 500), '...') else description end as page_text from reranked"""))
def h15(spark, sf_dir):
    """H15 with the beginning of a page text (here the description)."""
    _, rr = _reranked(spark, sf_dir)
    return RK.result_cards(rr, text_col="description").select("query_id", "ordinal", "url", "page_text")
