"""Registered catalogue / column-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queryparse as QP
from ..functions import text as T
from ..functions import urls as U
from ..operators import catalog as C
from ..operators.buckets import BucketedTable
from ..sources import adapters
from ..sources import io as IO
from ..sources.tables import Tables
from . import oracle as O
from .oracle import with_views
from .registry import register


def _v(spark, sf_dir, name):
    return getattr(adapters, name)(Tables(spark, sf_dir))


def q6(c):
    return F.floor(F.col(c).cast("double") * 1e6 + 0.5) / 1e6 if isinstance(c, str) else F.floor(c.cast("double") * 1e6 + 0.5) / 1e6


@register("a01_read_catalog", with_views(f"""select url, name, brand, price, currency, source_site, made_in_canada,
 made_in_canada_reason, num_reviews, {O.q6('average_rating')} as average_rating, len(embedding) as dim from catalog""", "catalog"))
def a01(spark, sf_dir):
    path = IO.scratch(spark, "a01")
    C.typed_products(_v(spark, sf_dir, "catalog")).write.parquet(path)
    p = C.read_catalog(spark, path)
    return p.select("url", "name", "brand", "price", "currency", "source_site", "made_in_canada",
                    "made_in_canada_reason", "num_reviews", q6("average_rating").alias("average_rating"),
                    F.size("embedding").alias("dim"))


@register("a09_dump_urls", with_views("select distinct url from catalog order by url", "catalog"))
def a09(spark, sf_dir):
    return C.dump_urls(_v(spark, sf_dir, "catalog"))


@register("a10_preview", with_views("""select name, url, (select count(*) from catalog) - 5 as remaining
 from catalog order by url limit 5""", "catalog"))
def a10(spark, sf_dir):
    return C.preview(_v(spark, sf_dir, "catalog"), n=5)


@register("a11_source_count", with_views("select source_site, count(*) as n from catalog group by source_site", "catalog"))
def a11(spark, sf_dir):
    return C.source_count(_v(spark, sf_dir, "catalog"), by_site=True)


@register("a11_source_count_one", with_views("select count(*) as n from catalog where source_site = 'src3.example.com'", "catalog"))
def a11b(spark, sf_dir):
    return C.source_count(_v(spark, sf_dir, "catalog"), source_site="src3.example.com")


@register("a12_valid_only", with_views("""select url, name from catalog where coalesce(name, '') <> ''
 order by url""", "catalog"))
def a12(spark, sf_dir):
    good, _counts = C.valid_only(_v(spark, sf_dir, "catalog"))
    return good.select("url", "name")


@register("a12_valid_counts", with_views("""select count_if(coalesce(name, '') <> '') as valid,
 count_if(coalesce(name, '') = '') as skipped from catalog""", "catalog"))
def a12c(spark, sf_dir):
    _good, counts = C.valid_only(_v(spark, sf_dir, "catalog"))
    return counts


@register("c03_price_filter", with_views(f"""select url, price, {O.price_number_sql('price')} as price_num from catalog
 where {O.price_number_sql('price')} >= 900.0 and {O.price_number_sql('price')} <= 1000.0""", "catalog"))
def c03(spark, sf_dir):
    return C.price_filter(_v(spark, sf_dir, "catalog"), min_price=900.0, max_price=1000.0).select("url", "price", "price_num")


@register("c04_rating_filter", with_views(f"select url, {O.q6('average_rating')} as average_rating from catalog where average_rating >= 4.0",
                                          "catalog"))
def c04(spark, sf_dir):
    return C.rating_filter(_v(spark, sf_dir, "catalog"), 4.0).select("url", q6("average_rating").alias("average_rating"))


@register("c05_brand_ilike", with_views("select url, brand from catalog where brand ilike '%brand#1%'", "catalog"))
def c05(spark, sf_dir):
    return C.brand_filter(_v(spark, sf_dir, "catalog"), "brand#1").select("url", "brand")


@register("c06_origin_filter", with_views("select url, made_in_canada from catalog where made_in_canada = true", "catalog"))
def c06(spark, sf_dir):
    return C.origin_filter(_v(spark, sf_dir, "catalog"), True).select("url", "made_in_canada")


@register("c08_truncate", with_views("""select url, left(description, 500) as description_500,
 case when length(description) > 200 then concat(left(description, 200), '...') else description end as snippet,
 left(name, 100) as name_100 from catalog""", "catalog"))
def c08(spark, sf_dir):
    p = _v(spark, sf_dir, "catalog")
    return p.select("url", T.truncate("description", 500).alias("description_500"),
                    T.truncate("description", 200, ellipsis=True).alias("snippet"), T.truncate("name", 100).alias("name_100"))


@register("d05_site_to_brand", with_views(f"""select url, {O.brand_display_sql('brand', 'source_site')} as brand_display,
 {O.brand_display_sql('cast(null as varchar)', 'source_site')} as site_brand from catalog""", "catalog"))
def d05(spark, sf_dir):
    p = _v(spark, sf_dir, "catalog")
    return p.select("url", T.brand_display("brand", "source_site").alias("brand_display"),
                    T.brand_display(F.lit(None).cast("string"), "source_site").alias("site_brand"))


@register("h06_url_base", with_views(f"select url, {O.url_base_sql('url')} as url_base from catalog", "catalog"))
def h06(spark, sf_dir):
    return _v(spark, sf_dir, "catalog").select("url", U.url_base("url").alias("url_base"))


@register("h10_normalize_name", with_views(f"select url, {O.normalize_name_sql('name')} as norm_name from catalog", "catalog"))
def h10(spark, sf_dir):
    return _v(spark, sf_dir, "catalog").select("url", T.normalize_name("name").alias("norm_name"))


@register("h11_product_type", with_views(f"select url, {O.product_type_sql('name')} as product_type from catalog", "catalog"))
def h11(spark, sf_dir):
    return _v(spark, sf_dir, "catalog").select("url", T.product_type("name").alias("product_type"))


@register("h12_smooth_rating", with_views(
    f"select url, {O.q6(O.smooth_rating_sql('average_rating', 'num_reviews'))} as smoothed from catalog", "catalog"))
def h12(spark, sf_dir):
    return _v(spark, sf_dir, "catalog").select("url", q6(T.smooth_rating("average_rating", "num_reviews")).alias("smoothed"))


@register("j01_url_host", with_views("""select page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host,
 replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') as domain_key from pages"""))
def j01(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    return pages.select("page_id", "url", U.url_host("url").alias("host"), U.domain_key("url").alias("domain_key"))


@register("b31_embedding_text", with_views("""select url, case when concat_ws(' | ',
   case when coalesce(name, '') <> '' then concat('Product: ', name) end,
   case when coalesce(description, '') <> '' then concat('Description: ', description) end) <> ''
 then concat_ws(' | ', case when coalesce(name, '') <> '' then concat('Product: ', name) end,
   case when coalesce(description, '') <> '' then concat('Description: ', description) end) else url end as text
 from catalog""", "catalog"))
def b31(spark, sf_dir):
    p = _v(spark, sf_dir, "catalog")
    return p.select("url", T.product_embedding_text("name", "description", "url").alias("text"))


def _listing_fields_sql():
    from .extract import LISTING_FIELDS_SQL
    return LISTING_FIELDS_SQL


_LISTING_TEXT = """concat_ws(' | ', case when coalesce(name, '') <> '' then concat('Company: ', name) end,
   case when coalesce(products, '') <> '' then concat('Products: ', products) end,
   case when coalesce(manufactured_in, '') <> '' then concat('Manufactured in: ', manufactured_in) end)"""


@register("b31_listing_embedding_text", with_views(f"select url, case when {_LISTING_TEXT} <> '' then {_LISTING_TEXT} else url end as text from lf",
                                                   "listing_pages", extra={"lf": _listing_fields_sql()}))
def b31l(spark, sf_dir):
    from .extract import _listing_fields
    lf = _listing_fields(spark, sf_dir)
    return lf.select("url", T.listing_embedding_text("name", "products", F.lit(None).cast("string"), "manufactured_in", "url").alias("text"))


# One registered query per parsed field, all over the search batch
_PARSED = O.parsed_queries_sql("search_queries")
for _key, _cols in {
    "i01_max_price": ["max_price"],
    "i02_min_price": ["min_price"],
    "i03_price_range": ["min_price", "max_price"],
    "i04_min_rating": ["min_rating"],
    "i05_brand": ["brand"],
    "i06_wants_origin": ["wants_origin"],
    "i07_intent": ["intent"],
}.items():
    def _make(cols):
        def fn(spark, sf_dir):
            q = QP.parse_queries(_v(spark, sf_dir, "search_queries"))
            return q.select("query_id", "text", *cols)
        return fn

    register(_key, with_views(f"select query_id, text, {', '.join(_cols)} from parsed", "search_queries",
                              extra={"parsed": _PARSED}))(_make(_cols))


# --- A06-A08, A03-A05: maintenance, sinks ---------------------------------------------


def relanded_input(t):
    """A re-landed batch: every document with its part (a superset of the catalogue keys),
    name upper-cased, description dropped for toxic documents, a new source site."""
    d, p, lab = t.documents, t.part, t.labels
    m4 = F.col("doc_id") % 4
    j = d.join(p, p.p_partkey == d.doc_id).join(lab.select(F.col("doc_id").alias("l_doc"), "toxic"),
                                                 F.col("l_doc") == d.doc_id, "left")
    return j.select(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/products/"),
                 F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), (F.col("doc_id") % 7).cast("string"),
                 F.when(m4 == 0, F.lit("-xl")).when(m4 == 1, F.lit("-s")).otherwise(F.lit("")),
                 F.lit("?ref="), F.col("doc_id").cast("string")).alias("url"),
        F.upper(F.col("p_name")).alias("name"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("string")).otherwise(F.col("text")).alias("description"),
        F.lit("relanded.example.com").alias("source_site"))


_OLD = "select url, name, description, source_site, timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' as updated_at from catalog"
_NEW = """select concat('https://', d.source, '.example.com/products/', replace(p.p_name,' ','-'), '-', cast(d.doc_id % 7 as varchar),
   case when d.doc_id % 4 = 0 then '-xl' when d.doc_id % 4 = 1 then '-s' else '' end, '?ref=', cast(d.doc_id as varchar)) as url,
 upper(p.p_name) as name, case when l.toxic = 1 then null else d.text end as description, 'relanded.example.com' as source_site
 from documents d join part p on p.p_partkey = d.doc_id left join labels l on l.doc_id = d.doc_id"""


_A07_SQL = with_views("""select n.url, n.name, n.description is null as description_null,
 coalesce(o.source_site, n.source_site) as source_site,
 coalesce(o.created_at, timestamp '2024-02-01 00:00:00') as created_at, timestamp '2024-02-01 00:00:00' as updated_at
 from new n left join old o on o.url = n.url
 union all select o.url, o.name, o.description is null, o.source_site, o.created_at, o.updated_at
 from old o anti join new n on n.url = o.url""", "catalog", extra={"old": _OLD, "new": _NEW})


def _a07_old(t):
    return adapters.catalog(t).select("url", "name", "description", "source_site",
                                      F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
                                      F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


@register("a07_upsert_by_key", _A07_SQL)
def a07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = C.upsert_by_key(_a07_old(t), relanded_input(t), preserve=["source_site"], now="2024-02-01 00:00:00")
    return m.select("url", "name", F.col("description").isNull().alias("description_null"), "source_site",
                    "created_at", "updated_at")


@register("a07_upsert_bucketed", _A07_SQL)
def a07b(spark, sf_dir):
    """A07 on a stored table in hash buckets of its key: only the buckets that the batch touches are read and rewritten."""
    t = Tables(spark, sf_dir)
    stored = BucketedTable.create(_a07_old(t), IO.scratch(spark, "a07-table"), buckets=64)
    stored.upsert(relanded_input(t), preserve=["source_site"], now="2024-02-01 00:00:00")
    return BucketedTable(spark, stored.base).read().select("url", "name", F.col("description").isNull().alias("description_null"),
                                                           "source_site", "created_at", "updated_at")


@register("a08_upsert_quarantine", with_views("""select count_if(description is not null) as saved,
 count_if(description is null) as failed from new""", extra={"new": _NEW}))
def a08(spark, sf_dir):
    _good, _rejects, counts = C.upsert_quarantine(relanded_input(Tables(spark, sf_dir)), F.col("description").isNotNull())
    return counts


@register("a06_evolve_schema", with_views("""select url, 'CAD' as currency, cast(null as varchar) as availability,
 cast(null as varchar) as sku, 0 as num_reviews from new""", extra={"new": _NEW}))
def a06(spark, sf_dir):
    r = C.conform(relanded_input(Tables(spark, sf_dir)), C.PRODUCTS, defaults={"currency": "CAD", "num_reviews": 0})
    return r.select("url", "currency", "availability", "sku", "num_reviews")


@register("a03_write_json", with_views("select url, name, brand from catalog", "catalog"))
def a03(spark, sf_dir):
    p = _v(spark, sf_dir, "catalog").select("url", "name", "brand")
    path = IO.write_json(p, IO.scratch(spark, "a03"))
    return spark.read.schema(p.schema).json(path)


@register("a04_append_report_jsonl", """select o_orderkey as job, case when o_orderstatus = 'F' then 1 else 0 end as exit_code,
 o_orderstatus = 'F' as blocked_403 from orders""")
def a04(spark, sf_dir):
    from .runs import report_input
    r = report_input(Tables(spark, sf_dir)).select("job", "exit_code", "blocked_403")
    return IO.append_report_jsonl(r, IO.scratch(spark, "a04"))


@register("a05_append_events", with_views("""select environment, cast(clicked_at as date) as event_date, count(*) as n
 from clicks group by 1, 2""", "clicks"))
def a05(spark, sf_dir):
    c = _v(spark, sf_dir, "clicks")
    path = IO.scratch(spark, "a05")
    IO.append_events(c, path, environment="development", ts_col="clicked_at")
    back = spark.read.parquet(path)
    return back.groupBy("environment", "event_date").agg(F.count(F.lit(1)).alias("n"))


@register("a02_read_json_array", with_views("""select url, name, products, manufactured_in, website, canadian_owned_text,
 cast(null as varchar) as category, cast(null as boolean) as is_shopify_store from lf""",
                                            "listing_pages", extra={"lf": _listing_fields_sql()}))
def a02(spark, sf_dir):
    from .extract import _listing_fields
    lf = _listing_fields(spark, sf_dir).select("url", "name", "products", "manufactured_in", "website", "canadian_owned_text")
    path = IO.write_json_arrays(lf, IO.scratch(spark, "a02"), rows_per_file=10_000)
    back = IO.read_json_array(spark, path)
    return back.select("url", "name", "products", "manufactured_in", "website", "canadian_owned_text", "category",
                       "is_shopify_store")


@register("d04_secondary_source", with_views("""select c.url, l.quality, l.toxic from catalog c left join labels l on l.doc_id = c.id""",
                                             "catalog"))
def d04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    side = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    return C.secondary_source(adapters.catalog(t).select("id", "url"), side, "id").select(
        "url", "quality", "toxic")
