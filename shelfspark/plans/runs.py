"""Registered run / log / listing-statistics / event-line queries
(L01-L05, E13, E14, E16, F02, F03, F05, J04, D02, C09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeutil as TU
from ..operators import extract as X
from ..operators import runs as R
from ..sources import adapters
from ..sources.tables import Tables
from . import oracle as O
from .extract import LISTING_FIELDS_SQL, _OF, _listing_fields
from .registry import register


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def report_input(t):
    """Job report rows: the rendered logs of ``orders`` plus run times."""
    j = adapters.logs(t)
    st = R.log_stats(F.col("text"))
    start = TU.epoch_seconds("o_orderdate")
    return j.select("job", "exit_code", *[c.alias(k) for k, c in st.items()],
                    R.blocked_flag(F.col("text")).alias("blocked_403"), start.alias("ts_start"),
                    (start + F.col("o_totalprice") / 100).alias("ts_end"))


_LOG_SQL = """select o_orderkey as job, o_custkey as products_found,
 case when o_orderstatus = 'F' then null else o_custkey % 50 end as products_saved,
 cast(null as int) as categories_found, cast(null as bigint) as images_extracted from orders"""


@register("l01_log_stats", _LOG_SQL)
def l01(spark, sf_dir):
    r = report_input(_t(spark, sf_dir))
    return r.select("job", "products_found", "products_saved", "categories_found", "images_extracted")


@register("l02_blocked_flag", "select o_orderkey as job, o_orderstatus = 'F' as blocked_403 from orders")
def l02(spark, sf_dir):
    return report_input(_t(spark, sf_dir)).select("job", "blocked_403")


@register("l03_job_outcome", """select o_orderkey as job, case when o_orderstatus = 'F' then '403_blocked' else 'ok' end as outcome,
 floor(((epoch(o_orderdate) + o_totalprice / 100) - epoch(o_orderdate)) * 100 + 0.5) / 100 as duration_s,
 floor(((epoch(o_orderdate) + o_totalprice / 100) - epoch(o_orderdate)) / 60 * 100 + 0.5) / 100 as duration_min from orders""")
def l03(spark, sf_dir):
    r = report_input(_t(spark, sf_dir))
    o = R.job_outcome(F.col("exit_code"), F.col("blocked_403"), F.col("ts_start"), F.col("ts_end"))
    return r.select("job", *[c.alias(k) for k, c in o.items()])


@register("e14_run_summary", """select count_if(o_orderstatus <> 'F') as ok, count_if(o_orderstatus = 'F') as failed,
 count_if(o_orderstatus = 'F') as blocked, count(*) as total,
 sum(case when o_orderstatus = 'F' then o_custkey when o_custkey % 50 <> 0 then o_custkey % 50 else o_custkey end) as total_products
 from orders""")
def e14(spark, sf_dir):
    return R.run_summary(report_input(_t(spark, sf_dir)))


def job_events_input(t):
    o = t.orders
    d = F.col("o_orderdate")
    q = o.select(F.col("o_orderkey").alias("job"), F.lit("queued").alias("state"), d.alias("ts"))
    r = o.select(F.col("o_orderkey").alias("job"), F.lit("running").alias("state"),
                 (d + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 3 + 1).cast("int") * 12)).alias("ts"))
    f = o.select(F.col("o_orderkey").alias("job"),
                 F.when(F.col("o_orderstatus") == "F", F.lit("failed")).otherwise(F.lit("done")).alias("state"),
                 (d + F.make_dt_interval(F.lit(2))).alias("ts"))
    return q.unionByName(r).unionByName(f)


AT = "1995-06-17 06:00:00"


@register("e16_job_status_counts", f"""with ev as (
 select o_orderkey as job, 'queued' as state, o_orderdate as ts from orders
 union all select o_orderkey, 'running', o_orderdate + to_hours(cast((o_orderkey % 3 + 1) * 12 as bigint)) from orders
 union all select o_orderkey, case when o_orderstatus = 'F' then 'failed' else 'done' end, o_orderdate + interval 2 day from orders)
 select state, count(*) as jobs, max(case when state = 'running' then epoch(timestamp '{AT}') - epoch(since) end)::bigint as max_elapsed_s
 from (select job, arg_max(state, ts) as state, max(ts) as since from ev where ts <= timestamp '{AT}' group by job) group by state""")
def e16(spark, sf_dir):
    return R.job_status_counts(job_events_input(_t(spark, sf_dir)), F.lit(AT).cast("timestamp_ntz"))


@register("f02_prev_user_query", """select conv_id, turn, query from (select conv_id, turn, role,
 case when lag(role) over w = 'user' then lag(text) over w end as query from conversations window w as (partition by conv_id order by turn))
 where role = 'assistant'""")
def f02(spark, sf_dir):
    return R.prev_user_query(_t(spark, sf_dir).conversations)


def _listings(spark, sf_dir):
    """Listings with the three three-valued flags: ownership (B22), origin (B27), storefront."""
    lst = _storefront_listings(spark, sf_dir)
    o = X.origin_from_location(F.col("manufactured_in"))
    return lst.withColumn("made_in_canada", o["made_in_canada"])


_LST = f"""select *, case when lower(trim(canadian_owned_text)) in ('yes', 'true', '✓', '✔') then true
 when lower(trim(canadian_owned_text)) in ('no', 'false', '✗', '✘') then false end as canadian_owned,
 {_OF} as made_in_canada,
 case when coalesce(website, '') = '' then null else cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) % 3 = 0 end as is_shopify_store
 from lf"""


def _pct(x, total):
    return f"floor(cast({x} as double) * 1000 / greatest({total}, 1) + 0.5) / 10"


@register("e13_origin_stats", O.with_views(" union all ".join(
    f"""select '{f}' as flag, count_if({f}) as yes, count_if(not {f}) as no, count_if({f} is null) as unknown,
 {_pct(f'count_if({f})', 'count(*)')} as yes_pct, {_pct(f'count_if(not {f})', 'count(*)')} as no_pct,
 {_pct(f'count_if({f} is null)', 'count(*)')} as unknown_pct from lst""" for f in ("canadian_owned", "made_in_canada", "is_shopify_store")),
    "listing_pages", extra={"lf": LISTING_FIELDS_SQL, "lst": _LST}))
def e13(spark, sf_dir):
    return R.origin_stats(_listings(spark, sf_dir), ["canadian_owned", "made_in_canada", "is_shopify_store"])


@register("e13_extraction_methods", O.with_views("""select case when found < 3 or coalesce(website, '') = '' then 'second_source'
 else 'regex' end as method, count(*) as n from lf group by 1""", "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def e13m(spark, sf_dir):
    """How listings were extracted: page rules alone, or rules plus a second source."""
    lf = _listing_fields(spark, sf_dir)
    need = X.needs_enrichment(F.col("found"), F.col("website"))["needs_enrichment"]
    return lf.groupBy(F.when(need, F.lit("second_source")).otherwise(F.lit("regex")).alias("method")).agg(
        F.count(F.lit(1)).alias("n"))


@register("f03_running_stats", O.with_views(f"""select seq, yes, no, unknown, {_pct('yes', 'seq')} as yes_pct from (
 select row_number() over (order by url) as seq,
 sum(case when made_in_canada then 1 else 0 end) over (order by url rows between unbounded preceding and current row) as yes,
 sum(case when not made_in_canada then 1 else 0 end) over (order by url rows between unbounded preceding and current row) as no,
 sum(case when made_in_canada is null then 1 else 0 end) over (order by url rows between unbounded preceding and current row) as unknown
 from lst) where seq % 25 = 0""", "listing_pages", extra={"lf": LISTING_FIELDS_SQL, "lst": _LST}))
def f03(spark, sf_dir):
    return R.running_stats(_listings(spark, sf_dir), "made_in_canada")


def _storefront_listings(spark, sf_dir):
    lf = _listing_fields(spark, sf_dir)
    n = F.regexp_extract("url", r"(\d+)$", 1).try_cast("long")
    body = F.when(n % 3 == 0, F.concat(F.lit('{"id":'), n.cast("string"), F.lit("}"))).otherwise(F.lit("[]"))
    d = X.storefront_detect(F.col("website"), F.lit(200), body)
    return lf.withColumn("is_shopify_store", d["is_shopify_store"]).withColumn("_n", n)


def known_sites_input(lst):
    return lst.where(F.col("_n") % 4 == 0).select(F.col("website").alias("base"))


_JOBS_SQL = O.with_views("""select concat('dir_', left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 30)) as name,
 case when starts_with(website, 'http') then website else concat('https://', website) end as base, 'shopify' as store_type, 1000 as max_categories
 from (select *, cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) as n from lf) where n % 3 = 0 and coalesce(website, '') <> ''
 and n % 4 <> 0""", "listing_pages", extra={"lf": LISTING_FIELDS_SQL})


@register("j04_storefront_jobs", _JOBS_SQL)
def j04(spark, sf_dir):
    lst = _storefront_listings(spark, sf_dir)
    return R.storefront_jobs(lst, known=known_sites_input(lst))


@register("d02_exclude_known_domains", O.with_views("""select url, website from (select *, cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) as n from lf)
 where n % 4 <> 0""", "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def d02(spark, sf_dir):
    lst = _storefront_listings(spark, sf_dir)
    return R.exclude_known_domains(lst.select("url", "website"), known_sites_input(lst), "website")


@register("c09_storefront_jobs_scan", O.with_views("""select name, website, url from (select *, cast(regexp_extract(url, '([0-9]+)$', 1) as bigint) as n from lf)
 where n % 3 = 0 and coalesce(website, '') <> '' order by name""", "listing_pages", extra={"lf": LISTING_FIELDS_SQL}))
def c09(spark, sf_dir):
    lst = _storefront_listings(spark, sf_dir)
    return lst.where(F.col("is_shopify_store") & (F.coalesce(F.col("website"), F.lit("")) != "")).orderBy("name").select(
        "name", "website", "url")


# --- chat event lines rendered from conversations -----------------------------------
def event_lines_input(t):
    c = t.conversations.where(F.col("role") == "assistant")
    run = (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id")
    m = (F.col("turn") % 3 + 1)
    base = F.lit(1704067200).cast("long") + F.col("conv_id") * 3600 + F.col("turn") * 60

    def ts(seq):
        return TU.ntz_from_seconds(base + seq * m).alias("ts")

    n = F.size(F.split("text", "\n"))
    fixed_rows = c.select(run, F.posexplode(F.array(
        F.lit(": ping"), F.lit('data: {"type":"tool_start","tool":"search_products"}'), F.lit("data: {bad"),
        F.lit('data: {"type":"tool_complete"}'))).alias("seq", "line"), "turn", "conv_id")
    content = c.select(run, "turn", "conv_id", n.alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "chunk")).select(
        "run_id", "turn", "conv_id", (F.col("i") + 4).alias("seq"),
        F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("content").alias("type"), F.concat(
            F.col("chunk"), F.when(F.col("i") < F.col("n") - 1, F.lit("\n")).otherwise(F.lit(""))).alias("content")))).alias("line"))
    tail = c.select(run, "turn", "conv_id", (n + 4).alias("seq"), F.when(F.col("turn") % 5 == 1, F.lit(
        'data: {"type":"error","error":"backend failed"}')).otherwise(F.lit('data: {"type":"done"}')).alias("line"))
    odd = c.select(run, "turn", "conv_id", (n + 5).alias("seq"), F.lit('data: {"type":"mystery"}').alias("line"))
    allr = fixed_rows.unionByName(content).unionByName(tail).unionByName(odd)
    return allr.select("run_id", F.col("seq").cast("long").alias("seq"), ts(F.col("seq")), "line")


@register("l04_event_lines", """select conv_id * 1000 + turn as run_id, t as type, count(*) as n from (
 select conv_id, turn, unnest(['tool_start', 'tool_complete', case when turn % 5 = 1 then 'error' else 'done' end]) as t from conversations where role = 'assistant'
 union all select conv_id, turn, 'content' from (select conv_id, turn, unnest(string_split(text, chr(10))) from conversations where role = 'assistant'))
 group by 1, 2""")
def l04(spark, sf_dir):
    ev = R.event_lines(event_lines_input(_t(spark, sf_dir)))
    return ev.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"))


@register("l05_assemble_response", """select conv_id * 1000 + turn as run_id, case when turn % 5 = 1 then 'backend failed' else text end as response,
 turn % 5 = 1 as is_error from conversations where role = 'assistant'""")
def l05(spark, sf_dir):
    return R.assemble_response(R.event_lines(event_lines_input(_t(spark, sf_dir))))


@register("f05_event_phase_times", """select conv_id * 1000 + turn as run_id, phase, cast((turn % 3 + 1) * mult as bigint) as seconds
 from conversations, (select 'planning' as phase, 1 as mult union all select 'tool', 2 union all select 'analyzing', 1)
 where role = 'assistant'""")
def f05(spark, sf_dir):
    lines = event_lines_input(_t(spark, sf_dir))
    return R.event_phase_times(R.event_lines(lines), lines)
