"""Registered event-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators.daily import DailyStates
from ..sources import adapters
from ..sources import io as IO
from ..sources.tables import Tables
from .oracle import lookback_sql as lb
from .oracle import with_views
from .registry import register


def _v(spark, sf_dir, name):
    return getattr(adapters, name)(Tables(spark, sf_dir))


@register("c01_optional_filters", with_views(
    "select id, url, source, environment from clicks where source = 'src1' and environment = 'production'", "clicks"))
def c01(spark, sf_dir):
    return A.optional_filters(_v(spark, sf_dir, "clicks"), source="src1", environment="production", url=None).select(
        "id", "url", "source", "environment")


@register("c02_lookback", with_views(f"select id, user_id, clicked_at from clicks where {lb('clicked_at', 3)}", "clicks"))
def c02(spark, sf_dir):
    return A.lookback(_v(spark, sf_dir, "clicks"), "clicked_at", days=3).select("id", "user_id", "clicked_at")


@register("e01_click_totals", with_views(f"""select count(*) as total_clicks, count(distinct user_id) as unique_users,
 count(distinct url) as unique_urls from clicks where {lb('clicked_at')}""", "clicks"))
def e01(spark, sf_dir):
    return A.click_totals(_v(spark, sf_dir, "clicks"))


@register("e01_click_totals_filtered", with_views(f"""select count(*) as total_clicks, count(distinct user_id) as unique_users,
 count(distinct url) as unique_urls from clicks where {lb('clicked_at', 14)} and source = 'src2' and environment = 'development'""",
                                                  "clicks"))
def e01f(spark, sf_dir):
    return A.click_totals(_v(spark, sf_dir, "clicks"), days=14, source="src2", environment="development")


@register("e02_click_top_urls", with_views(f"""select url, source, product_name, environment, count(*) as clicks
 from clicks where {lb('clicked_at')} group by url, source, product_name, environment
 order by clicks desc, url, source, product_name, environment limit 20""", "clicks"))
def e02(spark, sf_dir):
    return A.click_top_urls(_v(spark, sf_dir, "clicks"))


@register("e03_click_by_env", with_views(f"""select environment, count(*) as clicks from clicks
 where {lb('clicked_at')} group by environment""", "clicks"))
def e03(spark, sf_dir):
    return A.click_by_env(_v(spark, sf_dir, "clicks"))


@register("e04_pageview_totals", with_views(f"""select count(*) as total_pageviews, count(distinct user_id) as unique_users,
 count(distinct session_id) as unique_sessions from pageviews where {lb('viewed_at')}""", "pageviews"))
def e04(spark, sf_dir):
    return A.pageview_totals(_v(spark, sf_dir, "pageviews"))


@register("e05_top_pages", with_views(f"""select page, environment, count(*) as views from pageviews
 where {lb('viewed_at', 30)} group by page, environment order by views desc, page, environment limit 20""", "pageviews"))
def e05(spark, sf_dir):
    return A.top_pages(_v(spark, sf_dir, "pageviews"), days=30)


@register("e06_pageview_by_env", with_views(f"""select environment, count(*) as views from pageviews
 where {lb('viewed_at')} group by environment""", "pageviews"))
def e06(spark, sf_dir):
    return A.pageview_by_env(_v(spark, sf_dir, "pageviews"))


@register("e07_hourly_views", with_views(f"""select date_trunc('hour', viewed_at) as hour, count(*) as views from pageviews
 where {lb('viewed_at')} and page = '/search' group by 1 order by hour desc limit 168""", "pageviews"))
def e07(spark, sf_dir):
    return A.hourly_views(_v(spark, sf_dir, "pageviews"), page="/search")


@register("e08_feedback_totals", with_views(f"""select count(*) as total_feedback, count(*) filter (where rating = 'up') as thumbs_up,
 count(*) filter (where rating = 'down') as thumbs_down, count(distinct user_id) as unique_users
 from feedback where {lb('created_at')}""", "feedback"))
def e08(spark, sf_dir):
    return A.feedback_totals(_v(spark, sf_dir, "feedback"))


@register("e09_satisfaction_rate", with_views(f"""select case when count(*) > 0 then
 floor(cast(count(*) filter (where rating = 'up') as double) * 1000 / count(*) + 0.5) / 10 end as satisfaction_rate
 from feedback where {lb('created_at')} and environment = 'production'""", "feedback"))
def e09(spark, sf_dir):
    return A.satisfaction_rate(_v(spark, sf_dir, "feedback"), environment="production")


@register("e10_feedback_by_env", with_views(f"""select environment, rating, count(*) as n from feedback
 where {lb('created_at')} group by environment, rating""", "feedback"))
def e10(spark, sf_dir):
    return A.feedback_by_env(_v(spark, sf_dir, "feedback"))


@register("e11_recent_negative", with_views(f"""select message_id, user_id, cast(null as varchar) as query, comment, created_at
 from feedback where {lb('created_at')} and rating = 'down' order by created_at desc, id desc limit 20""", "feedback"))
def e11(spark, sf_dir):
    return A.recent_negative(_v(spark, sf_dir, "feedback"))


@register("e15_session_feedback", with_views("""select session_id, count(*) filter (where rating = 'up') as up,
 count(*) filter (where rating = 'down') as down
 from (select session_id, message_id, arg_max(rating, (created_at, id)) as rating from feedback group by 1, 2)
 group by session_id""", "feedback"))
def e15(spark, sf_dir):
    return A.session_feedback(_v(spark, sf_dir, "feedback"))


# --- look-backs from daily states ---------------------------------------------------------------------------------
def _states(spark, rows, ts_col, dims, distinct, counts):
    """Stored daily states of ``rows``: the days up to the middle of the month first, the rest by a second refresh."""
    st = DailyStates(spark, IO.scratch(spark, "daily"), ts_col, dims, distinct, counts)
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    st.refresh(rows.where(F.col(ts_col) <= half))
    st.refresh(rows.where(F.col(ts_col) > half))
    return st


def _click_states(spark, sf_dir):
    return _states(spark, _v(spark, sf_dir, "clicks"), "clicked_at", ["source", "environment"], ["user_id", "url"], {"rows": F.count(F.lit(1))})


_CLICK_NAMES = {"rows": "total_clicks", "user_id": "unique_users", "url": "unique_urls"}


@register("e01_click_totals_states", with_views(f"""select count(*) as total_clicks, count(distinct user_id) as unique_users,
 count(distinct url) as unique_urls from clicks where {lb('clicked_at')}
 union all select count(*), count(distinct user_id), count(distinct url) from clicks where {lb('clicked_at', 14)} and source = 'src2' and environment = 'development'""", "clicks"))
def e01s(spark, sf_dir):
    """E01 from the daily states alone: a plain and a filtered window."""
    st = _click_states(spark, sf_dir)
    return st.totals(_CLICK_NAMES, A.AS_OF, 7).unionAll(st.totals(_CLICK_NAMES, A.AS_OF, 14, source="src2", environment="development"))


@register("e04_pageview_totals_states", with_views(f"""select count(*) as total_pageviews, count(distinct user_id) as unique_users,
 count(distinct session_id) as unique_sessions from pageviews where {lb('viewed_at')}""", "pageviews"))
def e04s(spark, sf_dir):
    st = _states(spark, _v(spark, sf_dir, "pageviews"), "viewed_at", ["page", "environment"], ["user_id", "session_id"], {"rows": F.count(F.lit(1))})
    return st.totals({"rows": "total_pageviews", "user_id": "unique_users", "session_id": "unique_sessions"}, A.AS_OF, 7)


@register("e08_feedback_totals_states", with_views(f"""select count(*) as total_feedback, count(*) filter (where rating = 'up') as thumbs_up,
 count(*) filter (where rating = 'down') as thumbs_down, count(distinct user_id) as unique_users
 from feedback where {lb('created_at')}""", "feedback"))
def e08s(spark, sf_dir):
    counts = {"rows": F.count(F.lit(1)), "up": F.count_if(F.col("rating") == "up"), "down": F.count_if(F.col("rating") == "down")}
    st = _states(spark, _v(spark, sf_dir, "feedback"), "created_at", ["environment"], ["user_id"], counts)
    return st.totals({"rows": "total_feedback", "up": "thumbs_up", "down": "thumbs_down", "user_id": "unique_users"}, A.AS_OF, 7)
