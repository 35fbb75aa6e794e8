"""Event analytics: look-back reports over click, pageview and feedback events.

Each report is a plain aggregate over a filtered scan.  The look-back and
equality filters are written before any aggregation so they reach the
parquet scan as pushed filters (and partition filters when the event tables
are partitioned by date / environment).  Top-n reports order by the count
and then by every grouping key, so ties resolve the same way everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def ts_lit(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


# C02 -------------------------------------------------------------------------
def lookback(df: DataFrame, ts_col: str, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    """Rows strictly newer than ``as_of - days``."""
    return df.where(F.col(ts_col) > ts_lit(as_of) - F.make_dt_interval(F.lit(int(days))))


# C01 -------------------------------------------------------------------------
def optional_filters(df: DataFrame, **filters) -> DataFrame:
    """Conjunction of ``col = value`` for every filter whose value is set."""
    preds = [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None and v != ""]
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))


def _window(df, ts_col, as_of, days, **filters):
    return optional_filters(lookback(df, ts_col, as_of, days), **filters)


# Link clicks --------------------------------------------------------
def click_totals(clicks: DataFrame, as_of=AS_OF, days=7, source=None, environment=None) -> DataFrame:
    w = _window(clicks, "clicked_at", as_of, days, source=source, environment=environment)
    return w.agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("url").alias("unique_urls"),
    )


def click_top_urls(clicks: DataFrame, as_of=AS_OF, days=7, source=None, environment=None, n=20) -> DataFrame:
    keys = ["url", "source", "product_name", "environment"]
    w = _window(clicks, "clicked_at", as_of, days, source=source, environment=environment)
    g = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("clicks"))
    return g.orderBy(F.desc("clicks"), *[F.asc_nulls_first(k) for k in keys]).limit(n)


def click_by_env(clicks: DataFrame, as_of=AS_OF, days=7) -> DataFrame:
    """Environment breakdown; only the look-back applies (other filters are ignored)."""
    return lookback(clicks, "clicked_at", as_of, days).groupBy("environment").agg(
        F.count(F.lit(1)).alias("clicks"))


# Pageviews ----------------------------------------------------------
def pageview_totals(pv: DataFrame, as_of=AS_OF, days=7, page=None, environment=None) -> DataFrame:
    w = _window(pv, "viewed_at", as_of, days, page=page, environment=environment)
    return w.agg(
        F.count(F.lit(1)).alias("total_pageviews"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("session_id").alias("unique_sessions"),
    )


def top_pages(pv: DataFrame, as_of=AS_OF, days=7, page=None, environment=None, n=20) -> DataFrame:
    w = _window(pv, "viewed_at", as_of, days, page=page, environment=environment)
    g = w.groupBy("page", "environment").agg(F.count(F.lit(1)).alias("views"))
    return g.orderBy(F.desc("views"), F.asc_nulls_first("page"), F.asc_nulls_first("environment")).limit(n)


def pageview_by_env(pv: DataFrame, as_of=AS_OF, days=7) -> DataFrame:
    return lookback(pv, "viewed_at", as_of, days).groupBy("environment").agg(F.count(F.lit(1)).alias("views"))


def hourly_views(pv: DataFrame, as_of=AS_OF, days=7, page=None, environment=None, n=168) -> DataFrame:
    """Views per hour, newest ``n`` hours that have views (empty hours are absent)."""
    w = _window(pv, "viewed_at", as_of, days, page=page, environment=environment)
    g = w.groupBy(F.date_trunc("hour", "viewed_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("views"))
    return g.orderBy(F.desc("hour")).limit(n)


# Feedback -----------------------------------------------------------
def feedback_totals(fb: DataFrame, as_of=AS_OF, days=7, environment=None) -> DataFrame:
    w = _window(fb, "created_at", as_of, days, environment=environment)
    return w.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_if(F.col("rating") == "up").alias("thumbs_up"),
        F.count_if(F.col("rating") == "down").alias("thumbs_down"),
        F.count_distinct("user_id").alias("unique_users"),
    )


def satisfaction_rate_expr(up: Column, total: Column) -> Column:
    """``round(up / total * 100, 1)``, NULL for an empty window.

    Rounding is half-up on the double value (``floor(x*10 + 0.5)/10``) so
    that every engine agrees; decimal rounding of doubles differs between
    engines on ties.
    """
    return F.when(total > 0, F.floor(up.cast("double") * 1000 / total + 0.5) / 10)


def satisfaction_rate(fb: DataFrame, as_of=AS_OF, days=7, environment=None) -> DataFrame:
    t = feedback_totals(fb, as_of, days, environment)
    return t.select(satisfaction_rate_expr(F.col("thumbs_up"), F.col("total_feedback")).alias("satisfaction_rate"))


def feedback_by_env(fb: DataFrame, as_of=AS_OF, days=7) -> DataFrame:
    return lookback(fb, "created_at", as_of, days).groupBy("environment", "rating").agg(
        F.count(F.lit(1)).alias("n"))


def recent_negative(fb: DataFrame, as_of=AS_OF, days=7, environment=None, n=20) -> DataFrame:
    w = _window(fb, "created_at", as_of, days, environment=environment).where(F.col("rating") == "down")
    if "query" not in w.columns:
        w = w.withColumn("query", F.lit(None).cast("string"))
    return w.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(
        "message_id", "user_id", "query", "comment", "created_at")


# E15 -------------------------------------------------------------------------
def session_feedback(fb: DataFrame) -> DataFrame:
    """Latest rating per message, then up / down counts per session."""
    last = fb.groupBy("session_id", "message_id").agg(
        F.max_by("rating", F.struct("created_at", "id")).alias("rating"))
    return last.groupBy("session_id").agg(
        F.count_if(F.col("rating") == "up").alias("up"),
        F.count_if(F.col("rating") == "down").alias("down"),
    )
