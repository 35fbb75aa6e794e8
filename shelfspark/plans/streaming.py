"""Registered streaming queries (K01-K04, C07): each runs a checkpointed stream to the end
(``availableNow``) and returns the sink read as a batch table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.buckets import BucketedTable, BucketedUpsert
from ..sources import adapters
from ..sources import io as IO
from ..sources.tables import Tables
from ..streaming import events as S
from ..streaming import fanout as FO
from .catalog import _NEW
from .oracle import with_views
from .registry import register


def _events(spark, sf_dir):
    schema = Tables(spark, sf_dir).events.schema
    return S.event_stream(spark, sf_dir, "events.parquet", schema)


@register("c07_rating_domain", with_views("""select rating, count(*) as n from feedback
 where rating in ('up', 'down') group by rating""", "feedback"))
def c07(spark, sf_dir):
    fb = adapters.feedback(Tables(spark, sf_dir))
    return S.validate_feedback(fb).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@register("k01_ingest_stream", with_views("""select environment, rating, count(*) as n from feedback
 where rating in ('up', 'down') group by 1, 2""", "feedback"))
def k01(spark, sf_dir):
    fb = S.validate_feedback(adapters.feedback_from(_events(spark, sf_dir)))
    sink, ck = IO.scratch(spark, "k01-sink"), IO.scratch(spark, "k01-ckpt")
    S.run_to_end(S.ingest_stream(fb, sink, ck))
    return spark.read.parquet(sink).groupBy("environment", "rating").agg(F.count(F.lit(1)).alias("n"))


@register("k02_hourly_stream", with_views("""select date_trunc('hour', viewed_at) as hour, count(*) as views from pageviews
 group by 1 having date_trunc('hour', viewed_at) + interval 1 hour <= (select max(viewed_at) from pageviews) - interval 1 hour""",
                                          "pageviews"))
def k02(spark, sf_dir):
    agg = S.hourly_stream(adapters.pageviews_from(_events(spark, sf_dir)))
    sink, ck = IO.scratch(spark, "k02-sink"), IO.scratch(spark, "k02-ckpt")
    q = (agg.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    S.run_to_end(q)
    return spark.read.parquet(sink)


@register("k03_dedupe_stream", "select count(*) as n, count(distinct event_id) as ids from events")
def k03(spark, sf_dir):
    a, b = _events(spark, sf_dir), _events(spark, sf_dir)
    d = S.dedupe_stream(a.unionByName(b), "event_id", "ts")
    sink, ck = IO.scratch(spark, "k03-sink"), IO.scratch(spark, "k03-ckpt")
    q = (d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    S.run_to_end(q)
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@register("k04_upsert_stream", with_views("""select count(*) as n, count_if(name = upper(name)) as updated from (
 select n.url, n.name from new n union all select o.url, o.name from catalog o anti join new n on n.url = o.url)""",
                                          "catalog", extra={"new": _NEW}))
def k04(spark, sf_dir):
    from .catalog import relanded_input
    t = Tables(spark, sf_dir)
    old = adapters.catalog(t).select("url", "name", "description", "source_site")
    landed = IO.scratch(spark, "k04-landed")
    relanded_input(t).repartition(4, "url").write.parquet(landed)  # four files -> four micro-batches
    upd = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stored = BucketedTable.create(old, IO.scratch(spark, "k04-table"), buckets=32)
    S.run_to_end(S.upsert_stream(upd, BucketedUpsert(stored), IO.scratch(spark, "k04-ckpt")))
    options = {"preserve": ["source_site"], "now": "2024-02-01 00:00:00"}
    on_read = stored.table(**options)
    stored.compact(**options)
    final = BucketedTable(spark, stored.base).read()
    if on_read.count() != final.count():
        raise AssertionError("merge on read and compaction differ")
    return final.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == F.upper("name")).alias("updated"))


# --- K01 with all kinds, C07 with rejects, K02 / K03 with late rows -------------------------------------------
_LANDED = """select *, cast(json_extract_string(props, '$.k') as int) as k, case when event_type = 'view' then 'pageview'
  when event_type in ('purchase', 'error') then 'feedback' else event_type end as kind,
 case when user_id % 3 = 0 then 'development' else 'production' end as environment from events"""
_REASONED = """select *, case when kind not in ('click', 'pageview', 'feedback') then 'unknown kind'
  when kind = 'click' and k % 40 = 39 then 'click without url' when kind = 'pageview' and k % 50 = 7 then 'pageview without page'
  when kind = 'feedback' and k % 10 = 9 then 'rating not up or down' end as reason from landed"""
_FANOUT_SQL = f"""with landed as ({_LANDED}), tagged as ({_REASONED})
 select case when reason is null then kind else 'reject' end as sink, reason, environment, count(*) as n from tagged group by 1, 2, 3"""


def _landed_files(spark, events, files: int, name: str) -> str:
    """The events landed as files in an order of their own (by a hash of the id), so that times are out of order."""
    path = IO.scratch(spark, name)
    events.repartition(files, F.xxhash64("event_id", F.lit("landing"))).write.parquet(path)
    return path


def _file_stream(spark, path: str, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("k01_fanout_stream", _FANOUT_SQL)
def k01f(spark, sf_dir):
    """K01 for clicks, pageviews and feedback in one stream, rejects with their reason; the records' counts must agree."""
    events = Tables(spark, sf_dir).events
    path = _landed_files(spark, events, 3, "k01-landed")
    sink = FO.EventFanOut(spark, IO.scratch(spark, "k01-fanout"))
    FO.run_sink(adapters.landed_from(_file_stream(spark, path, events.schema)), sink, IO.scratch(spark, "k01-fanout-ckpt"))
    none = F.lit(None).cast("string").alias("reason")
    parts = [sink.read(kind).groupBy("environment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("sink"), none, "environment", "n") for kind in FO.TABLES]
    parts.append(sink.read("reject").groupBy("reason", "environment").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject").alias("sink"), "reason", "environment", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("c07_rating_rejects", f"""with landed as ({_LANDED}), fb as (select *, case when k % 10 = 9 then 'meh' when event_type = 'purchase' then 'up' else 'down' end as rating
 from landed where kind = 'feedback')
 select event_id as id, rating, rating in ('up', 'down') as saved, case when rating not in ('up', 'down') then 'rating not up or down' end as reason from fb""")
def c07r(spark, sf_dir):
    """Every landed rating, stored or rejected with its reason."""
    fb = adapters.landed_from(Tables(spark, sf_dir).events).where("kind = 'feedback'").withColumn("reason", FO.reject_reason())
    return fb.select("id", "rating", F.col("reason").isNull().alias("saved"), "reason")


@register("k02_hourly_with_late", with_views("select date_trunc('hour', viewed_at) as hour, count(*) as views from pageviews group by 1", "pageviews"))
def k02l(spark, sf_dir):
    """K02 over files out of order: what the watermark leaves behind is kept and added, so the hours equal the batch's."""
    events = Tables(spark, sf_dir).events
    path = _landed_files(spark, events, 4, "k02-landed")
    sink = FO.HourlyWithLate(spark, IO.scratch(spark, "k02-late"), "viewed_at", 3600)
    FO.run_sink(adapters.pageviews_from(_file_stream(spark, path, events.schema)), sink, IO.scratch(spark, "k02-late-ckpt"))
    return sink.table()


@register("k03_dedupe_with_late", "select count(distinct event_id) as n, count(distinct event_id) as ids, min(ts) as first_ts, max(ts) as last_ts from events")
def k03l(spark, sf_dir):
    """K03 over files out of order, each landed twice: one row per id, late rows included."""
    events = Tables(spark, sf_dir).events
    path = _landed_files(spark, events.unionByName(events), 4, "k03-landed")
    sink = FO.DedupeWithLate(spark, IO.scratch(spark, "k03-late"), "event_id", "ts", 86_400)
    FO.run_sink(_file_stream(spark, path, events.schema), sink, IO.scratch(spark, "k03-late-ckpt"))
    return sink.table(events.schema).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
