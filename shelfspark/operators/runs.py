"""Job runs, logs, listing statistics and chat event lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as TX
from ..functions import timeutil as TU
from ..functions import urls as U


def _int_match(text: Column, pat: str) -> Column:
    return F.when(text.rlike(pat), F.regexp_extract(text, pat, 1).try_cast("int"))


# L01 / L02 ------------------------------------------------------------------
def log_stats(text) -> dict[str, Column]:
    """Counters mined from a job's combined stderr + stdout text."""
    t = TX.col(text)
    imgs = F.regexp_extract_all(t, F.lit(fixed.LOG_IMAGES), F.lit(1))
    return {
        "products_found": _int_match(t, fixed.LOG_PRODUCTS_FOUND),
        "products_saved": _int_match(t, fixed.LOG_PRODUCTS_SAVED),
        "categories_found": _int_match(t, fixed.LOG_CATEGORIES_FOUND),
        "images_extracted": F.when(F.size(imgs) > 0, F.aggregate(imgs, F.lit(0).cast("long"),
                                                               lambda a, x: a + x.try_cast("long"))),
    }


def blocked_flag(text) -> Column:
    """The output mentions both '403' and 'forbidden' (case-insensitive)."""
    low = F.lower(TX.col(text))
    return low.contains("403") & low.contains("forbidden")


# L03 ------------------------------------------------------------------------
def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def job_outcome(exit_code, blocked, ts_start, ts_end) -> dict[str, Column]:
    e = TX.col(exit_code)
    d = TX.col(ts_end) - TX.col(ts_start)
    outcome = F.when(e == 0, F.lit("ok")).when(TX.col(blocked), F.lit("403_blocked")).otherwise(
        F.concat(F.lit("exit_"), e.cast("string")))
    return {"outcome": outcome, "duration_s": round2(d), "duration_min": round2(d / 60)}


# E14 ------------------------------------------------------------------------
def run_summary(report: DataFrame) -> DataFrame:
    """Ok / failed / blocked counts and products (saved, else found, else 0)."""
    prod = F.coalesce(F.nullif(F.col("products_saved"), F.lit(0)), F.nullif(F.col("products_found"), F.lit(0)), F.lit(0))
    return report.agg(
        F.count_if(F.col("exit_code") == 0).alias("ok"),
        F.count_if(F.col("exit_code") != 0).alias("failed"),
        F.count_if(F.col("blocked_403")).alias("blocked"),
        F.count(F.lit(1)).alias("total"),
        F.sum(prod.cast("long")).alias("total_products"),
    )


# E16 ------------------------------------------------------------------------
def job_status_counts(job_events: DataFrame, at: Column) -> DataFrame:
    """State of every job at time ``at`` (latest event not after it), counted per state,
    with the longest elapsed time among running jobs."""
    ev = job_events.where(F.col("ts") <= at)
    last = ev.groupBy("job").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("since"))
    elapsed = F.timestamp_diff("SECOND", F.col("since"), at)
    return last.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"),
                                     F.max(F.when(F.col("state") == "running", elapsed)).alias("max_elapsed_s"))


# F02 ------------------------------------------------------------------------
def _in_ranges(df: DataFrame, order: list[str], kernel, schema, name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, run through an Arrow kernel per partition, written once to the
    shared folder and read back: whatever reads it twice sees the same ranges, and nothing shuffles again.  The number
    of ranges follows the data (Spark's shuffle partitions, coalesced by size).  The rows themselves are written first,
    so that the sample which sets the ranges does not compute them twice."""
    from ..sources.io import keep, scratch

    df = keep(df, f"{name}-rows")
    path = scratch(df.sparkSession, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(kernel, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def lag_across_ranges(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """``lag(col) over (partition by key order by order)`` for each of ``cols`` (as ``prev_<col>``),
    without gathering a key's rows in one task: rows are range-partitioned by (key, order), so a
    long key spans several partitions; each task lags its own rows, and the first row of a
    partition takes the last row of the previous partition (a one-row-per-partition table)
    when the key continues across the boundary."""
    lagged = [key, *cols]
    schema = df.withColumns({"_pid": F.lit(0), "_first": F.lit(True), **{f"_lag_{c}": F.col(c) for c in lagged}}).schema

    def kernel(batches):
        pid, held = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(b.schema.names.index(c)) for c in lagged]
            before = held or [pa.nulls(1, c.type) for c in own]
            lag = [pa.concat_arrays([h, c.slice(0, b.num_rows - 1)]) for h, c in zip(before, own)]
            first = pa.array([held is None] + [False] * (b.num_rows - 1))
            held = [c.slice(b.num_rows - 1, 1) for c in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), first, *lag], names=schema.names)

    local = _in_ranges(df, [key, order], kernel, schema, "lag-ranges")
    last = local.groupBy("_pid").agg(F.max_by(F.struct(*lagged), F.struct(key, order)).alias("_row"))
    # predecessor of each non-empty partition = last row of the previous non-empty one
    # (a table with one row per partition, so the global window here is tiny)
    last = last.select("_pid", F.lag("_row").over(Window.orderBy("_pid")).alias("_last"))
    j = local.join(F.broadcast(last), "_pid", "left")
    first = F.col("_first")
    same = F.coalesce(F.when(first, F.col(f"_last.{key}")).otherwise(F.col(f"_lag_{key}")) == F.col(key), F.lit(False))
    prev = [F.when(same, F.when(first, F.col(f"_last.{c}")).otherwise(F.col(f"_lag_{c}"))).alias(f"prev_{c}") for c in cols]
    return j.select(*df.columns, *prev)


def prev_user_query(conv: DataFrame) -> DataFrame:
    """for each assistant message, the preceding message when it is a user message."""
    lagged = lag_across_ranges(conv.select("conv_id", "turn", "role", "text"), "conv_id", "turn", ["role", "text"])
    out = lagged.select("conv_id", "turn", "role",
                        F.when(F.col("prev_role") == "user", F.col("prev_text")).alias("query"))
    return out.where(F.col("role") == "assistant").drop("role")


# E13 / F03 ------------------------------------------------------------------
def pct(part: Column, total: Column) -> Column:
    return F.floor(part.cast("double") * 1000 / F.greatest(total, F.lit(1)) + 0.5) / 10


def origin_stats(listings: DataFrame, flags: list[str]) -> DataFrame:
    """Yes / no / unknown counts and percentages for each three-valued flag (one population)."""
    # one scan: all counts in one aggregate, then a row per flag
    aggs = [x for i, f in enumerate(flags) for x in (
        F.count_if(F.col(f)).alias(f"y{i}"), F.count_if(~F.col(f)).alias(f"n{i}"), F.count_if(F.col(f).isNull()).alias(f"u{i}"))]
    g = listings.agg(*aggs, F.count(F.lit(1)).alias("total"))
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"y{i}").alias("yes"), F.col(f"n{i}").alias("no"), F.col(f"u{i}").alias("unknown"))
                     for i, f in enumerate(flags)])
    df = g.select("total", F.inline(rows))
    return df.select("flag", "yes", "no", "unknown", pct(F.col("yes"), F.col("total")).alias("yes_pct"),
                     pct(F.col("no"), F.col("total")).alias("no_pct"),
                     pct(F.col("unknown"), F.col("total")).alias("unknown_pct"))


def running_prefix(df: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """Global running sums in ``order`` without moving all rows to one task.

    Two passes: a range partitioning by ``order`` gives each partition a contiguous slice;
    each task sums its own rows, and each slice is shifted by the totals of the slices before it
    (a table with one row per partition).
    Adds ``seq`` (1-based global position) and one running column per ``values`` key.
    """
    # a row hash breaks ties, so range boundaries can split a run of equal keys (a hot value
    # does not end up whole in one partition); order among equal keys is arbitrary anyway
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    rows = df.withColumns({"_tie": tie, "_v_seq": F.lit(1).cast("long"), **{f"_v_{k}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in values.items()}})
    names = ["seq", *values]
    schema = rows.withColumn("_pid", F.lit(0)).schema

    def kernel(batches):
        pid, held = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            for k in names:
                sums = np.cumsum(cols[f"_v_{k}"].to_numpy(zero_copy_only=False)) + held[k]
                held[k] = int(sums[-1]) if len(sums) else held[k]
                cols[f"_v_{k}"] = pa.array(sums)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([pid] * b.num_rows, pa.int32())], names=schema.names)

    local = _in_ranges(rows, [order, "_tie"], kernel, schema, "sum-ranges")
    totals = local.groupBy("_pid").agg(*[F.max_by(f"_v_{k}", "_v_seq").alias(f"_t_{k}") for k in names])
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}") for k in names])
    j = local.join(F.broadcast(offsets), "_pid")
    return j.select(*df.columns, *[(F.col(f"_v_{k}") + F.col(f"_o_{k}")).alias(k) for k in names])


def running_stats(listings: DataFrame, flag: str, order: str = "url", every: int = 25) -> DataFrame:
    """cumulative yes / no / unknown counts and percentages, reported every ``every`` rows."""
    c = F.col(flag)
    df = running_prefix(listings.select(order, flag), order, {
        "yes": F.when(c, 1).otherwise(0), "no": F.when(~c, 1).otherwise(0),
        "unknown": F.when(c.isNull(), 1).otherwise(0)})
    df = df.where(F.col("seq") % every == 0)
    return df.select("seq", "yes", "no", "unknown", pct(F.col("yes"), F.col("seq")).alias("yes_pct"))


# L04 / L05 / F05 ----------------------------------------------------------------
EVENT_SCHEMA = "type STRING, content STRING, tool STRING, error STRING"


def event_lines(lines: DataFrame) -> DataFrame:
    """``data: {json}`` lines -> typed events; other or malformed lines are dropped,
    unknown event types ignored."""
    d = lines.where(F.col("line").startswith("data: ")).withColumn(
        "ev", F.from_json(F.substr(F.col("line"), F.lit(7)), EVENT_SCHEMA, {"mode": "PERMISSIVE"}))
    valid = F.try_parse_json(F.substr(F.col("line"), F.lit(7))).isNotNull()
    d = d.where(valid & F.col("ev.type").isin("content", "tool_start", "tool_complete", "done", "error"))
    return d.select("run_id", "seq", "ts", F.col("ev.type").alias("type"), F.col("ev.content").alias("content"),
                    F.col("ev.tool").alias("tool"),
                    F.when(F.col("ev.type") == "error", F.coalesce(F.col("ev.error"), F.lit("Unknown error"))).alias("error"))


def assemble_response(events: DataFrame) -> DataFrame:
    """Content chunks of a run concatenated in order; the first error replaces them."""
    g = events.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "content",
                                           F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))))).alias("chunks"),
        F.min_by(F.col("error"), F.when(F.col("type") == "error", F.col("seq"))).alias("err"))
    return g.select("run_id", F.coalesce("err", F.array_join(F.transform("chunks", lambda x: x["c"]), "")).alias("response"),
                    F.col("err").isNotNull().alias("is_error"))


def event_phase_times(events: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """whole seconds spent planning (start -> first tool / content), in the tool
    (start -> complete) and analysing (complete -> first content after it).

    The run starts at its first received line (``lines``) when given, else at its first event."""
    secs = lambda a, b: F.bround(b.cast("double") - a.cast("double"), 0).cast("long")
    t = TU.epoch_seconds("ts")
    # one pass over the events; the first content after the tool is found among the run's content times
    g = events.groupBy("run_id").agg(
        F.min(t).alias("t0"),
        F.min(F.when(F.col("type").isin("tool_start", "content"), t)).alias("t_first"),
        F.min(F.when(F.col("type") == "tool_start", t)).alias("t_tool"),
        F.min(F.when(F.col("type") == "tool_complete", t)).alias("t_done"),
        F.collect_set(F.when(F.col("type") == "content", t)).alias("contents"),
    )
    j = g.withColumn("t_gen", F.array_min(F.filter("contents", lambda c: c >= F.col("t_done"))))
    if lines is not None:
        starts = lines.groupBy("run_id").agg(F.min(t).alias("t_start"))
        j = j.join(starts, "run_id", "left").withColumn("t0", F.coalesce("t_start", "t0"))
    stack = F.expr("stack(3, 'planning', planning, 'tool', tool, 'analyzing', analyzing) as (phase, seconds)")
    return j.select("run_id", secs(F.col("t0"), F.col("t_first")).alias("planning"),
                    secs(F.col("t_tool"), F.col("t_done")).alias("tool"),
                    secs(F.col("t_done"), F.col("t_gen")).alias("analyzing")).select("run_id", stack).where(
        F.col("seconds").isNotNull())


# J04 / D02 ------------------------------------------------------------------
def exclude_known_domains(sites: DataFrame, known: DataFrame, site_col: str = "base") -> DataFrame:
    """Drop sites whose domain key is already a known site (left anti join)."""
    k = known.select(U.domain_key(U.ensure_scheme(F.col("base"))).alias("_domain")).distinct()
    s = sites.withColumn("_domain", U.domain_key(U.ensure_scheme(F.col(site_col))))
    return s.join(k, "_domain", "left_anti").drop("_domain")


def storefront_jobs(listings: DataFrame, known: DataFrame | None = None, limit: int = 0,
                    prefix: str = "dir_") -> DataFrame:
    """J04 (with C09): storefront listings with a website -> scrape job rows."""
    l = listings.where(F.col("is_shopify_store") & (F.coalesce(F.col("website"), F.lit("")) != "")).orderBy("name")
    if limit > 0:
        l = l.limit(limit)
    jobs = l.select(F.concat(F.lit(prefix), TX.slug(F.col("name"))).alias("name"), U.ensure_scheme("website").alias("base"),
                    F.lit("shopify").alias("store_type"), F.lit(1000).alias("max_categories"))
    return exclude_known_domains(jobs, known) if known is not None else jobs
