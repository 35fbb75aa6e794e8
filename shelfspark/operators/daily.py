"""Look-back reports (E01, E04, E08) from mergeable daily states instead of raw events.

A state row is one day, one combination of filter dimensions and either a count or one bucket of an exact bitmap over a
dictionary of values.  Days merge by adding counts and or-ing bitmaps, so distinct users over any window come from the
states alone, and a new day writes one day's states.  A day holds what is newer than its midnight, up to and with the next,
as a look-back's strict comparison wants it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics import ts_lit
from .buckets import committed

DICTIONARY = "column_name string, value string, id long"
#: Ids of one partition of a dictionary update.
ID_SPAN = 1 << 33


def day_of(ts_col: str) -> Column:
    return F.to_date(F.col(ts_col) - F.expr("interval 1 microsecond"))


def new_values(rows: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """Values of ``columns`` that ``known`` lacks, with ids after its own; no global sort."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    fresh = pairs.where("value is not null").distinct().join(known, ["column_name", "value"], "left_anti")
    top = known.agg(F.max("id")).first()[0]
    start = 0 if top is None else (top // ID_SPAN + 1) * ID_SPAN
    return fresh.select("column_name", "value", (F.monotonically_increasing_id() + start).alias("id"))


def daily_states(rows: DataFrame, ts_col: str, dims: list[str], distinct: list[str], counts: dict[str, Column], dictionary: DataFrame) -> DataFrame:
    """day, ``dims``, metric, bucket, bits, n of the days in ``rows``: ``counts`` as they are, ``distinct`` as bitmaps."""
    base = rows.withColumn("day", day_of(ts_col))
    sums = base.groupBy("day", *dims).agg(*[c.alias(f"_{m}") for m, c in counts.items()])
    out = sums.select("day", *dims, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").cast("long").alias("n")) for m in counts])).alias("m"))
    out = out.select("day", *dims, "m.metric", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "m.n")
    for c in distinct:
        # the values of a day are combined map-side before they meet the dictionary, so a hot user is one row a day
        seen = base.where(F.col(c).isNotNull()).select("day", *dims, F.col(c).cast("string").alias("value")).distinct()
        ids = seen.join(dictionary.where(F.col("column_name") == c).select("value", "id"), "value")
        bits = ids.groupBy("day", *dims, F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        out = out.unionByName(bits.select("day", *dims, F.lit(c).alias("metric"), "bucket", "bits", F.lit(None).cast("long").alias("n")))
    return out


def window_totals(states: DataFrame, names: dict[str, str], as_of: str, days: int, **filters) -> DataFrame:
    """One row over the days newer than ``as_of - days`` (a midnight): each metric under its name in ``names``."""
    cut = ts_lit(as_of) - F.make_dt_interval(F.lit(int(days)))
    st = states.where(F.col("day") >= F.to_date(cut))
    for k, v in filters.items():
        if v is not None and v != "":
            st = st.where(F.col(k) == F.lit(v))
    counted = st.where("bits is null").groupBy("metric").agg(F.sum("n").alias("n"))
    merged = st.where("bits is not null").groupBy("metric", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    per = counted.unionByName(merged.groupBy("metric").agg(F.sum(F.bitmap_count("bits")).alias("n")))
    return per.agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).cast("long").alias(name) for m, name in names.items()])


class DailyStates:
    """The states of one event table under ``base``: one folder per day, and the dictionary, one folder per refresh."""

    def __init__(self, spark: SparkSession, base: str, ts_col: str, dims: list[str], distinct: list[str], counts: dict[str, Column]):
        self.spark, self.base, self.ts_col, self.dims, self.distinct, self.counts = spark, base.rstrip("/"), ts_col, dims, distinct, counts

    def dictionary(self) -> DataFrame:
        runs = committed(self.spark, f"{self.base}/dictionary/run=*")
        return self.spark.read.schema(DICTIONARY).parquet(*runs) if runs else self.spark.createDataFrame([], DICTIONARY)

    def refresh(self, rows: DataFrame) -> None:
        """The states of the days in ``rows`` (whole days), which replace those days' folders; other days stay as they are."""
        n = len(committed(self.spark, f"{self.base}/dictionary/run=*"))
        new_values(rows, self.distinct, self.dictionary()).write.mode("overwrite").parquet(f"{self.base}/dictionary/run={n}")
        out = daily_states(rows, self.ts_col, self.dims, self.distinct, self.counts, self.dictionary())
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.base}/states")

    def read(self) -> DataFrame:
        dims = "".join(f"{d} string, " for d in self.dims)
        return self.spark.read.schema(f"{dims}metric string, bucket long, bits binary, n long, day date").parquet(f"{self.base}/states")

    def totals(self, names: dict[str, str], as_of: str, days: int, raw: DataFrame | None = None, **filters) -> DataFrame:
        """``window_totals`` of the stored days.  A window that begins inside a day takes the rest of that day from ``raw``."""
        begin = self.spark.sql(f"select timestamp_ntz'{as_of}' - make_dt_interval({int(days)}) as t").first().t
        states = self.read()
        if (begin.hour, begin.minute, begin.second, begin.microsecond) != (0, 0, 0, 0):
            if raw is None:
                raise ValueError("a window that begins inside a day needs the raw rows of that day")
            day = F.lit(begin.date())
            edge = raw.where((day_of(self.ts_col) == day) & (F.col(self.ts_col) > F.lit(begin).cast("timestamp_ntz")))
            part = daily_states(edge, self.ts_col, self.dims, self.distinct, self.counts, self.dictionary())
            states = states.where(F.col("day") > day).unionByName(part)
        return window_totals(states, names, as_of, days, **filters)
