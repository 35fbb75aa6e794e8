"""One stream of landed events fanned out to click, pageview, feedback and reject tables; K02 / K03 with late rows kept.

Each sink is a ``foreachBatch`` function whose state lies in folders, one per epoch, and whose last step writes the epoch's
record: readers take recorded epochs only, a replayed epoch overwrites its own folders, and a restarted stream finds its
state where it left it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import committed

#: Columns of each table, in the order of the landed events.
TABLES = {
    "click": ["id", "url", "source", "product_name", "user_id", "environment", "ts"],
    "pageview": ["id", "page", "user_id", "session_id", "environment", "ts"],
    "feedback": ["id", "message_id", "rating", "comment", "user_id", "session_id", "environment", "ts"],
}


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def reject_reason() -> Column:
    """Why a landed event cannot be stored; NULL if it can (C07: ratings are up or down)."""
    kind = F.col("kind")
    return (F.when(kind.isNull() | ~kind.isin(*TABLES), F.lit("unknown kind"))
            .when((kind == "click") & _blank("url"), F.lit("click without url"))
            .when((kind == "pageview") & _blank("page"), F.lit("pageview without page"))
            .when((kind == "feedback") & _blank("message_id"), F.lit("feedback without message"))
            .when((kind == "feedback") & ~F.coalesce(F.col("rating").isin("up", "down"), F.lit(False)), F.lit("rating not up or down")))


class _Epochs:
    """Folders under ``base``: ``<table>/epoch=E`` and the records ``epochs/epoch=E``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def recorded(self) -> list[int]:
        return sorted(int(p.rsplit("=", 1)[1]) for p in committed(self.spark, f"{self.base}/epochs/epoch=*"))

    def write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/epoch={int(epoch)}")

    def record(self, epoch: int, row: DataFrame) -> None:
        row.coalesce(1).write.mode("overwrite").json(f"{self.base}/epochs/epoch={int(epoch)}")

    def records(self, before: int | None = None) -> list[dict]:
        wanted = [e for e in self.recorded() if before is None or e < before]
        return [r.asDict() for e in wanted for r in self.spark.read.json(f"{self.base}/epochs/epoch={e}").collect()]  # one row each

    def read(self, table: str, schema=None) -> DataFrame | None:
        paths = [f"{self.base}/{table}/epoch={e}" for e in self.recorded()]
        if not paths:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(*paths)


class EventFanOut(_Epochs):
    """Each micro-batch, read once, goes to the tables of its kinds and to ``reject``; the record holds their counts."""

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        tagged = batch.withColumn("reason", reject_reason()).persist()
        try:
            for kind, cols in TABLES.items():
                self.write(tagged.where((F.col("kind") == kind) & F.col("reason").isNull()).select(*cols), kind, epoch_id)
            self.write(tagged.where(F.col("reason").isNotNull()), "reject", epoch_id)
            n = [F.count_if((F.col("kind") == k) & F.col("reason").isNull()).alias(k) for k in TABLES]
            self.record(epoch_id, tagged.agg(*n, F.count_if(F.col("reason").isNotNull()).alias("reject")))
        finally:
            tagged.unpersist()


class _Watermarked(_Epochs):
    """A sink that knows the largest event time of earlier epochs and splits off rows older than that by ``delay`` seconds."""

    def __init__(self, spark: SparkSession, base: str, ts_col: str, delay_seconds: int):
        super().__init__(spark, base)
        self.ts_col, self.delay = ts_col, int(delay_seconds)

    def watermark(self, before: int | None = None) -> Column:
        """The watermark that batches after the recorded ones meet, as a literal; NULL at first."""
        newest = max((r["newest"] for r in self.records(before) if r.get("newest")), default=None)
        return F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.delay))

    def split(self, batch: DataFrame, edge: Column, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(rows in time, late rows): late ones are those whose ``edge`` the watermark has reached."""
        late = F.coalesce(edge <= self.watermark(epoch), F.lit(False))
        return batch.where(~late), batch.where(late)

    def finish(self, batch: DataFrame, late: DataFrame, epoch: int) -> None:
        self.write(late, "late", epoch)
        self.record(epoch, batch.agg(F.max(self.ts_col).cast("string").alias("newest")))


class HourlyWithLate(_Watermarked):
    """Rows per hour, in partial counts per epoch; rows of hours the watermark has closed go to ``late`` whole."""

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        batch = batch.withColumn("hour", F.date_trunc("hour", self.ts_col).cast("timestamp_ntz")).persist()
        try:
            timely, late = self.split(batch, F.col("hour") + F.make_dt_interval(F.lit(0), F.lit(1)), epoch_id)
            self.write(timely.groupBy("hour").agg(F.count(F.lit(1)).alias("n")), "hours", epoch_id)
            self.finish(batch, late, epoch_id)
        finally:
            batch.unpersist()

    def closed(self) -> DataFrame:
        """What the stream has emitted: hours that the watermark has passed, without late rows."""
        hours = self.read("hours", "hour timestamp_ntz, n long").groupBy("hour").agg(F.sum("n").alias("views"))
        return hours.where(F.col("hour") + F.make_dt_interval(F.lit(0), F.lit(1)) <= self.watermark())

    def table(self) -> DataFrame:
        """Every hour so far, late rows added: equal to a batch count of all rows."""
        late = self.read("late", "hour timestamp_ntz").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
        return self.read("hours", "hour timestamp_ntz, n long").unionByName(late).groupBy("hour").agg(F.sum("n").alias("views"))


class DedupeWithLate(_Watermarked):
    """The first row per key within the delay; its state is the keys newer than the watermark.  Rows behind it go to ``late``."""

    def __init__(self, spark: SparkSession, base: str, key: str, ts_col: str, delay_seconds: int):
        super().__init__(spark, base, ts_col, delay_seconds)
        self.key = key

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            timely, late = self.split(batch, F.col(self.ts_col), epoch_id)
            timely = timely.dropDuplicates([self.key])
            kept = [e for e in self.recorded() if e < epoch_id]
            if kept:
                seen = self.spark.read.schema(batch.schema).parquet(*[f"{self.base}/rows/epoch={e}" for e in kept])
                seen = seen.where(F.coalesce(F.col(self.ts_col) > self.watermark(epoch_id), F.lit(True))).select(self.key).distinct()
                timely = timely.join(seen, self.key, "left_anti").select(*batch.columns)
            self.write(timely, "rows", epoch_id)
            self.finish(batch, late, epoch_id)
        finally:
            batch.unpersist()

    def table(self, schema) -> DataFrame:
        """One row per key of all that came, late rows included."""
        rows, late = self.read("rows", schema), self.read("late", schema)
        return rows.dropDuplicates([self.key]).unionByName(late.dropDuplicates([self.key]).join(rows.select(self.key), self.key, "left_anti").select(*rows.columns))


def run_sink(stream: DataFrame, sink, checkpoint: str) -> None:
    """The stream into a ``foreachBatch`` sink until its source is read to the end."""
    from .events import run_to_end

    run_to_end(stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
