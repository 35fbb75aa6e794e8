"""Structured Streaming forms of the event operators.

Sources are file streams over landed parquet; sinks are parquet folders
with checkpoints under the shared ``spark.checkpoint.dir``, so a restarted
query (or a lost executor) resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeutil as TU
from ..operators import catalog as C
from ..sources import io as IO


def event_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """A file stream of the parquet files matching ``file_glob`` in ``folder``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", 64).parquet(folder))


def with_event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need a zoned timestamp: the stored wall clock read as UTC (session zone ignored)."""
    return df.withColumn("_event_time", TU.utc_instant(ts_col))


# K01 ------------------------------------------------------------------------
def validate_feedback(fb: DataFrame) -> DataFrame:
    """Keep ratings 'up' / 'down'.  Free texts are stored whole; C08 cuts them for display."""
    return fb.where(F.col("rating").isin("up", "down"))


def ingest_stream(events: DataFrame, sink: str, checkpoint: str, partition_cols=("environment",)):
    """Validated append to a partitioned parquet sink (exactly-once via the checkpoint)."""
    return (events.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .partitionBy(*partition_cols).outputMode("append").trigger(availableNow=True).start())


# K02 ------------------------------------------------------------------------
def hourly_stream(pageviews: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Views per hour, each hour emitted once the watermark passes its end."""
    pv = with_event_time(pageviews, "viewed_at").withWatermark("_event_time", delay)
    g = pv.groupBy(F.window("_event_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("views"))
    return g.select(TU.utc_wallclock(F.col("w.start")).alias("hour"), "views")


# K03 ------------------------------------------------------------------------
def dedupe_stream(events: DataFrame, key: str, ts_col: str, delay: str = "1 day") -> DataFrame:
    """Drop replays of the same event id that arrive within the watermark delay."""
    ev = with_event_time(events, ts_col).withWatermark("_event_time", delay)
    return ev.dropDuplicatesWithinWatermark([key]).drop("_event_time")


# K04 ------------------------------------------------------------------------
class ChangeLogUpsert:
    """``foreachBatch`` sink for keyed upserts whose cost per micro-batch is the batch,
    not the table.

    Each micro-batch is appended to a change log, one folder per epoch (a replayed epoch
    overwrites its own folder, so replays are idempotent).  The table is the base snapshot
    merged with the log on read (``upsert_by_key``: latest row per key by (epoch, ``seq_col``));
    ``compact()`` folds the log into a new snapshot folder.

    Nothing lives in the driver only: which snapshot and log are current is written to a manifest
    in the base folder (the highest committed version counts), and which epochs are in the log is
    read from the folder.  Opening an existing base goes on where it stopped; ``initial`` is then
    not used.
    """

    def __init__(self, spark: SparkSession, base: str, initial: DataFrame | None = None, key: str = "url",
                 seq_col: str | None = None, preserve: list[str] | None = None, now: str | None = None):
        self.spark, self.base, self.key, self.seq_col = spark, base.rstrip("/"), key, seq_col
        self.preserve, self.now = preserve or [], now
        found = self._committed("manifest/v=*")
        if found:
            path = max(found, key=lambda p: int(p.rsplit("=", 1)[1]))
            r = spark.read.json(path).first()
            self.version, self.snapshot, self.log = int(path.rsplit("=", 1)[1]), r["snapshot"], r["log"]
        else:
            self.version = 0
            self._switch(IO.write_snapshot(initial, self.base))

    def _committed(self, pattern: str) -> list[str]:
        """Folders under the base that match and were written to the end."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{pattern}/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().getParent().toString() for f in (found or [])]

    def _switch(self, snapshot: str) -> None:
        self.snapshot, self.log, self.version = snapshot, f"{self.base}/changes-{snapshot.rsplit('-', 1)[-1]}", self.version + 1
        self.spark.createDataFrame([(self.snapshot, self.log)], "snapshot string, log string").coalesce(1).write.json(
            f"{self.base}/manifest/v={self.version}")

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        seq = F.col(self.seq_col).cast("long") if self.seq_col else F.lit(0).cast("long")
        (batch.withColumn("_in_batch", seq).write.mode("overwrite")
         .parquet(f"{self.log}/epoch={int(epoch_id)}"))

    def table(self) -> DataFrame:
        """Merge on read: the snapshot with every logged change applied in order."""
        old = self.spark.read.parquet(self.snapshot)
        epochs = self._committed(f"{self.log.rsplit('/', 1)[-1]}/epoch=*")
        if not epochs:
            return old
        changes = self.spark.read.option("basePath", self.log).parquet(*sorted(epochs))
        return C.upsert_by_key(old, changes, key=self.key, seq=["epoch", "_in_batch"], preserve=self.preserve, now=self.now)

    def compact(self) -> str:
        """Write the merged table as the new snapshot, with an empty log, and switch to it."""
        self._switch(IO.write_snapshot(self.table(), self.base))
        return self.snapshot


def upsert_stream(updates: DataFrame, sink, checkpoint: str):
    """A stream of changes into ``sink``, a ``buckets.BucketedUpsert`` or a ``ChangeLogUpsert``."""
    return (updates.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
