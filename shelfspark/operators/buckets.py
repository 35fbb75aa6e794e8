"""A07 / K04 on a stored table: rows lie in hash buckets of their key, and an upsert rewrites only the buckets it touches.

A manifest (the highest committed version counts) names the version of each bucket; a version's folder holds only the
buckets written then.  Readers take each bucket from its own version, so bytes read and written by an upsert follow the
batch, not the table.  A crash before the manifest is written leaves the table as it was, and the retried version overwrites
its own folder.  One writer at a time; superseded bucket folders stay until they are cleaned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io as IO
from . import catalog as C

#: Rows a bucket of a new table takes, about.
BUCKET_ROWS = 100_000
MAX_BUCKETS = 16_384


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match and were written to the end, by Spark's own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getParent().toString() for f in (found or [])]


class BucketedTable:
    """A keyed table under ``base``; ``create`` starts it, the constructor opens what is committed there.

    Changes come by ``upsert`` (merged at once) or, from a stream, by ``append`` (one log folder per epoch, which a replay
    overwrites): ``table`` merges the log on read, ``compact`` folds it in.  Both shuffle only buckets with changes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        found = committed(spark, f"{self.base}/manifest/v=*")
        if not found:
            raise ValueError(f"no table under {base}")
        self.version = max(int(p.rsplit("=", 1)[1]) for p in found)
        m = json.loads(spark.read.text(f"{self.base}/manifest/v={self.version}").first()[0])
        self.key, self.versions, self.log, self.epoch = m["key"], m["versions"], m["log"], m["epoch"]
        self.schema = T.StructType.fromJson(m["schema"])

    @classmethod
    def create(cls, initial: DataFrame, base: str, key: str = "url", buckets: int | None = None) -> BucketedTable:
        spark, base = initial.sparkSession, base.rstrip("/")
        if committed(spark, f"{base}/manifest/v=*"):
            raise ValueError(f"there is a table under {base}")
        initial = IO.keep(initial, "initial") if buckets is None else initial
        buckets = buckets or max(1, min(MAX_BUCKETS, -(-initial.count() // BUCKET_ROWS)))
        self = cls.__new__(cls)
        self.spark, self.base, self.key, self.schema = spark, base, key, initial.schema
        self.version, self.versions, self.log, self.epoch = 0, [0] * buckets, "log-1", None
        self._write(initial)
        return self

    # ---- layout

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(len(self.versions))).cast("int")

    def _write(self, rows: DataFrame, log: str | None = None, epoch: int | None = None) -> list[int]:
        """``rows`` (whole buckets) as the next version, then its manifest; the buckets written."""
        path = f"{self.base}/data/v={self.version + 1}"
        out = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")  # AQE splits large buckets, joins small ones
        out.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = [r.bucket for r in self.spark.read.schema(out.schema).parquet(path).select("bucket").distinct().collect()]  # at most all buckets
        versions = list(self.versions)
        for b in written:
            versions[b] = self.version + 1
        self._commit(versions, log or self.log, epoch)
        return written

    def _commit(self, versions: list[int], log: str, epoch: int | None) -> None:
        manifest = json.dumps({"key": self.key, "versions": versions, "log": log, "epoch": epoch, "schema": self.schema.jsonValue()})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/manifest/v={self.version + 1}")
        self.version, self.versions, self.log, self.epoch = self.version + 1, versions, log, epoch

    def read(self, buckets: list[int] | None = None, but: list[int] = ()) -> DataFrame:
        """The stored rows of the given buckets (all), without the log."""
        wanted = set(range(len(self.versions)) if buckets is None else buckets) - set(but)
        paths = [f"{self.base}/data/v={self.versions[b]}/bucket={b}" for b in sorted(wanted) if self.versions[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # ---- changes

    def upsert(self, new: DataFrame, epoch: int | None = None, **options) -> list[int]:
        """``new`` merged into the table by ``catalog.upsert_by_key``; the buckets rewritten.  An ``epoch`` that the
        table already holds (a replay) changes nothing."""
        if epoch is not None and self.epoch is not None and epoch <= self.epoch:
            return []
        new = IO.keep(new.withColumn("_bucket", self.bucket()), "batch")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most all buckets
        merged = C.upsert_by_key(self.read(touched), new.drop("_bucket"), key=self.key, **options)
        if not touched:
            self._commit(self.versions, self.log, self.epoch if epoch is None else epoch)
            return []
        return self._write(merged, epoch=self.epoch if epoch is None else epoch)

    def append(self, batch: DataFrame, epoch: int, seq_col: str | None = None) -> None:
        """One micro-batch into the log, by bucket."""
        seq = F.col(seq_col).cast("long") if seq_col else F.lit(0).cast("long")
        batch.withColumn("_in_batch", seq).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.base}/{self.log}/epoch={int(epoch)}")

    def _logged(self) -> tuple[DataFrame | None, list[int]]:
        epochs = sorted(committed(self.spark, f"{self.base}/{self.log}/epoch=*"))
        if not epochs:
            return None, []
        changes = self.spark.read.option("basePath", f"{self.base}/{self.log}").parquet(*epochs)
        return changes, [r.bucket for r in changes.select("bucket").distinct().collect()]  # from folder names; at most all buckets

    def _merged(self, changes: DataFrame, touched: list[int], options: dict) -> DataFrame:
        return C.upsert_by_key(self.read(touched), changes.drop("bucket"), key=self.key, seq=["epoch", "_in_batch"], **options)

    def table(self, **options) -> DataFrame:
        """The table with the log applied in order of (epoch, sequence); only buckets in the log are merged."""
        changes, touched = self._logged()
        if not touched:
            return self.read()
        return self.read(but=touched).unionByName(self._merged(changes, touched, options))

    def compact(self, **options) -> list[int]:
        """The log folded into the buckets it touches, which are rewritten, and a new log begun; the buckets rewritten."""
        changes, touched = self._logged()
        if not touched:
            return []
        return self._write(self._merged(changes, touched, options), log=f"log-{self.version + 1}", epoch=self.epoch)


class BucketedUpsert:
    """``foreachBatch`` sink that appends each micro-batch to the log of a table."""

    def __init__(self, table: BucketedTable, seq_col: str | None = None):
        self.table, self.seq_col = table, seq_col

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        self.table.append(batch, epoch_id, self.seq_col)
