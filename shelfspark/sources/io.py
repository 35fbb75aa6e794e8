"""Sources and sinks: JSON array files, JSON-lines reports, partitioned event appends, snapshots.

Writes go to a folder named by the caller; callers on a cluster pass a
folder under the shared ``spark.checkpoint.dir`` (see ``session.shared_dir``).
A table is never overwritten in place while it is being read: upserts write
a new snapshot folder and callers switch to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import LISTINGS
from ..session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def keep(df: DataFrame, name: str, write=None) -> DataFrame:
    """``df`` written once to the shared folder (by ``write(df, path)`` where given) and read back: lineage is cut, and
    Spark knows the table's true size when it plans what joins it."""
    path = scratch(df.sparkSession, name)
    write(df, path) if write else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A02 ------------------------------------------------------------------------
def read_json_array(spark: SparkSession, path: str, schema: T.StructType = LISTINGS) -> DataFrame:
    """A file holding one JSON array of records -> typed rows; missing keys -> NULL."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


# A03 ------------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    """Records as UTF-8 JSON lines (one object per line, not one pretty array)."""
    df.write.mode(mode).json(path)
    return path


# A04 ------------------------------------------------------------------------
def append_report_jsonl(report: DataFrame, path: str) -> DataFrame:
    """Append one JSON row per finished job, then read the whole report back."""
    report.write.mode("append").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


# A05 ------------------------------------------------------------------------
def append_events(events: DataFrame, path: str, environment: str | None = None, ts_col: str | None = None,
                  now: str | None = None) -> None:
    """Append events partitioned by environment and day, stamping environment / event time."""
    df = events
    if environment is not None:
        df = df.withColumn("environment", F.coalesce(F.col("environment"), F.lit(environment))) \
            if "environment" in df.columns else df.withColumn("environment", F.lit(environment))
    if ts_col and now is not None:
        df = df.withColumn(ts_col, F.coalesce(F.col(ts_col), F.lit(now).cast("timestamp_ntz")))
    if ts_col:
        df = df.withColumn("event_date", F.to_date(ts_col))
    parts = ["environment"] + (["event_date"] if ts_col else [])
    df.write.mode("append").partitionBy(*parts).parquet(path)


def write_snapshot(df: DataFrame, base: str) -> str:
    """Write a new snapshot folder of a table and return it (the caller swaps its pointer)."""
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def write_json_arrays(df: DataFrame, path: str, key: str = "url", rows_per_file: int = 1000) -> str:
    """A03 (array form): files that each hold one JSON array of records, as a JSON dump of a
    list does.  Records are dealt round-robin into ``ceil(n / rows_per_file)`` buckets (balanced
    whatever the keys, even with one hot key), so every array -- one group, one file -- stays
    bounded.  Records are ordered by ``key`` inside each array."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_file))
    rec = df.repartition(buckets).select(F.spark_partition_id().alias("bucket"), F.col(key).alias("_k"),
                                         F.to_json(F.struct(*df.columns)).alias("j"))
    rec = rec.select("bucket", F.struct("_k", "j").alias("kj"))
    arrays = rec.groupBy("bucket").agg(F.array_sort(F.collect_list("kj")).alias("kj")).select(
        "bucket", F.transform("kj", lambda x: x["j"]).alias("j"))
    arrays = arrays.select("bucket", F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("bucket").text(path)
    return path
