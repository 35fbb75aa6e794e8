"""Scans of the landed parquet tables.

Every scan is lazy: column pruning and predicate push-down happen when the
consuming plan is optimised, so callers never pre-select columns here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Attribute access to the landed tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


#: Session setting: number of partitions that small, CPU-heavy scans are dealt over; unset, scans are left as they are.
SPREAD = "spark.shelfspark.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt round-robin over as many partitions as the session setting ``SPREAD`` says, if it says any.

    Per-row parsing (HTML regexes, JSON) of a small table stored as one row group would otherwise run in a single
    task.  Large tables have a partition per block already and need no such setting.
    """
    n = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n)) if n else df
