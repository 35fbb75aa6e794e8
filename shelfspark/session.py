"""Spark session helpers.

Library code never builds its own session: every operator takes DataFrames.
``get_spark`` exists for tests, the bench and the CLI-like helpers only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session defaults the operators rely on: UTC wall clock (event times are
# stored without a zone), AQE for runtime coalescing / skew splits.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "shelfspark") -> SparkSession:
    master = master or os.environ.get("SHELFSPARK_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):  # one machine, small tables of one row group each: use all its cores
        b = b.config("spark.shelfspark.scan.partitions", str(os.environ.get("SHELFSPARK_SPREAD", shuffle_partitions)))
    b = b.config("spark.driver.memory", os.environ.get("SHELFSPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset on a local master (tests) do we pick a scratch folder; on a
    cluster a machine-local folder would lose data, so an unset folder is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="shelfspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
