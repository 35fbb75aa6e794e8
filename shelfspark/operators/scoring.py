"""H14's scorer hook: a relevance model as a batch function over (query, document) texts, with its scores kept.

Each distinct pair is scored once: its key is a digest of both texts, scores are appended to a table as one committed run,
and only pairs that the table does not hold reach the scorer.  A second search, a retried task after the run was written or
a document that many queries share does not score again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import committed

SCORES = "pair_key string, score double"
#: Pairs handed to the scorer at once.
BATCH = 256

Scorer = Callable[[list[str], list[str]], list[float | None]]


def pair_key(query: Column, document: Column) -> Column:
    q, d = (F.coalesce(c, F.lit("")) for c in (query, document))
    return F.sha2(F.concat(F.char_length(q).cast("string"), F.lit(":"), q, d), 256)


class ScoreTable:
    """Scores under ``base`` given by ``scorer(queries, documents)``, which runs inside tasks on ``BATCH`` pairs at a time."""

    def __init__(self, base: str, scorer: Scorer, batch: int = BATCH):
        self.base, self.scorer, self.batch = base.rstrip("/"), scorer, batch

    def known(self, spark) -> DataFrame:
        runs = committed(spark, f"{self.base}/run=*")
        return spark.read.schema(SCORES).parquet(*runs) if runs else spark.createDataFrame([], SCORES)

    def scores(self, pairs: DataFrame, query: str = "query", document: str = "document") -> DataFrame:
        """``pairs`` with ``score``; pairs that are new to the table are scored and stored first."""
        scorer, size = self.scorer, self.batch

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    got = scorer(part["_q"].to_pylist(), part["_d"].to_pylist())
                    yield pa.RecordBatch.from_arrays([part["pair_key"], pa.array(got, pa.float64())], ["pair_key", "score"])

        keyed = pairs.withColumn("pair_key", pair_key(F.col(query), F.col(document)))
        texts = keyed.select("pair_key", F.coalesce(query, F.lit("")).alias("_q"), F.coalesce(document, F.lit("")).alias("_d"))
        known = self.known(pairs.sparkSession)
        new = texts.join(known.select("pair_key"), "pair_key", "left_anti").dropDuplicates(["pair_key"])
        new.mapInArrow(kernel, SCORES).write.parquet(f"{self.base}/run={uuid.uuid4().hex}")
        return keyed.join(self.known(pairs.sparkSession).dropDuplicates(["pair_key"]), "pair_key", "left").drop("pair_key")
