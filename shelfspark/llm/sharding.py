"""Sharding (operator 3): balanced label propagation over documents linked by equal texts, under the law ``rows``.

Linked documents start in a random shard. In each round a group's documents ask for the shard where most of the group
fits: the members there and the room that no document staying there takes, up to the group. The demands between each two
shards are a table of counts by bins of groups, from which the driver fixes what fits the quotas: bins move whole into
free room; of the rest a share moves by swaps between shards and into what room is left. The rounds end when every group
is whole, or when ``rounds`` rounds in a row bring no more together; the best state seen counts. What is left over a target, and all documents without links, fill the shards up to their exact targets,
whose counts differ by at most one. A group larger than a part of a shard is cut into linked parts first: it cannot stay
together, and no round may depend on one group fitting.

Only narrow rows shuffle. Slots are numbered from counts per stored partition, never by one task per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, store

SHARDS = 16
ROUNDS = 8
#: Groups are moved in so many bins, dealt anew in each round.
BINS = 64
#: A linked part holds at most this share of a shard's target.
PART_SHARE = 0.9


def quotas(demand: np.ndarray, load: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Share of the demand [from, to] that may move so that no load ends above its target (in expectation).

    Opposite demands swap; what is left may use the free room of the receiving shard.
    """
    swap = np.minimum(demand, demand.T)
    rest = demand - swap
    room = np.maximum(0, target - load)
    asked = rest.sum(axis=0)
    moved = swap + rest * np.minimum(1.0, room / np.maximum(asked, 1))
    return np.where(demand > 0, moved / np.maximum(demand, 1), 0.0)


def moves(flow: np.ndarray, load: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Share of the demand [bin, from, to] that may move so that no load ends above its target (in expectation).

    A bin moves whole where the free room of its shard takes all of it; the rest moves by ``quotas``, bin after bin.
    """
    share, load = np.zeros(flow.shape), load.copy()
    for to in range(flow.shape[2]):
        for k in range(flow.shape[0]):
            n = flow[k, :, to].sum()
            if 0 < n <= target[to] - load[to]:
                share[k, :, to] = 1.0
                load[to] += n
    rest = np.where(share > 0, 0.0, flow)
    budget = quotas(rest.sum(axis=0), load, target) * rest.sum(axis=0)
    for k in range(flow.shape[0]):
        part = np.minimum(rest[k], budget)
        budget = budget - part
        share[k] += np.where(rest[k] > 0, part / np.maximum(rest[k], 1), 0.0)
    return share


def _propagate(linked: DataFrame, rows: int, shards: int, rounds: int) -> DataFrame:
    """(uid, part, shard) of the linked documents after the rounds."""
    limit = np.full(shards, float(rows // shards))  # documents without links fill what stays open
    state = store(linked.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).withColumn("to", F.lit(None).cast("int")), "shard-state")
    free, least, best, since, turn = limit, None, state, 0, 0
    while True:
        cells = state.groupBy("part", "shard").agg(F.count("*").alias("n"), F.max("to").alias("before"))
        parts = cells.groupBy("part").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max("before").alias("before"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by"))  # at most shards entries
        here = lambda s: F.coalesce(F.element_at("by", s), F.lit(0))
        open_ = F.array(*[F.lit(int(x)).cast("long") for x in free])
        fits = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
            F.least("size", here(s) + F.element_at(open_, s + 1)).alias("score"), here(s).alias("n"), F.xxhash64("part", s).alias("tie"), s.alias("to"))))
        # a part in two thinks again, or all parts of a full shard would leave it together
        again = F.pmod(F.xxhash64("part", F.lit(-1 - turn)), F.lit(2)) == 0
        wanted = parts.where("size > most").withColumn("to", F.when(F.col("before").isNull() | again, fits["to"]).otherwise(F.col("before")))
        wanted = store(wanted.select("part", F.col("to").cast("int").alias("to"), (F.col("size") - F.col("most")).alias("apart")), "shard-wanted")
        apart = wanted.agg(F.coalesce(F.sum("apart"), F.lit(0))).first()[0]
        if least is None or apart < least:
            least, best, since = apart, state, 0
        if not apart or since >= rounds:
            return best.select("uid", "part", "shard")

        asked = state.drop("to").join(wanted.drop("apart"), "part", "left").withColumn("bin", F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(BINS)).cast("int"))
        flow, load, stay = np.zeros((BINS, shards, shards)), np.zeros(shards), np.zeros(shards)
        for r in asked.groupBy("shard", "to", "bin").agg(F.count("*").alias("n")).collect():  # at most shards * (shards + 1) * BINS rows
            load[r["shard"]] += r["n"]
            if r["to"] is None or r["to"] == r["shard"]:
                stay[r["shard"]] += r["n"]
            else:
                flow[r["bin"], r["shard"], r["to"]] = r["n"]
        share = moves(flow, load, limit)
        share = F.split(F.lit(",".join(f"{x:.12g}" for x in share.ravel())), ",").cast("array<double>")
        chance = F.element_at(share, (F.col("bin") * shards + F.col("shard")) * shards + F.col("to") + 1)
        coin = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        moved = asked.withColumn("shard", F.when(F.col("to").isNotNull() & (F.col("shard") != F.col("to")) & (coin < chance), F.col("to")).otherwise(F.col("shard")))
        state = store(moved.select("uid", "part", "shard", "to"), "shard-state")
        free, since, turn = np.maximum(0, limit - stay), since + 1, turn + 1


def _numbered(df: DataFrame, label: str, name: str) -> DataFrame:
    """``df``, stored, with ``nr``: gapless numbers from 0 within each value of ``label`` (an int, null: -1).

    Each task numbers its own rows; the start of a task's numbers is the sum of the counts of the tasks before it, over
    a table of (task, label) counts.
    """
    schema = df.withColumn("task", F.lit(0)).withColumn("at", F.lit(0).cast("long")).schema
    at_label = df.columns.index(label)

    def kernel(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            labels = batch.column(at_label).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.empty(len(labels), dtype=np.int64)
            for v in np.unique(labels).tolist():
                where = np.flatnonzero(labels == v)
                at[where] = seen.get(v, 0) + np.arange(len(where))
                seen[v] = seen.get(v, 0) + len(where)
            cols = [*batch.columns, pa.array(np.full(len(labels), task, dtype=np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "task", "at"])

    stored = store(df.mapInArrow(kernel, schema), name)
    key = F.coalesce(F.col(label), F.lit(-1))
    counts = stored.groupBy("task", key.alias("key")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counts.select("task", "key", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start")), "shard-starts")
    joined = stored.withColumn("key", key).join(starts, ["task", "key"])
    return joined.select(*df.columns, (F.col("start") + F.col("at")).alias("nr"))


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the number of UTF-8 bytes of the text plus one; a null text has none and counts as equal to the empty text.
    Shard counts differ by at most one; slots are gapless from 0 in each shard. Null and repeated ids are rows like any
    other. An empty table gives no rows; other columns are neither read nor returned.
    """
    text = F.coalesce(column(df, text_col).cast("string"), F.lit(""))
    docs = store(df.select(
        column(df, id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.monotonically_increasing_id().alias("uid")), "shard-docs")
    rows = docs.count()
    targets = np.array([rows // shards + (s < rows % shards) for s in range(shards)])

    # linked documents: groups of equal texts, large ones in parts
    most = max(2, int(rows / shards * PART_SHARE))
    groups = store(docs.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    piece = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / F.lit(most)))
    linked = docs.select("uid", "text_key").join(groups, "text_key").select("uid", F.xxhash64("text_key", piece).alias("part"))
    state = _propagate(linked, rows, shards, rounds)

    # linked documents take the first slots of their shards; the rest fills what is open
    placed = _numbered(state.select("uid", "shard"), "shard", "shard-linked").where(F.col("nr") < F.element_at(F.array(*[F.lit(int(t)) for t in targets]), F.col("shard") + 1))
    placed = store(placed.select("uid", "shard", F.col("nr").alias("slot")), "shard-placed")
    taken = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # one row per shard
    taken = np.array([taken.get(s, 0) for s in range(shards)])
    ends = np.cumsum(targets - taken)
    marked = docs.select("doc_id", "size", "text_crc32", "uid").join(placed, "uid", "left")
    done = marked.where("shard is not null")
    free = _numbered(marked.where("shard is null").select("doc_id", "size", "text_crc32", F.lit(0).alias("free")), "free", "shard-free")
    # the shard whose open slots hold number nr
    shard = sum((F.when(F.col("nr") >= int(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    first = F.element_at(F.array(*[F.lit(int(e - (t - k))) for e, t, k in zip(ends, targets, taken)]), F.col("to") + 1)
    begin = F.element_at(F.array(*[F.lit(int(k)) for k in taken]), F.col("to") + 1)
    free = free.withColumn("to", shard.cast("int"))
    free = free.select("doc_id", "size", "text_crc32", F.col("to").alias("shard"), (F.col("nr") - first + begin).alias("slot"))
    out = done.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(free)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
