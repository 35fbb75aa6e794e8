"""SimHash near-duplicates (operator 6): candidate pairs judged by their pivot distance tables.

1. Each text becomes one 64-bit fingerprint; equal fingerprints are folded into one row.
2. Two fingerprints with at most r differing bits agree on at least two of r + 2 bit blocks, so each fingerprint goes
   into one bucket for each pair of blocks, and every pair to find meets in some bucket. Buckets with one member stop here.
3. In a bucket the Hamming distances of its members to the reference fingerprints (the pivots) are computed once. By the
   triangle inequality no coordinate of two linked fingerprints differs by more than r, so pairs whose largest
   coordinate difference exceeds r are discarded; the survivors are verified bit by bit.
4. Only a spanning forest of the verified links leaves a task; components follow from the link table.

A bucket with more than ``tile`` members is cut into chunks and each pair of chunks is a group of its own: no bucket
ends in one task, no pair is lost. Buckets hold distinct fingerprints, so copies never meet each other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, fresh, local_components, store

SEED = 42
SHINGLE = 4
MAX_BITS = 4
PIVOTS = 24
TILE = 2048


def text_fingerprint(text: str | None, shingle: int = SHINGLE, slab: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of ``text``: A-Z lower-cased, words split at ASCII white space, word shingles hashed by
    XXH64; a bit is set where over half of the hashes have it. Fewer words: one shingle; none: zero. Null: no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) <= shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), slab):
        pairs = zip(starts[at: at + slab].tolist(), ends[at: at + slab].tolist())
        hashes = np.array([digest(joined[x:y], SEED) for x, y in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with its SimHash as a signed long in column ``out``."""
    schema = df.withColumn(out, F.lit(0).cast("long")).schema
    at = df.columns.index(text_col)

    def kernel(batches):
        for batch in batches:
            marks = np.array([text_fingerprint(x, shingle) for x in batch.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], names=[*batch.schema.names, out])

    return df.mapInArrow(kernel, schema)


def block_masks(max_bits: int) -> list[int]:
    """For each pair of the max_bits + 2 blocks, the mask of its bits as a signed 64-bit number."""
    cuts = [round(64 * i / (max_bits + 2)) for i in range(max_bits + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The pivots: zero and n - 1 fixed pseudo-random fingerprints."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.zeros(1, dtype=np.uint64), rng.integers(0, 1 << 64, n - 1, dtype=np.uint64)])


def pivot_table(marks: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One row of Hamming distances to the pivots for each fingerprint."""
    return np.bitwise_count(marks[:, None] ^ pivots[None, :]).astype(np.int8)


def linked_pairs(marks: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those within ``max_bits``: first by coordinate differences, then verified."""
    for k in range(table.shape[1]):
        near = np.abs(table[i, k] - table[j, k]) <= max_bits
        i, j = i[near], j[near]
    near = np.bitwise_count(marks[i] ^ marks[j]) <= max_bits
    return i[near], j[near]


def _run_links(marks, table, chunk, start, end, max_bits, slab=256):
    """Links inside one large group marks[start:end]; across its two chunks where it has two."""
    left = right = np.arange(start, end)
    crossing = chunk[start:end].min() != chunk[start:end].max()
    if crossing:
        first = chunk[start:end] == chunk[start]
        left, right = left[first], right[~first]
    for at in range(0, len(left), slab):
        rows = left[at: at + slab]
        near = np.abs(table[rows, 0][:, None] - table[right, 0][None, :]) <= max_bits
        for k in range(1, min(6, table.shape[1])):
            near &= np.abs(table[rows, k][:, None] - table[right, k][None, :]) <= max_bits
        if not crossing:
            near &= rows[:, None] < right[None, :]
        a, b = np.nonzero(near)
        yield linked_pairs(marks, table, rows[a], right[b], max_bits)


def _group_links(keys: np.ndarray, chunk: np.ndarray, marks: np.ndarray, pivots: np.ndarray, max_bits: int, small: int = 24):
    """Nodes and local roots of all links in the groups; equal rows of ``keys`` are one group and stand together."""
    change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])
    size = ends - starts
    table = pivot_table(marks, pivots)
    group = np.repeat(np.arange(len(starts)), size)
    found = []
    few = np.flatnonzero((size <= small)[group])
    for step in range(1, small):
        i = few[: len(few) - step]
        j = few[step:]
        same = group[i] == group[j]
        if not same.any():
            break
        found.append(linked_pairs(marks, table, i[same], j[same], max_bits))
    for g in np.flatnonzero(size > small):
        parts = list(_run_links(marks, table, chunk, starts[g], ends[g], max_bits))
        a, b = (np.concatenate(x) for x in zip(*parts))
        if len(a):
            nodes, roots = local_components(a, b)  # positions; keeps what is held for one group small
            found.append((nodes, roots))
    signed = marks.view(np.int64)
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=np.int64)
    nodes, roots = local_components(signed[a], signed[b])
    apart = nodes != roots
    return nodes[apart], roots[apart]


def _links_kernel(pivots: np.ndarray, max_bits: int, hold: int = 1 << 17):
    """Over rows sorted by group: takes whole groups together, some ``hold`` rows at a time."""

    def emit(keys, chunk, marks):
        a, b = _group_links(keys, chunk, marks, pivots, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def kernel(batches):
        keys, chunk, marks = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            col = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(col[:3], axis=1)])
            chunk = np.concatenate([chunk, col[3]])
            marks = np.concatenate([marks, col[4].view(np.uint64)])
            if len(keys) >= hold:
                last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield emit(keys[:cut], chunk[:cut], marks[:cut])
                    keys, chunk, marks = keys[cut:], chunk[cut:], marks[cut:]
        if len(keys):
            yield emit(keys, chunk, marks)

    return kernel


def near_links(marks: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of distinct fingerprints within ``max_bits`` bits.

    ``marks`` has one row per distinct fingerprint, column ``fp``.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(block_masks(max_bits))])
    placed = marks.select(F.explode(keys).alias("key"), "fp")
    shared = store(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    cut = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    member = placed.join(shared, "key").withColumn("chunks", cut).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    member = member.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp")
    member = member.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "chunk")
    return member.mapInArrow(_links_kernel(reference_fingerprints(pivots), max_bits), "a long, b long")


def fingerprint_classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of ``prints`` (id, fp): root is a fingerprint that names the
    component, component_id the smallest id in it."""
    first = store(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-first")
    root = connected_components(near_links(first.select("fp"), max_bits), "a", "b").withColumnRenamed("node", "fp")
    rooted = store(first.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = store(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    return store(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-classes")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Null and empty texts have no words and the fingerprint zero, which links like any other. Repeated rows and rows
    with equal texts share a fingerprint and so a component. component_id is the smallest non-null id of the component,
    null only where it has no other. An empty table gives no rows; other columns are neither read nor returned.
    """
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text"))
    prints = store(with_fingerprint(rows, "text", "fp", shingle).select("id", "fp"), "simhash-prints")
    classes = fingerprint_classes(prints, max_bits)
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest id (null ids last, ties by text hash).

    Of several rows with the same id and text any one stays. The decision is made on narrow rows; whole rows shuffle
    once, to meet it.
    """
    mark, text_hash, none, ident = fresh(df, "llm_fp", "llm_hash", "llm_none", "llm_id")
    keyed = df.withColumns({text_hash: F.xxhash64(column(df, text_col)), none: column(df, id_col).isNull(), ident: F.coalesce(column(df, id_col).cast("long"), F.lit(0).cast("long"))})
    rows = keyed.select(F.col(ident).alias("id"), F.col(none).alias("none"), F.col(text_hash).alias("hash"), column(df, text_col).cast("string").alias("text"))
    prints = store(with_fingerprint(rows, "text", "fp", shingle).drop("text"), "simhash-prints")
    classes = fingerprint_classes(prints.select(F.when(~F.col("none"), F.col("id")).alias("id"), "fp"), max_bits)
    best = prints.join(classes, "fp").groupBy("root").agg(F.min(F.struct("none", "id", "hash", "fp")).alias("best"))
    best = store(best.select(F.col("best.none").alias(none), F.col("best.id").alias(ident), F.col("best.hash").alias(text_hash)), "simhash-kept")
    keys = [none, ident, text_hash]
    kept = keyed.join(best, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*["`" + c.replace("`", "``") + "`" for c in df.columns])
