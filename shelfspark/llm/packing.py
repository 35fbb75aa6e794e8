"""Packing (operator 4): first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document becomes ids and a closing id 0, cut into full sequences and one rest. Documents are dealt at random into
groups of about ``group_docs``; each group is packed on its own: pieces in decreasing size go to the first sequence with
room, found in a tournament tree over the room left. Only piece records shuffle, never ids (unless they are asked for).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteBpe, slabs
from .common import column, store

CAPACITY = 1024
GROUP_DOCS = 4096
SEPARATOR = 0


def read_tokenizer(path: str) -> str:
    """Content of the tokenizer file, read once on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_pieces(df: DataFrame, id_col: str, text_col: str, config: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, lot (a random number per document), and the ids
    (little-endian unsigned 32-bit) where ``keep_ids``."""
    rows = df.select(column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"]
    closing = np.array([SEPARATOR], dtype="<u4").tobytes()

    def kernel(batches):
        codec = ByteBpe(config)
        context = TaskContext.get()
        draw = np.random.default_rng([17, context.partitionId() if context else 0])
        for batch in batches:
            doc_ids, out, kept, at = batch.column(0).to_pylist(), [], [], 0
            for part in slabs([t or "" for t in batch.column(1).to_pylist()]):
                for ids in codec.encode(part):
                    ids += closing
                    n, lot = len(ids) // 4, int(draw.integers(0, 1 << 62))
                    for start in range(0, n, capacity):
                        piece = ids[start * 4: (start + capacity) * 4]
                        out.append((doc_ids[at], start, len(piece) // 4, zlib.crc32(piece), n, lot))
                        if keep_ids:
                            kept.append(piece)
                    at += 1
            cols = [pa.array(c, type=pa.int64()) for c in zip(*out)] if out else [pa.array([], type=pa.int64())] * 6
            if keep_ids:
                cols.append(pa.array(kept, type=pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * keep_ids)

    return rows.mapInArrow(kernel, ", ".join(f"{n} long" for n in names) + ", ids binary" * keep_ids)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; ``sizes`` descend. The tournament tree holds, in each inner node, the most room of its bins."""
    if not sizes:
        return []
    leaves = 1 << (len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        room[node] -= size
        node >>= 1
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
    return out


def _pack_group(pieces: pa.Table, capacity: int) -> pa.Table:
    """The pieces of one group with their sequence_id and offset."""
    size, lot, start = (pieces[c].to_numpy() for c in ("length", "lot", "start"))
    order = np.lexsort((start, lot, -size))
    pieces, size = pieces.take(pa.array(order)), size[order]
    full = int((size == capacity).sum())  # each fills a sequence of its own
    bins = np.concatenate([np.arange(full), full + np.array(first_fit_decreasing(size[full:].tolist(), capacity), dtype=np.int64)])
    by_bin = np.argsort(bins, kind="stable")
    before = np.cumsum(size[by_bin]) - size[by_bin]
    first = np.flatnonzero(np.concatenate([[True], np.diff(bins[by_bin]) != 0]))
    offset = np.empty(len(size), dtype=np.int64)
    offset[by_bin] = before - np.repeat(before[first], np.diff(np.concatenate([first, [len(size)]])))
    group = pieces["lot_group"].to_numpy()
    return pieces.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offset))


def pack(df: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         group_docs: int = GROUP_DOCS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids where asked for).

    Every id of every document lies in exactly one piece and every sequence holds at most ``capacity`` ids. A null or
    empty text is a document of the closing id alone. Null ids are kept as they are, repeated rows are documents of
    their own, an empty table gives no rows, and other columns are neither read nor returned.
    """
    pieces = store(token_pieces(df, id_col, text_col, config, capacity, keep_ids), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    dealt = pieces.withColumn("lot_group", F.pmod(F.xxhash64("lot"), F.lit(groups)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return dealt.groupBy("lot_group").applyInArrow(lambda g: _pack_group(g, capacity).select(names), schema)
