"""Ranked lexical search over a length-stratified index (operator 13).

Index: documents of equal normaliser m form a stratum, cut into blocks (at most ``BLOCK_DOCS`` documents); blocks lie together
in lots that one task holds. A posting row is (lot, block, m, term) with its documents grouped by tf, so that an impact is
computed once per (m, tf). Search: the impact at a block's largest tf bounds what a term can give there. The sums of these
bounds choose each item's first lot, whose k-th score then rules out lots, and inside a lot order the visits of its blocks and
rule out the rest. All else is scored in exact 64-bit integers; no document, item or term is capped.

Defined results: a null text has no terms; rows are documents (a repeated doc_id is ranked again, a null one sorts first);
rows of one item_id are one item with the terms of all; no terms anywhere, no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, store

#: A term is a run of ASCII letters and digits and of all bytes beyond ASCII; A-Z are lower-cased, all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SLICE = 1 << 20
BLOCK_DOCS, BLOCK_POSTINGS, LOT_POSTINGS = 1024, 1 << 18, 1 << 19
#: (item, term) pairs of one batch of queries, about: what a batch sends to every task is 16 bytes and a term for each.
BATCH_PAIRS = 1 << 16
#: Score updates expanded at once inside a task.
UPDATES = 1 << 22

POSTINGS = "lot long, block long, m long, term string, n_docs int, max_tf int, tfs array<int>, runs array<int>, slots array<int>, docs array<long>"


def count_terms(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8) of the whole text, slice by slice."""
    plain = (text or "").encode().translate(LETTERS)
    if len(plain) <= SLICE:
        return Counter(plain.split())
    found, at = Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def forward(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms (distinct), tfs of each row; ``salt`` spreads equal ids."""

    def batch(ids: list, counts: list[Counter], salt: int) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
        tfs = pa.array([v for c in counts for v in c.values()], pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([c.total() for c in counts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), terms),
            pa.ListArray.from_arrays(pa.array(ends), tfs), pa.array(range(salt, salt + len(ids)), pa.int64())], ["id", "n", "terms", "tfs", "salt"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for b in batches:
            ids, counts, held = [], [], 0
            for i, text in zip(b["id"].to_pylist(), b["text"]):
                counts.append(count_terms(text.as_py()))
                ids.append(i)
                held += len(counts[-1])
                if held > BLOCK_POSTINGS:
                    yield batch(ids, counts, salt)
                    salt, ids, counts, held = salt + len(ids), [], [], 0
            yield batch(ids, counts, salt)
            salt += len(ids)

    return rows.select(column(rows, id_col).cast("long").alias("id"), column(rows, text_col).alias("text")).mapInArrow(
        kernel, "id long, n long, terms array<string>, tfs array<int>, salt long")


@dataclass
class Index:
    """Posting rows (and one row with ``docs``, term null, per block); N documents with terms hold L terms with repeats."""

    postings: DataFrame
    n_docs: int
    n_terms: int


class Inverter:
    """Takes documents in order of m and gives the posting rows of each block."""

    def __init__(self, task: int, block_docs: int, lot_postings: int):
        self.block, self.lot, self.in_lot = task << 32, task << 32, 0
        self.block_docs, self.lot_postings = block_docs, lot_postings
        self.m, self.held, self.ids, self.sizes, self.terms, self.tfs = None, 0, [], [], [], []

    def add(self, m: int, doc: int | None, terms: pa.Array, tfs: pa.Array) -> pa.RecordBatch | None:
        full = self.ids and (m != self.m or len(self.ids) >= self.block_docs or self.held + len(terms) > BLOCK_POSTINGS)
        out = self.flush() if full else None
        if not self.ids:
            self.m, self.held = m, 0
        self.ids.append(doc)
        self.sizes.append(len(terms))
        self.terms.append(terms)
        self.tfs.append(tfs)
        self.held += len(terms)
        return out

    def flush(self) -> pa.RecordBatch | None:
        if not self.ids:
            return None
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        code, tf = coded.indices.to_numpy(), pa.concat_arrays(self.tfs).to_numpy()
        slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.lexsort((slot, -tf, code))
        code, tf, slot = code[order], tf[order], slot[order]
        new_term = np.diff(code, prepend=-1) != 0
        first = np.flatnonzero(new_term)
        run = np.flatnonzero(new_term | (np.diff(tf, prepend=-1) != 0))
        run_len = np.diff(np.append(run, len(code))).astype(np.int32)
        run_ends = np.append(np.searchsorted(run, first), len(run)).astype(np.int32)
        ends = np.append(first, len(code)).astype(np.int32)
        t = len(first)

        def whole(value: int) -> pa.Array:
            return pa.array(np.full(t + 1, value, dtype=np.int64))

        def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:  # null for the row of the documents
            return pa.ListArray.from_arrays(pa.array([*offsets[:t].tolist(), None, offsets[t]], pa.int32()), pa.array(values, pa.int32()))

        lot_row = [None] * t + [self.ids]
        out = pa.RecordBatch.from_arrays([
            whole(self.lot), whole(self.block), whole(self.m), pa.concat_arrays([coded.dictionary.take(pa.array(code[first])), pa.nulls(1, pa.string())]),
            pa.array([*np.diff(ends).tolist(), len(self.ids)], pa.int32()), pa.array([*tf[first].tolist(), 0], pa.int32()),
            lists(run_ends, tf[run]), lists(run_ends, run_len), lists(ends, slot), pa.array(lot_row, pa.list_(pa.int64()))],
            ["lot", "block", "m", "term", "n_docs", "max_tf", "tfs", "runs", "slots", "docs"])
        self.block += 1
        self.in_lot += self.held
        if self.in_lot >= self.lot_postings:
            self.lot, self.in_lot = self.lot + 1, 0
        self.ids, self.sizes, self.terms, self.tfs = [], [], [], []
        return out


def lay_out(strata: list, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """(m, first share, shares) of each stratum (m, postings): small ones share a share, large ones are split over several.

    There are at most 50 times as many strata as the longest text is longer than the average one.
    """
    out, share, held = [], 0, 0
    for m, postings in strata:
        if held and held + postings > size:
            share, held = share + 1, 0
        parts = -(-postings // size)
        out.append((m, share, parts))
        share, held = (share + parts, 0) if parts > 1 else (share, held + postings)
    return out, share + 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, lot_postings: int = LOT_POSTINGS) -> Index:
    """The index of all rows with at least one term, over their whole texts."""
    rows = store(forward(docs, id_col, text_col), "forward", "zstd").where("n > 0")
    n_docs, n_terms = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        inverter = Inverter(TaskContext.get().partitionId(), block_docs, lot_postings)
        for b in batches:
            terms, tfs = b["terms"], b["tfs"]
            ends = terms.offsets.to_pylist()
            all_terms, all_tfs = terms.values, tfs.values
            shift = tfs.offsets[0].as_py() - ends[0]
            for k, (m, doc) in enumerate(zip(b["m"].to_pylist(), b["id"].to_pylist())):
                size = ends[k + 1] - ends[k]
                out = inverter.add(m, doc, all_terms.slice(ends[k], size), all_tfs.slice(ends[k] + shift, size))
                if out is not None:
                    yield out
        out = inverter.flush()
        if out is not None:
            yield out

    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = rows.select(m.alias("m"), "id", "salt", "terms", "tfs")
    shares, total = lay_out(rows.groupBy("m").agg(F.sum(F.size("tfs"))).orderBy("m").collect(), lot_postings)
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "m long, base long, parts long"))
    rows = rows.join(shares, "m").withColumn("share", F.expr("base + pmod(xxhash64(id, salt), parts)"))
    rows = rows.repartition(1 + total // 2, "share").sortWithinPartitions("share", "m", "id")
    return Index(store(rows.select("m", "id", "terms", "tfs").mapInArrow(kernel, POSTINGS), "postings", "zstd"), n_docs, n_terms)


@dataclass
class Batch:
    """Queries of one batch: for each of the sorted ``terms`` its weight and the items (positions in ``items``) that hold it."""

    items: list
    terms: dict[str, int]
    weight: np.ndarray
    ends: np.ndarray
    pair_item: np.ndarray


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``starts[i] .. starts[i] + sizes[i] - 1`` one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Lot:
    """The posting rows of one lot that hold terms of a batch."""

    def __init__(self, rows: pa.Table, batch: Batch):
        self.batch = batch
        rows = rows.combine_chunks()
        is_block = rows["term"].is_null().to_numpy()
        heads = rows.filter(pa.array(is_block))
        self.docs = dict(zip(heads["block"].to_pylist(), heads["docs"].combine_chunks() if heads.num_rows else []))
        rows = rows.filter(pa.array(~is_block))
        coded = rows["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        known = np.array([batch.terms[t] for t in coded.dictionary.to_pylist()], dtype=np.int64)
        term = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, dtype=np.int64)
        block = rows["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        self.block, self.term = block[order], term[order]
        self.m, self.max_tf = rows["m"].to_numpy()[order], rows["max_tf"].to_numpy()[order]
        self.lists = None
        if "slots" in rows.column_names:
            rows = rows.take(pa.array(order)).combine_chunks()
            self.lists = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (rows[c].combine_chunks() for c in ("tfs", "runs", "slots"))]
        self.starts = np.flatnonzero(np.diff(self.block, prepend=-1) != 0) if len(self.block) else np.zeros(0, dtype=np.int64)

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of every item that holds the term of a row."""
        term = self.term[lo:hi]
        sizes = self.batch.ends[term + 1] - self.batch.ends[term]
        return np.repeat(np.arange(lo, hi), sizes), self.batch.pair_item[ranges(self.batch.ends[term], sizes)]

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(self.block)]))

    def bound(self, lo: int, hi: int) -> np.ndarray:
        """What each item can score at most in the block of rows lo .. hi."""
        row, item = self.pairs(lo, hi)
        most = self.batch.weight[self.term[lo:hi]] * impact(self.max_tf[lo:hi], int(self.m[lo]))
        return np.bincount(item, most[row - lo], minlength=len(self.batch.items))

    def score(self, lo: int, hi: int, active: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, scores[item, slot]) of the active items over the block; sums of integers below 2^53 are exact."""
        (tf_at, tfs), (run_at, runs), (slot_at, slots) = self.lists
        each = np.repeat(impact(tfs[tf_at[lo]:tf_at[hi]], int(self.m[lo])), runs[run_at[lo]:run_at[hi]])  # once per tf, then dealt to its documents
        row, item = self.pairs(lo, hi)
        row, item = row[active[item]], item[active[item]]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        sizes = slot_at[row + 1] - slot_at[row]
        names, first = np.unique(item, return_index=True)
        cost = np.maximum(np.add.reduceat(sizes, first) if len(first) else sizes, n_docs)
        part = np.cumsum(cost) // UPDATES
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            a, b = first[mine[0]], first[mine[-1] + 1] if mine[-1] + 1 < len(first) else len(item)
            at = ranges(slot_at[row[a:b]], sizes[a:b])
            value = np.repeat(self.batch.weight[self.term[row[a:b]]], sizes[a:b]) * each[at - slot_at[lo]]
            cell = np.repeat(np.searchsorted(names[mine], item[a:b]), sizes[a:b]) * n_docs + slots[at]
            yield names[mine], np.bincount(cell, value, minlength=len(mine) * n_docs).reshape(len(mine), n_docs)


def best(item: np.ndarray, score: np.ndarray, doc: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The k first of each item by score, highest first, then doc_id (null first)."""
    known, ids = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
    order = np.lexsort((ids, known, -score, item))
    sorted_item = item[order]
    at = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
    order = order[at < k]
    return item[order], score[order], doc.take(pa.array(order))


def top_of_lot(lot: Lot, visit: np.ndarray, least: np.ndarray, k: int) -> pa.Table:
    """The k best documents of each visited item in the lot, as far as they reach ``least``; blocks by falling bound."""
    least = least.copy()
    spans = lot.spans()
    bounds = [lot.bound(lo, hi) for lo, hi in spans]
    item, score, doc = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.int64())
    for s in sorted(range(len(spans)), key=lambda s: -bounds[s].max()):
        lo, hi = spans[s]
        active = visit & (bounds[s] >= least)
        if not active.any():
            continue
        docs = lot.docs[int(lot.block[lo])].values
        new = [(item, score, doc)]
        for names, table in lot.score(lo, hi, active, len(docs)):
            i, slot = np.nonzero((table > 0) & (table >= least[names][:, None]))
            new.append((names[i], table[i, slot], docs.take(pa.array(slot))))
        item, score, doc = best(np.concatenate([x[0] for x in new]), np.concatenate([x[1] for x in new]), pa.concat_arrays([x[2] for x in new]), k)
        names, first, held = np.unique(item, return_index=True, return_counts=True)
        full = held >= k
        least[names[full]] = np.maximum(least[names[full]], score[first[full] + k - 1])
    return pa.table({"item": item, "id": doc, "score": score.astype(np.int64)})


def _batches(queries: DataFrame, id_col: str, text_col: str, pairs: int) -> Iterator[list]:
    """(item id, terms) of the items, a bounded number of pairs at a time."""
    rows = forward(queries, id_col, text_col).select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    rows = store(rows, "items")
    n = 1 + (rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // pairs
    for b in range(n):
        yield rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).collect()


def _batch(rows: list, postings: DataFrame, index: Index) -> tuple[Batch, DataFrame]:
    """The batch and the posting rows (documents' rows included) that concern it."""
    spark = postings.sparkSession
    words = sorted({t for r in rows for t in r.terms})
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))  # at most a batch's pairs
    df = {r.term: r.df for r in postings.select("term", "n_docs").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    at = {t: k for k, t in enumerate(words)}
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in words], dtype=np.int64)
    pair = sorted((at[t], i) for i, r in enumerate(rows) for t in r.terms)
    ends = np.searchsorted(np.array([p[0] for p in pair], dtype=np.int64), np.arange(len(words) + 1))
    return Batch([r.id for r in rows], at, weight, ends, np.array([p[1] for p in pair], dtype=np.int64)), wanted


SCORED = ["lot", "block", "m", "term", "max_tf", "tfs", "runs", "slots", "docs"]


def bounds_of(batch: Batch):
    """Kernel over a lot: (lot, item, bound), the most that each item can score in any of its blocks."""

    def kernel(rows: pa.Table) -> pa.Table:
        lot, most = Lot(rows, batch), np.zeros(len(batch.items))
        for lo, hi in lot.spans():
            most = np.maximum(most, lot.bound(lo, hi))
        at = np.flatnonzero(most > 0)
        return pa.table({"lot": pa.array(np.full(len(at), rows["lot"][0].as_py(), dtype=np.int64)), "item": pa.array(at), "bound": pa.array(most[at].astype(np.int64))})

    return kernel


def visit(visits: DataFrame, rows: DataFrame, batch: Batch, least: np.ndarray, k: int) -> DataFrame:
    """The k best documents (item, id, score) of each (lot, item) of ``visits`` that reach the item's ``least`` score."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.zeros(len(batch.items), dtype=bool)
        wanted[left["item"].to_numpy()] = True
        return top_of_lot(Lot(right, batch), wanted, least, k)

    rows = rows.join(visits.select("lot").distinct(), "lot", "left_semi")
    return visits.select("lot", "item").groupBy("lot").cogroup(rows.groupBy("lot")).applyInArrow(kernel, "item long, id long, score long")


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents (all with a score above 0, if fewer)."""
    spark, found = queries.sparkSession, None
    for rows in _batches(queries, id_col, text_col, batch_pairs):
        if not rows:
            continue
        batch, wanted = _batch(rows, index.postings, index)
        terms = index.postings.where("term is not null").join(wanted, "term", "left_semi")
        n = len(batch.items)

        narrow = terms.select("lot", "block", "m", "term", "max_tf", F.lit(None).cast("array<bigint>").alias("docs"))
        most = store(narrow.groupBy("lot").applyInArrow(bounds_of(batch), "lot long, item long, bound long"), "bounds")

        full = terms.select(*SCORED).unionByName(index.postings.where("term is null").select(*SCORED))
        first = most.groupBy("item").agg(F.max(F.struct("bound", "lot")).alias("top")).selectExpr("top.lot as lot", "item")
        head = store(visit(first, full, batch, np.ones(n), k), "first-visits")
        kth = head.groupBy("item").agg(F.count("*").alias("held"), F.min("score").alias("score")).where(F.col("held") >= k).collect()  # at most the batch's items
        least = np.ones(n)
        for r in kth:
            least[r.item] = r.score
        limits = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(least)], "item long, least long"))
        rest = most.join(limits, "item").where("bound >= least").join(first, ["lot", "item"], "left_anti")
        names = F.broadcast(spark.createDataFrame(list(enumerate(batch.items)), "item long, item_id long"))
        part = head.unionByName(visit(rest, full, batch, least, k)).join(names, "item").select("item_id", F.col("id").alias("doc_id"), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return store(found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")


ORACLE_SQL = r"""WITH raw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT doc_id, len(terms) AS n, terms FROM raw WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, stats),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT i.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * t.n * s.big_n) // s.big_l))))::BIGINT AS score
  FROM items i JOIN weights w ON w.term = i.term JOIN tf t ON t.term = i.term, stats s GROUP BY i.item_id, t.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""
