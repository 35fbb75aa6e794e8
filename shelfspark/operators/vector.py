"""Exact and approximate vector top-k (H01, H02) with cosine similarity.

The product scan streams through an Arrow kernel that multiplies each batch by a tile of the query batch and keeps at
most k rows per query and task (ties cut by url); nothing below the kernel shuffles on the product side.  Without an
index every product meets every query.  A ``VectorIndex`` lays the products out by list and keeps each list's centre and
angle radius: by the triangle inequality a list whose nearest possible product is farther than a query's k-th is never
read (exact), or the lists are read until what the rest is expected to hold falls below the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources import io as IO


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def q6(c: Column) -> Column:
    """Quantise a double to 6 decimals (half up), so engines agree on order and ties."""
    return F.floor(c.cast("double") * 1e6 + 0.5) / 1e6


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group in ``order`` with a 1-based rank column."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# kernels ---------------------------------------------------------------------
# A tile is a part of the query batch with a bounded number of bytes and of kept rows; a batch of any size is searched
# tile by tile, and one tile at a time is on the driver.
TILE_BYTES = 32 << 20
TILE_KEPT = 1 << 20
PRODUCT_ROWS = 8192
SCORE_CELLS = 4 << 20

VEC_OUT = "query_id long, id long, url string, vector_similarity double"
FILTERS = ["price_num", "average_rating", "brand_lc", "made_in_canada"]
PRODUCT_COLS = ["id", "url", "embedding", *FILTERS]
QUERY_COLS = ["query_id", "query_vector", "q_min_price", "q_max_price", "q_min_rating", "q_brand", "q_origin"]


def dimension_rejects(products: DataFrame, dim: int) -> DataFrame:
    """Products whose embedding is present but has another dimension than the batch's: they are not comparable."""
    return products.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as doubles; rows that are NULL, of another dimension or hold NULLs become NaN."""
    out = np.full((len(column), dim), np.nan)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if len(at) and dim:
        flat = column.take(pa.array(at)).flatten()
        out[at] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Tile:
    """Some queries: their vectors, and their filters, each distinct one once."""

    def __init__(self, rows: list, dim: int, use_parsed: bool = False, origin_only: bool | None = False):
        self.ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        self.dim = dim
        self.vectors = np.array([r["query_vector"] if len(r["query_vector"]) == dim else [np.nan] * dim for r in rows], dtype=np.float64).reshape(len(rows), dim)
        self.lengths = _lengths(self.vectors)
        self.filters: list[tuple] = []
        known: dict[tuple, int] = {}
        self.filter_of = np.zeros(len(rows), dtype=np.int64)
        for j, r in enumerate(rows):
            origin = bool(r["q_origin"]) if origin_only is None else bool(origin_only)
            key = (origin, *(r[c] for c in ("q_min_price", "q_max_price", "q_min_rating", "q_brand"))) if use_parsed else (origin, None, None, None, None)
            self.filter_of[j] = known.setdefault(key, len(known))
        self.filters = list(known)

    def passes(self, part: dict[str, pa.Array]) -> list[np.ndarray]:
        """Mask over the products of each distinct filter; NULL product values fail a set filter."""
        made = part["made_in_canada"].fill_null(False).to_numpy(zero_copy_only=False)
        price, rating = (part[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("price_num", "average_rating"))
        brand = part["brand_lc"].dictionary_encode()
        code = brand.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out = []
        for origin, low, high, least, name in self.filters:
            ok = made.copy() if origin else np.ones(len(made), dtype=bool)
            if low is not None:
                ok &= price >= low
            if high is not None:
                ok &= price <= high
            if least is not None:
                ok &= rating >= least
            if name is not None:
                holds = pc.match_substring(brand.dictionary, name).to_numpy(zero_copy_only=False)
                ok &= np.append(holds, False)[code]
            out.append(ok)
        return out

    def similarities(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Quantised cosine of products and the queries at ``queries``; vectors without a direction have none (-inf)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (x @ self.vectors[queries].T) / (_lengths(x)[:, None] * self.lengths[queries][None, :])
            s = np.floor(s * 1e6 + 0.5) / 1e6
        s[~np.isfinite(s)] = -np.inf
        return s


def _parts(batches, columns: int, by_list: bool) -> Iterator[tuple[int | None, dict[str, pa.Array]]]:
    """Product batches in slices of one list, so that a slice times the tile stays within ``SCORE_CELLS``."""
    rows = max(64, min(PRODUCT_ROWS, SCORE_CELLS // max(1, columns)))
    for batch in batches:
        names = batch.schema.names
        cuts = [0, batch.num_rows]
        if by_list and batch.num_rows:
            ids = batch.column(names.index("list_id")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, rows):
                part = batch.slice(at, min(rows, hi - at))
                yield (int(ids[lo]) if by_list else None), {n: part.column(i) for i, n in enumerate(names)}


class Best:
    """The k most similar products of each query so far; equal ones by url."""

    SCHEMA = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("score", pa.float64())])

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held, self.new, self.rows = k, np.full(n, -2.0), self.SCHEMA.empty_table(), [], 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array, urls: pa.Array) -> None:
        if len(q):
            self.new.append(pa.table([pa.array(q), ids, urls, pa.array(score)], schema=self.SCHEMA))
            self.rows += len(q)
            if self.rows > max(1 << 16, len(self.held)):
                self.cut()

    def cut(self) -> pa.Table:
        if self.new:
            table = pa.concat_tables([self.held, *self.new]).combine_chunks()
            order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), ("url", "ascending")])
            q = table["q"].to_numpy()[order.to_numpy()]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            self.held = table.take(order.filter(pa.array(nth < self.k))).combine_chunks()
            q, score = self.held["q"].to_numpy(), self.held["score"].to_numpy()
            last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
            self.least[q[last]] = score[last]
            self.new, self.rows = [], 0
        return self.held


def _topk_kernel(tile: Tile, k: int, visits: dict[int, np.ndarray] | None = None) -> Callable:
    """Keeps k products per query and task; ``visits`` names the queries of each list, else all meet all."""

    def run(batches):
        best, everyone = Best(len(tile.ids), k), np.arange(len(tile.ids))
        for list_id, part in _parts(batches, len(tile.ids), visits is not None):
            queries = everyone if visits is None else visits.get(list_id, everyone[:0])
            if not len(queries):
                continue
            s = tile.similarities(_matrix(part["embedding"], tile.dim), queries)
            masks = tile.passes(part)
            for f in np.unique(tile.filter_of[queries]):
                s[np.ix_(~masks[f], tile.filter_of[queries] == f)] = -np.inf
            least = best.least[queries]
            if len(s) > k:  # no more than the slice's own k best (and their ties) can matter
                least = np.maximum(least, np.partition(s, len(s) - k, axis=0)[len(s) - k])
            row, col = np.nonzero((s >= least) & (s > -np.inf))
            at = pa.array(row)
            best.add(queries[col], s[row, col], part["id"].cast(pa.int64()).take(at), part["url"].take(at))
        held = best.cut()
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(tile.ids[held["q"].to_numpy()]), *(held[c].combine_chunks() for c in ("id", "url", "score"))],
                                             names=["query_id", "id", "url", "vector_similarity"])

    return run


def _count_kernel(tile: Tile) -> Callable:
    def run(batches):
        total = np.zeros(len(tile.filters), dtype=np.int64)
        for _, part in _parts(batches, len(tile.filters), False):
            there = part["embedding"].is_valid().to_numpy(zero_copy_only=False)
            total += [int((there & ok).sum()) for ok in tile.passes(part)]
        yield pa.RecordBatch.from_arrays([pa.array(tile.ids), pa.array(total[tile.filter_of])], names=["query_id", "n"])

    return run


def _tiles(queries: DataFrame, k: int, tile_bytes: int, use_parsed: bool, origin_only) -> Iterator[tuple[Tile, bool]]:
    """(tile, whether it is the only one) of a query batch, which should be stored; one is collected at a time."""
    dim, n = queries.agg(F.coalesce(F.max(F.size("query_vector")), F.lit(0)), F.count("query_vector")).first()
    tiles = max(-(-n * max(1, dim) * 8 // tile_bytes), -(-n * k // TILE_KEPT), 1)
    part = F.pmod(F.xxhash64("query_id", F.lit("tile")), F.lit(tiles))
    for t in range(tiles):
        rows = [r.asDict() for r in queries.where((part == t) & F.col("query_vector").isNotNull()).collect()]
        if rows:
            yield Tile(rows, dim, use_parsed, origin_only), tiles == 1


def _union(parts: list[DataFrame], products: DataFrame, schema: str) -> DataFrame:
    out = parts[0] if parts else products.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_filters(queries: DataFrame) -> DataFrame:
    return queries.select(*[F.col(c) if c in queries.columns else F.lit(None).alias(c) for c in QUERY_COLS])


def _best_of(local: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(local, ["query_id"], [F.desc("vector_similarity"), F.asc("url")], k)


# H01 -------------------------------------------------------------------------
def vector_topk(products: DataFrame, queries: DataFrame, k: int = 250, use_parsed: bool = True,
                origin_only: bool | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The ``k`` most similar products per query among those passing its filters:
    ``(query_id, id, url, vector_similarity, rank)``; ties by url.

    ``queries`` is the parsed batch (``hybrid.prepare_queries``), best stored or checkpointed: it is read once per
    tile.  Each tile is one scan; the kept rows of a batch of several tiles are written before the next is collected.
    Products whose vector has another dimension than the batch are not comparable (``dimension_rejects``).
    """
    p = products.select(*PRODUCT_COLS).where(F.col("embedding").isNotNull())
    parts = []
    for tile, alone in _tiles(_with_filters(queries), k, tile_bytes, use_parsed, origin_only):
        local = p.mapInArrow(_topk_kernel(tile, k), VEC_OUT)
        parts.append(local if alone else IO.keep(local, "tile"))
    return _best_of(_union(parts, products, VEC_OUT), k)


def candidate_counts(products: DataFrame, queries: DataFrame, use_parsed: bool = True, origin_only: bool | None = None,
                     tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(query_id, n_candidates)``: products with a vector that pass each query's filters, for queries with any.

    The reference's single-row parameter relation, generalised to a batch: every product meets every distinct filter
    inside the tiled kernel, and a task returns one count per query."""
    p = products.select(*PRODUCT_COLS).where(F.col("embedding").isNotNull())
    parts = []
    for tile, alone in _tiles(_with_filters(queries), 1, tile_bytes, use_parsed, origin_only):
        local = p.mapInArrow(_count_kernel(tile), "query_id long, n long")
        parts.append(local if alone else IO.keep(local, "tile"))
    total = _union(parts, products, "query_id long, n long")
    return total.groupBy("query_id").agg(F.sum("n").alias("n_candidates")).where("n_candidates > 0")


# H02 -------------------------------------------------------------------------
#: Products the centres are fitted on, about: those whose id hash falls below a threshold taken from their number.
FIT_ROWS = 200_000
MAX_LISTS = 4096
#: Products used as probes when the spread of each list is measured.
SPREAD_ROWS = 64
LISTS = "list_id int, center array<double>, n long, radius double, mean_cos double, sd_cos double, spread double"


@dataclass
class VectorIndex:
    """``lists``: per list its centre (unit length), number of products, angle of the farthest one, and mean and spread
    of its cosines (at most ``MAX_LISTS`` rows); ``rows``: the products with ``list_id``, one folder per list."""

    lists: DataFrame
    rows: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / _lengths(x)[:, None]


def fit_centers(products: DataFrame, lists: int | None = None, seed: int = 7, max_iter: int = 10, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, some unit vectors): k-means over unit vectors of a hash-threshold sample, which no single task gathers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = products.where(F.col("embedding").isNotNull()).select("id", "embedding").withColumn("_n", norm(F.col("embedding"))).where("_n > 0")
    n, dim = known.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return np.zeros((0, 0)), np.zeros((0, 0))
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30))
    pick = known.where(F.size("embedding") == dim).where(draw < int((1 << 30) * min(1.0, fit_rows / n)) + 1)
    unit = IO.keep(pick.select(draw.alias("draw"), F.transform("embedding", lambda v: v.cast("double") / F.col("_n")).alias("unit")), "fit-sample")
    lists = lists or max(1, min(MAX_LISTS, math.isqrt(n)))
    k = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="list_id")
    model = k.fit(unit.select(array_to_vector("unit").alias("features")))
    probes = unit.orderBy("draw").limit(SPREAD_ROWS).collect()  # top-k: SPREAD_ROWS rows
    return _unit(np.array([c for c in model.clusterCenters()])), np.array([r.unit for r in probes])


def assign_lists(products: DataFrame, centers: np.ndarray) -> DataFrame:
    """``products`` with the ``list_id`` of the nearest centre; those without a comparable vector are left out."""
    at, dim = products.columns.index("embedding"), centers.shape[1]

    def kernel(batches):
        for b in batches:
            x = _unit(_matrix(b.column(at), dim)) if dim else np.zeros((b.num_rows, 0))
            ok = np.isfinite(x).all(axis=1) & bool(dim)
            part = b.filter(pa.array(ok))
            nearest = (x[ok] @ centers.T).argmax(axis=1) if ok.any() else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32))], names=[*part.schema.names, "list_id"])

    return products.mapInArrow(kernel, products.withColumn("list_id", F.lit(0)).schema)


def list_statistics(rows: DataFrame, centers: np.ndarray, probes: np.ndarray) -> DataFrame:
    """LISTS of the assigned rows.

    With a the angle of a query to the centre, a product's cosine to the query is cos(a) cos(b) + sin(a) t: b is the
    product's own angle to the centre, t its part across.  ``mean_cos`` and ``sd_cos`` describe cos(b); ``spread`` is the
    root mean square of t over the probes."""
    dim = centers.shape[1]

    def kernel(batches):
        found: dict[int, np.ndarray] = {}
        for l, part in _parts(batches, len(probes) + 1, True):
            x = _unit(_matrix(part["embedding"], dim))
            own, across = np.clip(x @ centers[l], -1, 1), probes @ centers[l]
            t = (x @ probes.T - own[:, None] * across) / np.sqrt(np.maximum(1 - across**2, 1e-9))
            t = t[:, np.abs(across) < 0.999]
            new = np.array([len(x), own.min(), own.sum(), (own**2).sum(), (t**2).sum(), t.size])
            old = found.get(l)
            found[l] = new if old is None else np.append((old + new)[:1], [min(old[1], new[1]), *(old + new)[2:]])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([v[i] for v in found.values()], pa.float64()) for i in range(6))],
                                             names=["list_id", "n", "least", "s1", "s2", "t2", "tn"])

    got = rows.select("list_id", "embedding").mapInArrow(kernel, "list_id int, n double, least double, s1 double, s2 double, t2 double, tn double")
    got = got.groupBy("list_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("s1", "s2", "t2", "tn")])
    named = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_id int, center array<double>")
    return got.join(F.broadcast(named), "list_id").select(
        "list_id", "center", F.col("n").cast("long").alias("n"), F.acos("least").alias("radius"), F.expr("s1 / n").alias("mean_cos"),
        F.expr("sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0D))").alias("sd_cos"), F.expr("sqrt(coalesce(try_divide(t2, tn), 0D))").alias("spread"))


def _write_by_list(df: DataFrame, path: str) -> None:
    # AQE splits a large list over several files and puts small ones together
    df.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def build_vector_index(products: DataFrame, lists: int | None = None, store: Callable | None = None, **options) -> VectorIndex:
    """H02's index.  ``store(name, build, write)`` keeps a table under a name and reads it back (default: the shared
    folder); a stored index is read without being built again."""
    fitted: list = []

    def fit():
        if not fitted:
            fitted.extend(fit_centers(products, lists, **options))
        return fitted

    def keep(name, build, write=lambda d, p: d.write.parquet(p)):
        return IO.keep(build(), name, write) if store is None else store(name, build, write)

    name = f"ivf_{lists or 'auto'}"
    rows = keep(f"{name}_rows", lambda: assign_lists(products, fit()[0]), _write_by_list)
    return VectorIndex(keep(f"{name}_lists", lambda: list_statistics(rows, *fit())), rows)


def _angles(tile: Tile, centers: np.ndarray) -> np.ndarray:
    """Angle of each query of the tile to each centre; pi for queries without a direction."""
    if tile.dim != centers.shape[1]:
        return np.full((len(tile.ids), len(centers)), np.pi)
    return np.arccos(np.clip(np.nan_to_num(_unit(tile.vectors) @ centers.T, nan=-1.0), -1, 1))


def _by_list(ids: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """list_id -> queries of a (query, list) mask."""
    return {int(ids[l]): np.flatnonzero(wanted[:, l]) for l in np.flatnonzero(wanted.any(axis=0))}


def lists_to_read(angle: np.ndarray, kth: np.ndarray, lists: dict[str, np.ndarray], k: int, recall: float) -> np.ndarray:
    """(query, list) mask of the lists that can still matter once a query's k-th similarity is ``kth``.

    ``recall`` 1: all whose best possible similarity reaches it.  Below 1: of those, in order of the hits expected in
    them, all but the last that together are expected to miss at most (1 - recall) k / 2."""
    best = np.cos(np.maximum(angle - lists["radius"] - 1e-7, 0.0))
    can = np.floor(best * 1e6 + 0.5) / 1e6 >= kth[:, None]
    if recall >= 1:
        return can
    mean = np.cos(angle) * lists["mean_cos"]
    sd = np.sqrt((np.cos(angle) * lists["sd_cos"]) ** 2 + (np.sin(angle) * lists["spread"]) ** 2) + 1e-6
    z = (kth[:, None] - mean) / sd
    hits = np.where(can, lists["n"] * 0.5 * np.vectorize(math.erfc)(z / math.sqrt(2)), 0.0)
    order = np.argsort(hits, axis=1)
    missed = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1) <= (1 - recall) * k / 2
    leave = np.zeros_like(can)
    np.put_along_axis(leave, order, missed, axis=1)
    return can & ~leave


def vector_topk_indexed(index: VectorIndex, queries: DataFrame, k: int = 250, use_parsed: bool = True, origin_only: bool | None = None,
                        recall: float = 1.0, probes: int = 4, tile_bytes: int = TILE_BYTES, read: list | None = None) -> DataFrame:
    """H01 / H02 over an index: as ``vector_topk``, exact for ``recall`` 1, else about that share of each query's k rows.

    A query first visits its ``probes`` nearest lists; the k-th similarity found there decides which others it must.
    Only folders of visited lists are read.  ``read`` takes, per tile, the number of (query, list) visits of all."""
    lists = {c: np.array([r[c] for r in rows]) for rows in [index.lists.orderBy("list_id").collect()] for c in ("list_id", "center", "n", "radius", "mean_cos", "sd_cos", "spread")}
    ids, parts, p = lists["list_id"], [], index.rows
    p = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in zip(PRODUCT_COLS, ["long", "string", "array<float>", "double", "double", "string", "boolean"])], "list_id")
    for tile, _ in _tiles(_with_filters(queries), k, tile_bytes, use_parsed, origin_only):
        if not len(ids):
            continue
        angle = _angles(tile, lists["center"])
        near = np.zeros(angle.shape, dtype=bool)
        np.put_along_axis(near, np.argsort(angle, axis=1)[:, :probes], True, axis=1)

        def visit(wanted: np.ndarray, tile=tile) -> DataFrame:
            by_list = _by_list(ids, wanted)
            return p.where(F.col("list_id").isin(sorted(by_list))).mapInArrow(_topk_kernel(tile, k, by_list), VEC_OUT)

        first = IO.keep(_best_of(visit(near), k).drop("rank"), "first-lists")
        found = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("vector_similarity").alias("kth")).where(F.col("n") >= k).collect()  # a tile's queries
        known = {r.query_id: r.kth for r in found}
        kth = np.array([known.get(int(q), -2.0) for q in tile.ids])
        rest = lists_to_read(angle, kth, lists, k, recall) & ~near
        parts.append(first)
        if rest.any():
            parts.append(IO.keep(visit(rest), "further-lists"))
        if read is not None:
            read.append((int(near.sum() + rest.sum()), near.size))
    return _best_of(_union(parts, index.rows, VEC_OUT), k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per-query recall of an approximate top-k against the exact one."""
    hit = exact.join(approx.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"))
    tot = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    return tot.join(hit, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("recall"))
