"""Embedding near-duplicates (operator 7): NN-descent over balls of almost equal vectors.

1. Vectors within a few degrees of each other are folded into balls (a leader, a count, a radius in degrees), slice by
   slice and then along random-hyperplane orders. A ball's radius stays below half the link angle, so its members are all
   linked with each other, and a group with a third of all rows becomes a few leaders instead of its square of pairs.
2. NN-descent over the leaders: lists start from windows of several random-hyperplane orders and are refined by joins
   with the neighbours of neighbours. A list holds the K nearest and, beyond K, the leaders within reach of a link, so a
   list that is full of links grows instead of losing some. A leader with ``DENSE`` of them is dense: it leaves the joins,
   and its connected dense region, with all that borders on it, is compared tile by tile instead. Tiles give counts, a
   spanning forest and the pairs of large balls that must be looked into, never a row per link.
3. An audit takes leaders, with and without links found, as queries against all leaders, block by block until enough
   reachable pairs have been seen or every leader has been asked, and measures the share of those pairs found. Below the
   goal, more orders, rounds and audits follow; a search that stays below it raises. Pairs that the audit sees are kept.
4. Two balls whose farthest members must be linked are linked as a whole (counts add up, no pairs are made); balls that
   only may hold links are compared member by member, in tiles. Cosines are in double precision throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, connected_components, local_components, store

MIN_COSINE = 0.9
BALL_DEGREES = 8.0
NEIGHBOURS = 8
ORDERS = 6
SLICE = 2048
SPAN = 192
MAX_ROUNDS = 5
AUDIT_QUERIES = 256
AUDIT_BLOCK = 4096
AUDIT_PAIRS = 1000
AUDIT_GOAL = 0.995
ATTEMPTS = 6
#: Leaders within reach from which a leader is dense; balls up to this size are compared member by member in its region.
DENSE = 64
TILE = 1024
#: Allowance for rounding where an angle decides; what lies inside is compared vector by vector.
SLACK = 1e-5


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of doubles, each divided by its length."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _degrees(cosine):
    return np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): v is the vector scaled to largest component 1, as doubles, null where it cannot link."""
    rows = df.select(column(df, id_col).alias("vec_id"), column(df, vector_col).cast("array<double>").alias("e"))

    def packed(e):
        if e is None or not e or None in e:
            return None
        x = np.array(e, dtype="<f8")
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        return (x / top).tobytes()

    def kernel(batches):
        for batch in batches:
            v = [packed(e) for e in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 if x else 0 for x in v], pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "dim", "v"])

    return rows.mapInArrow(kernel, rows.select("vec_id").withColumn("dim", F.lit(0)).withColumn("v", F.lit(None).cast("binary")).schema)


def _runs(batches, keys, most: int, overlap: int = 0):
    """Consecutive rows with equal values in the first ``keys`` columns, as lists of columns of at most ``most`` rows;
    each starts ``overlap`` rows before the end of the one before it. ``most`` None: whole runs."""
    held, key, old = [], None, 0
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if held and (row[:keys] != key or most and len(held) >= most):
                yield [list(c) for c in zip(*held)]
                held = held[len(held) - overlap:] if row[:keys] == key and overlap else []
                old = len(held)
            key = row[:keys]
            held.append(row)
    if len(held) > old:
        yield [list(c) for c in zip(*held)]


def _fold(rows: DataFrame, ball: float, widest: float) -> DataFrame:
    """(lid, leader, gap): rows (dim, lid, r, v), in the order given, join the first row of their slice within ``ball``
    degrees, if that keeps the ball within ``widest``; gap is the angle to it."""

    def kernel(batches):
        for _, lid, r, v in _runs(batches, 1, SLICE):
            x, r = _unit(v), np.array(r)
            angle = _degrees(x @ x.T)
            ok = (angle <= ball) & (angle + r[None, :] <= widest)
            lead = np.full(len(lid), -1)
            for i in range(len(lid)):
                if lead[i] < 0:
                    near = ok[i] & (lead < 0)
                    near[i] = True
                    lead[near] = i
            gap = angle[lead, np.arange(len(lid))]
            gap[lead == np.arange(len(lid))] = 0.0
            lid = np.array(lid)
            yield pa.RecordBatch.from_arrays([pa.array(lid), pa.array(lid[lead]), pa.array(gap)], names=["lid", "leader", "gap"])

    return rows.mapInArrow(kernel, "lid long, leader long, gap double")


def _in_order(rows: DataFrame, orders: int, seed: int) -> DataFrame:
    """``rows`` (lid, dim, r, v) once for each random-hyperplane order: turn, dim, sign bits, and sorted by them."""
    names = ["turn", "dim", "bits", "lid", "r", "v"]

    def kernel(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            dims = c["dim"].to_numpy(zero_copy_only=False)
            raw = c["v"].to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _unit([raw[i] for i in at])
                take = pa.array(at)
                for turn in range(orders):
                    planes = np.random.default_rng([seed, turn, dim]).normal(size=(dim, 40))
                    bits = (x @ planes > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(bits), c["lid"].take(take), c["r"].take(take), c["v"].take(take)], names=names)

    placed = rows.select("lid", "dim", "r", "v").mapInArrow(kernel, "turn int, dim int, bits long, lid long, r double, v binary")
    return placed.repartitionByRange("turn", "dim", "bits").sortWithinPartitions("turn", "dim", "bits", "lid")


def _pairs(lid: np.ndarray, r: np.ndarray, v: list[bytes], angle: float, neighbours: int, kth: np.ndarray | None = None):
    """Pairs of the rows worth keeping: within reach of a link, or among the nearest (better than the K-th known)."""
    x = _unit(v)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2.0)
    near = _degrees(cosine) <= angle + SLACK + r[:, None] + r[None, :]
    np.fill_diagonal(near, False)
    if kth is None:
        k = min(neighbours, len(lid) - 1)
        good = np.zeros_like(near)
        if k > 0:
            np.put_along_axis(good, np.argpartition(-cosine, k - 1, axis=1)[:, :k], True, axis=1)
            np.fill_diagonal(good, False)
    else:
        good = (cosine > kth[:, None]) & (cosine > -2.0)
    a, b = np.nonzero(np.triu((good | good.T | near), 1))
    low, high = np.minimum(lid[a], lid[b]), np.maximum(lid[a], lid[b])
    some = low != high
    return pa.RecordBatch.from_arrays([pa.array(low[some]), pa.array(high[some]), pa.array(cosine[a, b][some]), pa.array(near[a, b][some])], names=["a", "b", "cosine", "near"])


PAIR_DDL = "a long, b long, cosine double, near boolean"


def _windows(leaders: DataFrame, angle: float, neighbours: int, orders: int, seed: int) -> DataFrame:
    """Pairs found in overlapping windows of the random orders."""

    def kernel(batches):
        for _, _, _, lid, r, v in _runs(batches, 2, SPAN, SPAN // 2):
            yield _pairs(np.array(lid), np.array(r), v, angle, neighbours)

    return _in_order(leaders, orders, seed).mapInArrow(kernel, PAIR_DDL)


def _merged(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("near").alias("near"))


def _lists(pairs: DataFrame, neighbours: int) -> DataFrame:
    """(src, dst, cosine, rank, near): the K nearest of each leader and the others within reach of a link, all of them where
    the leader is not dense."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine", "near").union(pairs.select("b", "a", "cosine", "near"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")))
    return ranked.where((F.col("rank") <= neighbours) | (F.col("near") & (F.col("rank") <= DENSE + neighbours)))


def _refined(pairs: DataFrame, leaders: DataFrame, angle: float, neighbours: int) -> DataFrame:
    """``pairs`` and what the neighbours of neighbours add: every leader's list, and those that list it, meet once."""
    lists = store(_lists(pairs, neighbours), "nn-lists")
    kth = lists.where(F.col("rank") == neighbours).select(F.col("src").alias("lid"), F.col("cosine").alias("kth"))
    back = lists.withColumn("back", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("cosine"), "src")))
    back = back.where(F.col("back") <= neighbours).select(F.col("dst").alias("mid"), F.col("src").alias("lid"))
    hood = lists.select(F.col("src").alias("mid"), F.col("dst").alias("lid")).union(back).union(lists.select(F.col("src").alias("mid"), F.col("src").alias("lid"))).distinct()
    dense = lists.groupBy(F.col("src").alias("mid")).agg(F.count_if("near").alias("n")).where(F.col("n") >= DENSE).select("mid")
    hood = hood.join(dense, "mid", "left_anti")  # so no neighbourhood is larger than a list and its K listers
    known = leaders.join(kth, "lid", "left").select("lid", "r", F.coalesce("kth", F.lit(-1.5)).alias("kth"), "v")
    met = hood.join(known, "lid").select("mid", "lid", "r", "kth", "v")

    def kernel(batches):
        for _, lid, r, least, v in _runs(batches, 1, None):
            yield _pairs(np.array(lid), np.array(r), v, angle, neighbours, np.array(least))

    found = met.repartition("mid").sortWithinPartitions("mid", "lid").mapInArrow(kernel, PAIR_DDL)
    kept = lists.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "cosine", "near")
    return store(_merged(kept.union(found)), "nn-pairs")


def dense_regions(pairs: DataFrame) -> DataFrame | None:
    """(lid, region, core): the dense leaders by connected region, and the leaders within reach of one of them (not core; of
    each such region); None where no leader is dense."""
    near = pairs.where("near").select("a", "b")
    both = near.selectExpr("a as lid", "b as other").union(near.selectExpr("b as lid", "a as other"))
    dense = store(both.groupBy("lid").agg(F.count("*").alias("n")).where(F.col("n") >= DENSE).select("lid"), "nn-dense")
    if dense.isEmpty():
        return None
    inner = near.join(dense.withColumnRenamed("lid", "a"), "a", "left_semi").join(dense.withColumnRenamed("lid", "b"), "b", "left_semi")
    root = connected_components(inner, "a", "b").selectExpr("node as lid", "root as region")
    core = store(dense.join(root, "lid", "left").select("lid", F.coalesce("region", "lid").alias("region")), "nn-core")
    border = both.join(core, "lid").select(F.col("other").alias("lid"), "region").join(dense, "lid", "left_anti").distinct()
    return store(core.withColumn("core", F.lit(True)).union(border.select("lid", "region", F.lit(False))), "nn-regions")


def _covered(found: DataFrame, regions: DataFrame | None) -> DataFrame:
    """``found`` with ``tiled``: true for the pairs that the tiles of a dense region compare."""
    if regions is None:
        return found.withColumn("tiled", F.lit(False))
    core = regions.where("core").select("lid", "region")
    inside = regions.select("lid", "region").withColumn("there", F.lit(True))
    for x, y in (("a", "b"), ("b", "a")):
        found = found.join(core.select(F.col("lid").alias(x), F.col("region").alias(f"{x}_core")), x, "left")
        found = found.join(inside.select(F.col("lid").alias(y), F.col("region").alias(f"{x}_core"), F.col("there").alias(f"{x}_there")), [y, f"{x}_core"], "left")
    return found.withColumn("tiled", F.coalesce("a_there", F.lit(False)) | F.coalesce("b_there", F.lit(False))).drop("a_core", "b_core", "a_there", "b_there")


def _tiled(regions: DataFrame, leaders: DataFrame, member: DataFrame, usable: DataFrame, min_cosine: float, angle: float) -> DataFrame:
    """The links of dense leaders: (uid, ball, other, n, kind); kind 0: links of a member in other balls; 1: links of each member of
    ball ``uid``; 2: a link (ball, other) of a spanning forest; 3: balls of which only some members may be linked.

    Members of small balls are compared with each other (kind of row 0); a large ball (2) is compared as a whole with large
    ones and with the leaders of small ones (1)."""
    sized = regions.join(leaders.select("lid", "r", "size", "v"), "lid")
    small = F.col("size") <= DENSE
    whole = sized.select("region", "core", F.col("lid").alias("ball"), F.col("lid").alias("uid"), "r", "size", "v", F.when(small, 1).otherwise(2).alias("what"))
    single = sized.where(small).select("region", "core", F.col("lid").alias("ball")).join(member.select("uid", "ball"), "ball").join(usable.select("uid", "v"), "uid")
    points = whole.unionByName(single.select("region", "core", "ball", "uid", F.lit(0.0).alias("r"), F.lit(1).cast("long").alias("size"), "v", F.lit(0).alias("what")))
    points = store(points, "nn-points")
    tiles = points.groupBy("region").agg(F.ceil(F.count_if("core") / F.lit(TILE)).cast("int").alias("ct"), F.ceil(F.count_if(~F.col("core")) / F.lit(TILE)).cast("int").alias("bt"))
    points = points.join(tiles, "region").withColumn("h", F.xxhash64("uid", "what"))
    points = points.withColumn("tile", F.when(F.col("core"), F.pmod("h", "ct")).otherwise(F.col("ct") + F.pmod("h", "bt")).cast("int"))
    # a core tile meets every tile of its region once, a tile beyond the core every core tile
    partner = F.when(F.col("core"), F.sequence(F.lit(0), F.col("ct") + F.col("bt") - 1)).otherwise(F.sequence(F.lit(0), F.col("ct") - 1))
    met = points.withColumn("partner", F.explode(partner))
    met = met.select("region", F.least("tile", "partner").cast("int").alias("i"), F.greatest("tile", "partner").cast("int").alias("j"), "tile", "ball", "uid", "r", "size", "what", "v")

    def kernel(table: pa.Table) -> pa.Table:
        tile, ball, uid, r, size, what = (table[c].to_numpy() for c in ("tile", "ball", "uid", "r", "size", "what"))
        x = _unit(table["v"].to_pylist())
        low, high = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        cosine = x[left] @ x[right].T
        sort = what[left][:, None] * 3 + what[right][None, :]
        fresh = ball[left][:, None] != ball[right][None, :]
        if low == high:
            fresh &= uid[left][:, None] < uid[right][None, :]
        level = fresh & np.isin(sort, (5, 7, 8))  # a large ball with a leader of a small one, or with a large one
        gap, reach = _degrees(cosine), r[left][:, None] + r[right][None, :]
        full = level & (gap + reach <= angle - SLACK)
        linked = fresh & (sort == 0) & (cosine >= min_cosine) | full
        some = level & ~full & (gap <= angle + reach + SLACK)
        n = np.zeros(len(uid), dtype=np.int64)
        np.add.at(n, left, linked @ size[right])
        np.add.at(n, right, linked.T @ size[left])
        at = np.flatnonzero(n)
        i, j = np.nonzero(linked)
        nodes, root = local_components(ball[left][i], ball[right][j]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        tree = nodes != root
        i, j = np.nonzero(some)
        a, b = np.minimum(ball[left][i], ball[right][j]), np.maximum(ball[left][i], ball[right][j])
        none = lambda k: np.full(k, -1, dtype=np.int64)
        t, o = int(tree.sum()), len(i)
        return pa.table({
            "uid": np.concatenate([uid[at], none(t + o)]), "ball": np.concatenate([ball[at], nodes[tree], a]), "other": np.concatenate([none(len(at)), root[tree], b]),
            "n": np.concatenate([n[at], none(t + o)]), "kind": np.concatenate([(what[at] > 0).astype(np.int64), np.full(t, 2), np.full(o, 3)])})

    return store(met.groupBy("region", "i", "j").applyInArrow(kernel, "uid long, ball long, other long, n long, kind long"), "nn-tiled")


def _reachable(leaders: DataFrame, sample: list, angle: float) -> DataFrame:
    """(linked, a, b, cosine, near): every pair of a query leader and a leader within its reach, once for each query."""

    def kernel(batches):
        by_dim = {}
        for s in sample:
            by_dim.setdefault(s["dim"], []).append(s)
        by_dim = {d: (np.array([s["lid"] for s in x]), np.array([s["r"] for s in x]), np.array([s["linked"] for s in x]), _unit([bytes(s["v"]) for s in x])) for d, x in by_dim.items()}
        for batch in batches:
            lids, dims, rs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw = batch.column(3).to_pylist()
            for dim, (q, qr, linked, qx) in by_dim.items():
                mine = np.flatnonzero(dims == dim)
                for at in np.array_split(mine, 1 + len(mine) // 512):
                    if not len(at):
                        continue
                    cosine = qx @ _unit([raw[i] for i in at]).T
                    widest = min(180.0, angle + qr.max() + rs[at].max() + SLACK)
                    i, j = np.nonzero(cosine >= np.cos(np.radians(widest)))
                    c = cosine[i, j]
                    ok = (_degrees(c) <= angle + qr[i] + rs[at][j]) & (q[i] != lids[at][j])
                    i, j, c = i[ok], j[ok], c[ok]
                    a, b = q[i], lids[at][j]
                    yield pa.RecordBatch.from_arrays([pa.array(linked[i]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c), pa.array(np.ones(len(i), dtype=bool))], names=["linked", "a", "b", "cosine", "near"])

    return store(leaders.select("lid", "dim", "r", "v").mapInArrow(kernel, "linked boolean, " + PAIR_DDL), "nn-audit")


def audit_recall(pairs: DataFrame, leaders: DataFrame, angle: float, turn: int = 0, regions: DataFrame | None = None) -> tuple[float, bool, DataFrame | None]:
    """Estimated share of all reachable pairs that the pair table holds or a dense region's tiles compare; whether every
    leader was asked; the pairs seen outside tiles.

    Leaders with and without links found are drawn apart and weighted by their numbers. Blocks of queries grow until
    AUDIT_PAIRS reachable pairs have been seen, or there is no leader left to ask: where links are very rare, this is
    the comparison of all leaders with all.
    """
    near = pairs.where("near")
    linked = near.select(F.col("a").alias("lid")).union(near.select("b")).distinct().withColumn("linked", F.lit(True))
    place = F.pmod(F.xxhash64("lid", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
    drawn = store(leaders.join(linked, "lid", "left").select("lid", "dim", "r", "v", F.coalesce("linked", F.lit(False)).alias("linked"), place.alias("place")), "nn-audited")
    size = {r["linked"]: r["count"] for r in drawn.groupBy("linked").count().collect()}
    asked, seen, held, at = ({k: 0 for k in size} for _ in range(4))
    block, truth = AUDIT_QUERIES // 2, None
    while any(at[k] < 1 for k in size) and sum(seen.values()) < AUDIT_PAIRS:
        upto = {k: min(1.0, at[k] + block / n) for k, n in size.items()}
        chosen = F.lit(False)
        for k in size:
            chosen = chosen | ((F.col("linked") == k) & (F.col("place") >= at[k]) & (F.col("place") < upto[k]))
        sample = drawn.where(chosen).select("lid", "dim", "r", "v", "linked").collect()  # about 2 * AUDIT_BLOCK rows at most
        for s in sample:
            asked[s["linked"]] += 1
        found = _reachable(leaders, sample, angle)
        found = _covered(found, regions)
        found = found if regions is None else store(found, "nn-covered")
        known = found.join(pairs.select("a", "b", F.lit(1).alias("known")), ["a", "b"], "left").withColumn("known", F.when(F.col("tiled"), 1).otherwise(F.col("known")))
        for r in known.groupBy("linked").agg(F.count("*").alias("n"), F.count("known").alias("known")).collect():
            seen[r["linked"]] += r["n"]
            held[r["linked"]] += r["known"]
        found = found.where(~F.col("tiled")).select("a", "b", "cosine", "near")
        truth = found if truth is None else truth.union(found)
        at, block = upto, min(4 * block, AUDIT_BLOCK)
    weight = {k: size[k] / max(1, asked[k]) for k in size}
    there = sum(weight[k] * seen[k] for k in size)
    share = sum(weight[k] * held[k] for k in size) / there if there else 1.0
    return share, all(at[k] >= 1 for k in size), truth


def nn_descent(leaders: DataFrame, angle: float, neighbours: int = NEIGHBOURS, orders: int = ORDERS, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, cosine, near) of leaders (lid, dim, r, v), and the dense regions, whose pairs are not among them; the
    audited share of reachable pairs meets the goal."""
    pairs = store(_merged(_windows(leaders, angle, neighbours, orders, 11)), "nn-pairs")
    for attempt in range(ATTEMPTS):
        reached = pairs.where("near").count()
        for _ in range(max_rounds):
            pairs = _refined(pairs, leaders, angle, neighbours)
            now = pairs.where("near").count()
            if now <= reached * 1.001:
                break
            reached = now
        regions = dense_regions(pairs)
        share, whole, truth = audit_recall(pairs, leaders, angle, attempt, regions)
        if share < 1:
            pairs = store(_merged(pairs.union(truth)), "nn-pairs")
        if whole or share >= AUDIT_GOAL:
            return pairs, dense_regions(pairs) if share < 1 else regions
        more = _windows(leaders, angle, neighbours, 2 * orders, 100 + attempt)
        pairs = store(_merged(pairs.union(more)), "nn-pairs")
    raise RuntimeError(f"{share:.4f} of the reachable pairs found after {ATTEMPTS} searches, {AUDIT_GOAL} needed")


def _compared(partial: DataFrame, members: DataFrame, min_cosine: float, tile: int = 1024) -> DataFrame:
    """(uid, other_ball, n): links of each member into a ball of which only some members may be linked to it."""
    sized = members.join(members.groupBy("ball").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "ball")
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    tiles = sized.select("ball", "tiles").distinct()
    edge = partial.select("a", "b").join(tiles.selectExpr("ball as a", "tiles as at"), "a").join(tiles.selectExpr("ball as b", "tiles as bt"), "b")
    left = edge.join(sized.selectExpr("ball as a", "tile as ta", "uid", "v"), "a").withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("bt") - 1)))
    right = edge.join(sized.selectExpr("ball as b", "tile as tb", "uid", "v"), "b").withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("at") - 1)))
    cols = ["a", "b", "ta", "tb", "side", "uid", "v"]
    both = left.withColumn("side", F.lit(0)).select(*cols).union(right.withColumn("side", F.lit(1)).select(*cols))

    def count(table: pa.Table) -> pa.Table:
        side, uid, raw = table["side"].to_numpy(), table["uid"].to_numpy(), table["v"].to_pylist()
        x = _unit(raw)
        linked = x[side == 0] @ x[side == 1].T >= min_cosine
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        n = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)]).astype(np.int64)
        ids = np.concatenate([uid[side == 0], uid[side == 1]])
        ball = np.concatenate([np.full((side == 0).sum(), a), np.full((side == 1).sum(), b)])
        other = np.concatenate([np.full((side == 0).sum(), b), np.full((side == 1).sum(), a)])
        return pa.table({"uid": ids[n > 0], "ball": ball[n > 0], "other": other[n > 0], "n": n[n > 0]})

    return both.groupBy("a", "b", "ta", "tb").applyInArrow(count, "uid long, ball long, other long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
                    neighbours: int = NEIGHBOURS, orders: int = ORDERS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different dimension; such a vector is a component of its own. Repeated rows are vectors of their own that link with
    each other. component_id is the smallest non-null id of the component. An empty table gives no rows; other columns
    are neither read nor returned.
    """
    angle = float(np.degrees(np.arccos(min_cosine)))
    widest = angle / 2 - 2 * SLACK
    vectors = store(_vectors(df, id_col, vector_col).withColumn("uid", F.monotonically_increasing_id()), "nn-vectors")
    usable = vectors.where("v is not null")

    # balls: slices of the rows as they lie, then slices of two random orders
    member = store(_fold(usable.select("dim", F.col("uid").alias("lid"), F.lit(0.0).alias("r"), "v"), min(BALL_DEGREES, widest), widest)
                   .select(F.col("lid").alias("uid"), F.col("leader").alias("ball"), F.col("gap").alias("reach")), "nn-members")
    for seed in (1, 2):
        radius = member.groupBy("ball").agg(F.max("reach").alias("r"))
        balls = usable.join(radius, usable["uid"] == radius["ball"]).select(F.col("uid").alias("lid"), "dim", "r", "v")
        folded = _fold(_in_order(balls, 1, seed).select("dim", "lid", "r", "v"), min(BALL_DEGREES, widest), widest)
        folded = store(folded.select(F.col("lid").alias("ball"), "leader", "gap"), "nn-folded")
        member = store(member.join(folded, "ball").select("uid", F.col("leader").alias("ball"), (F.col("reach") + F.col("gap")).alias("reach")), "nn-members")
    shape = member.groupBy("ball").agg(F.max("reach").alias("r"), F.count("*").alias("size"))
    leaders = store(usable.join(shape, usable["uid"] == shape["ball"]).select(F.col("uid").alias("lid"), "dim", "r", "size", "v"), "nn-leaders")

    pairs, regions = nn_descent(leaders, angle, neighbours, orders)
    pairs = pairs.where("near").select("a", "b", "cosine")
    tiled = None
    if regions is not None:
        core = regions.where("core").select("lid")
        pairs = pairs.join(core.withColumnRenamed("lid", "a"), "a", "left_anti").join(core.withColumnRenamed("lid", "b"), "b", "left_anti")
        tiled = _tiled(regions, leaders, member, usable, min_cosine, angle)
    side = leaders.select("lid", "r", "size")
    pairs = pairs.join(side.selectExpr("lid as a", "r as ra", "size as sa"), "a").join(side.selectExpr("lid as b", "r as rb", "size as sb"), "b")
    degrees = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))))
    single = (F.col("ra") == 0) & (F.col("rb") == 0) & (F.col("sa") == 1) & (F.col("sb") == 1)
    whole = F.when(single, F.col("cosine") >= min_cosine).otherwise(degrees + F.col("ra") + F.col("rb") <= angle - SLACK)
    pairs = store(pairs.withColumn("whole", whole).withColumn("open", ~whole & ~single), "nn-ball-pairs")

    members = member.join(usable.select("uid", "v"), "uid").select("uid", "ball", "v")
    partly = pairs.where("open").select("a", "b")
    if tiled is not None:
        partly = partly.union(tiled.where("kind = 3").select(F.col("ball").alias("a"), F.col("other").alias("b")).distinct())
    some = store(_compared(partly, members, min_cosine), "nn-compared")
    full = pairs.where("whole")
    by_ball = full.selectExpr("a as ball", "sb as n").union(full.selectExpr("b as ball", "sa as n")).union(leaders.selectExpr("lid as ball", "size - 1 as n"))
    if tiled is not None:
        by_ball = by_ball.union(tiled.where("kind = 1").select("ball", "n"))
    by_ball = store(by_ball.groupBy("ball").agg(F.sum("n").alias("n")), "nn-by-ball")
    by_member = some.select("uid", "n")
    if tiled is not None:
        by_member = by_member.union(tiled.where("kind = 0").select("uid", "n"))
    by_member = by_member.groupBy("uid").agg(F.sum("n").alias("extra"))
    links = full.select("a", "b").union(some.select(F.col("ball").alias("a"), F.col("other").alias("b")))
    if tiled is not None:
        links = links.union(tiled.where("kind = 2").select(F.col("ball").alias("a"), F.col("other").alias("b")))
    links = links.distinct()
    root = connected_components(links, "a", "b").withColumnRenamed("node", "ball")

    placed = vectors.select("uid", "vec_id").join(member.select("uid", "ball"), "uid", "left")
    placed = placed.join(by_ball, "ball", "left").join(root, "ball", "left").join(by_member, "uid", "left")
    placed = store(placed.select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("root", "ball", -F.col("uid") - 1).alias("root")), "nn-placed")
    named = store(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")), "nn-names")
    return placed.join(named, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
