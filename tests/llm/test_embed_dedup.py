import numpy as np
import pytest

from shelfspark.llm import embed_dedup


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id) by all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for dim in {len(rows[k][1]) for k in good}:
        at = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T >= least
        np.fill_diagonal(s, False)
        for i, k in enumerate(at):
            links[k] = int(s[i].sum())
            for j in np.flatnonzero(s[i]):
                parent[find(at[j])] = find(k)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, links[k], low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, **options).collect()), key=str)


def test_hot_group_borders_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 24)))]
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    for i in range(200):  # one large group of near copies, with others at all distances round the limit
        rows.append((1000 + i, (centre + rng.normal(size=24) * 0.01).tolist()))
    for i in range(120):
        rows.append((2000 + i, (centre + rng.normal(size=24) * (0.05 + 0.001 * i)).tolist()))
    rows += [(3000 + i, rows[7][1]) for i in range(30)] + [(3100, [2 * x for x in rows[7][1]]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), found(df)
    assert sum(w == g for w, g in zip(want, got)) >= 0.99 * len(want)
    assert all(g[1] <= w[1] for w, g in zip(want, got))  # no link below the limit


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, v), (8, v), (8, v), (None, v), (9, [1.0, 2.0]),
            (10, [-x for x in v]), (11, [x * 1e300 for x in v]), (12, [x * 1e-300 for x in v])]
    df = spark.createDataFrame([(*r, "a", 2) for r in rows], "vec_id long, embedding array<double>, lid string, n int")
    assert found(df) == brute([(i, [x / 1e300 for x in e] if i == 11 else [x * 1e300 for x in e] if i == 12 else e) for i, e in rows])
    kept = {r.vec_id: r.kept for r in embed_dedup.near_duplicates(df).collect()}
    assert kept[1] and kept[7] and not kept[8] and not kept[11]
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_sf001_and_audit(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert found(df, min_cosine=0.45, neighbours=12) == brute(rows, 0.45)  # a limit at which these vectors do link


def test_rare_links_are_all_found(spark):
    """Forty links among 4,000 vectors: a fixed number of queries would hardly meet one."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(40, 32))
    side -= (side * x[:40]).sum(axis=1, keepdims=True) * x[:40]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[2000:2040] = np.cos(np.radians(24)) * x[:40] + np.sin(np.radians(24)) * side
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, orders=1, neighbours=2) == brute(rows)


def test_search_below_the_goal_raises(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "audit_recall", lambda pairs, *_: (0.9, False, pairs.limit(0)))
    monkeypatch.setattr(embed_dedup, "ATTEMPTS", 2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(50, 8)))]
    with pytest.raises(RuntimeError):
        found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def ring(rng, centre, n, degrees):
    """Vectors at an angle to the centre, in all directions."""
    x = rng.normal(size=(n, len(centre)))
    x -= (x @ centre)[:, None] * centre
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = np.radians(degrees)[:, None]
    return np.cos(a) * centre + np.sin(a) * x


@pytest.mark.parametrize("dense, tile", [(64, 1024), (12, 40)])
def test_wide_dense_groups_are_exact(spark, monkeypatch, dense, tile):
    """A group too wide to fold, one that is half folded, with large balls and a border; counts and components are exact."""
    monkeypatch.setattr(embed_dedup, "DENSE", dense)
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v)
    first, second = unit(rng.normal(size=24)), unit(rng.normal(size=24))
    rows = [*ring(rng, first, 500, np.full(500, 15.0)), *ring(rng, second, 300, rng.uniform(0, 22, 300)), *ring(rng, second, 60, rng.uniform(22, 40, 60)), *rng.normal(size=(200, 24))]
    for v in ring(rng, second, 3, np.array([5.0, 12.0, 18.0])):
        rows += [unit(v + rng.normal(size=24) * 0.004) for _ in range(90)]  # balls larger than DENSE
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k].tolist()) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert found(df) == brute(rows)


def test_lists_of_dense_leaders_are_bounded(spark):
    n = 400
    pairs = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "b")).where("id < b").selectExpr("id as a", "b", "0.95D as cosine", "true as near")
    assert embed_dedup._lists(pairs, 8).count() <= n * (embed_dedup.DENSE + 8)
    regions = embed_dedup.dense_regions(pairs)
    assert regions.where("core").count() == n and regions.select("region").distinct().count() == 1
