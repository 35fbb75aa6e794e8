"""Tiles, ties, filters and the list index against numpy."""

import numpy as np
import pytest

from conftest import SF001

from shelfspark.operators import vector as V

PRODUCTS = "id long, url string, embedding array<float>, price_num double, average_rating double, brand_lc string, made_in_canada boolean"
QUERIES = "query_id long, query_vector array<float>, q_min_price double, q_max_price double, q_min_rating double, q_brand string, q_origin boolean"


def exact(products, queries, k):
    """Brute force: (query_id, rank, id, similarity)."""
    out = []
    for qid, vec, low, high, least, brand, origin in queries:
        if vec is None:
            continue
        q, found = np.array(vec, dtype=float), []
        for i, url, x, price, rating, name, made in products:
            if x is None or len(x) != len(q) or any(v is None for v in x):
                continue
            if origin and not made or low is not None and not (price is not None and price >= low) or high is not None and not (price is not None and price <= high):
                continue
            if least is not None and not (rating is not None and rating >= least) or brand is not None and not (name is not None and brand in name):
                continue
            x = np.array(x, dtype=float)
            with np.errstate(all="ignore"):
                s = np.floor(x @ q / (np.sqrt(x @ x) * np.sqrt(q @ q)) * 1e6 + 0.5) / 1e6
            if np.isfinite(s):
                found.append((-s, url, i))
        out += [(qid, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.id, r.vector_similarity) for r in df.collect())


def clustered(n, centers=24, dim=16, width=0.15, seed=2):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, dim))
    which = r.integers(0, centers, n)
    which[: n // 3] = 0  # one group holds a third
    return (c[which] + width * r.normal(size=(n, dim))).astype(np.float32), c


def tables(spark, vectors, queries):
    r = np.random.default_rng(4)
    rows = [(i, f"u{i:05d}", v.tolist(), float(r.integers(1, 50)), float(r.integers(1, 6)), str(r.choice(["acme co", "zeta", "é a"])), bool(r.random() < 0.5)) for i, v in enumerate(vectors)]
    rows += [(9001, "a-null", None, 1.0, 1.0, "zeta", True), (9002, "a-zero", [0.0] * vectors.shape[1], 1.0, 1.0, None, None),
             (9003, "a-short", [1.0], None, None, None, None), (9004, "a-hole", [None] * vectors.shape[1], None, None, None, True)]
    rows += [(9100 + i, f"same{i:03d}", vectors[0].tolist(), None, None, None, None) for i in range(300)]  # ties beyond k
    asked = [(j, q.tolist(), *f) for j, (q, f) in enumerate(zip(queries, [(None,) * 4 + (False,), (10.0, None, None, None, False), (None, 20.0, 3.0, "cme", False), (None, None, None, None, True)] * len(queries)))]
    asked += [(900, None, None, None, None, None, False), (901, [0.0] * vectors.shape[1], None, None, None, None, False), (902, vectors[0].tolist(), 1e9, None, None, None, False)]
    return rows, asked, spark.createDataFrame(rows, PRODUCTS).repartition(5), spark.createDataFrame(asked, QUERIES)


def test_scan_and_index_are_exact(spark):
    vectors, _ = clustered(1200)
    rows, asked, p, q = tables(spark, vectors, vectors[::90])
    want = exact(rows, asked, 20)
    assert got(V.vector_topk(p, q, 20)) == want
    assert got(V.vector_topk(p, q, 20, tile_bytes=600)) == want
    index = V.build_vector_index(p, lists=30, fit_rows=700)
    read = []
    assert got(V.vector_topk_indexed(index, q, 20, read=read)) == want
    assert got(V.vector_topk_indexed(index, q, 20, tile_bytes=600, probes=1)) == want
    counts = {r.query_id: r.n_candidates for r in V.candidate_counts(p, q).collect()}
    assert counts[0] == sum(r[2] is not None for r in rows) and counts[3] == sum(bool(r[6]) and r[2] is not None for r in rows) and 902 not in counts


def test_clustered_data_reads_few_lists(spark):
    vectors, _ = clustered(4000, width=0.05)
    plain = [(j, vectors[j].tolist(), None, None, None, None, False) for j in range(0, 4000, 100)]
    _, _, p, _ = tables(spark, vectors, vectors[:1])
    p, q = p.where("id < 9000"), spark.createDataFrame(plain, QUERIES)
    index = V.build_vector_index(p, lists=48)
    read = []
    found = V.vector_topk_indexed(index, q, 10, recall=1.0, read=read)
    assert got(found) == got(V.vector_topk(p, q, 10))
    assert read[0][0] < 0.5 * read[0][1]  # exact, yet most lists were not visited
    plan = index.rows.where("list_id in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall_asked_for_is_reached(spark, kind):
    if kind == "clustered":
        vectors, _ = clustered(5000, centers=60, width=0.6)
    else:
        vectors = np.random.default_rng(1).normal(size=(5000, 24)).astype(np.float32)
    plain = [(j, (vectors[j] + 0.2).tolist(), None, None, None, None, False) for j in range(0, 5000, 50)]
    _, _, p, _ = tables(spark, vectors, vectors[:1])
    p, q = p.where("id < 9000"), spark.createDataFrame(plain, QUERIES)
    index, read = V.build_vector_index(p), []
    approx = V.vector_topk_indexed(index, q, 10, recall=0.9, read=read)
    recall = [r.recall for r in V.recall_at_k(approx, V.vector_topk(p, q, 10)).collect()]
    assert np.mean(recall) >= 0.9 and len(recall) == 100
    assert read[0][0] < 0.9 * read[0][1]


def test_recall_on_the_catalogue(spark):
    from shelfspark.plans import search

    recall = [r.recall for r in search.h02(spark, SF001).collect()]
    assert np.mean(recall) >= 0.9


def test_empty(spark):
    p, q = spark.createDataFrame([], PRODUCTS), spark.createDataFrame([(1, [1.0], None, None, None, None, False)], QUERIES)
    index = V.build_vector_index(p)
    assert V.vector_topk(p, q).count() == 0 and V.vector_topk_indexed(index, q).count() == 0
    assert V.vector_topk(p, q.limit(0)).count() == 0
