"""Search operators: dedupe fold, cover density, normalisation, score, against hand-computed fixtures."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import fulltext as FT
from shelfspark.operators import hybrid as HY
from shelfspark.operators import ranking as RK


def test_greedy_dedupe_golden(spark):
    rows = [(1, 1, "a", "b", "https://x/1"), (1, 2, "a", "b", "https://x/2"), (1, 3, "c", "b", "https://x/2"),
            (1, 4, "d", "b", "https://x/1")]
    df = spark.createDataFrame(rows, "query_id int, rank int, name string, brand string, url string")
    kept = sorted(r["rank"] for r in RK.greedy_dedupe(df).collect())
    # name dup drops 2; url dup (of kept 1) drops 4; 3 shares a url only with dropped 2 -> kept
    assert kept == [1, 3]


def test_greedy_dedupe_properties(spark):
    rows = [(1, i, f"n{i % 5}", "b", f"https://x/{i % 7}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "query_id int, rank int, name string, brand string, url string")
    out = RK.greedy_dedupe(df).collect()
    names = [r["name"] for r in out]
    urls = [r["url"] for r in out]
    assert len(set(names)) == len(names) and len(set(urls)) == len(urls)
    again = RK.greedy_dedupe(df.unionByName(df.withColumn("rank", F.col("rank") + 1000))).collect()
    assert sorted(r["rank"] for r in again) == sorted(r["rank"] for r in out)


def _rank(spark, doc, query):
    docs = spark.createDataFrame([(1, doc)], "id int, text string")
    qs = spark.createDataFrame([(7, query)], "query_id int, q string")
    dt = FT.analyze(docs, ["id"], F.col("text"))
    qt = FT.query_terms(qs, F.col("q"))
    occ = FT.matched_occurrences(dt, qt)
    rows = FT.match_and_rank(occ).collect()
    return rows[0]["text_rank"] if rows else None


def test_cover_density_fixtures(spark):
    w = FT.COVER_WEIGHT
    # one adjacent cover
    assert _rank(spark, "red widget", "red widget") == pytest.approx(w, rel=1e-6)
    # covers: (1,2) adjacent, then (2,4) with one noise word -> w + w/2
    assert _rank(spark, "red widget x red", "red widget") == pytest.approx(w + w / 2, rel=1e-6)
    # single-term query: one cover per occurrence
    assert _rank(spark, "a b a c a", "a") == pytest.approx(3 * w, rel=1e-6)
    # not all terms present -> no match
    assert _rank(spark, "red only", "red widget") is None


def test_minmax_constant(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2), (1, 0.5, 0.2)], "query_id int, v double, t double")
    out = HY.minmax_norm(HY.minmax_norm(df, "v", "vn", 1.0), "t", "tn", 0.0).collect()
    assert all(r["vn"] == 1.0 and r["tn"] == 0.0 for r in out)


def test_hybrid_score_golden(spark):
    df = spark.createDataFrame([(1.0, 0.0, True, 10, 4.5), (0.0, 0.0, False, 10, 3.0), (0.0, 0.0, False, 9, 3.0)],
                               "vector_similarity_norm double, text_rank_norm double, made_in_canada boolean, "
                               "num_reviews int, average_rating double")
    got = [r[0] for r in df.select(HY.hybrid_score()).collect()]
    assert got == pytest.approx([0.6, -0.2, 0.0])


def test_flagship_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert "hybrid_score" in df.columns
    assert df.count() > 0


def test_zero_vector_is_skipped_not_an_error(spark):
    from shelfspark.operators import vector as V

    prods = spark.createDataFrame(
        [(1, "u1", [0.0, 0.0], 1.0, 4.0, "b", True), (2, "u2", [1.0, 0.0], 1.0, 4.0, "b", True)],
        "id long, url string, embedding array<float>, price_num double, average_rating double, brand_lc string, "
        "made_in_canada boolean")
    qs = spark.createDataFrame([(7, [1.0, 1.0], None, None, None, None, False)],
                               "query_id long, query_vector array<float>, q_min_price double, q_max_price double, "
                               "q_min_rating double, q_brand string, q_origin boolean")
    blocked = [(r["id"], r["vector_similarity"]) for r in V.vector_topk(prods, qs, 5, tile_bytes=1).collect()]
    pairs = [(r["id"], r["vector_similarity"]) for r in V.vector_topk(prods, qs, 5).collect()]
    assert blocked == pairs == [(2, pytest.approx(0.707107))]
