"""Golden cases of links, markup, ratings, upserts, streams and search that the rendered fixtures cannot show."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators import extract as X
from shelfspark.operators import hybrid as HY
from shelfspark.operators import jsonld as J
from shelfspark.operators import vector as V
from shelfspark.streaming.events import ChangeLogUpsert


def test_links_in_all_forms(spark):
    html = ('<a href="/p?x=1&amp;y=2">a</a><A class=c HREF=\'/q\'>b</A><a href=/u>c</a><a data-href="/no" href="../z">d</a>'
            '<a href="./s/../t/.">e</a><a href="../../../top">f</a><a name="x">g</a><link href="/css"><a\nhref="//cdn.x/y">h</a>')
    got = [r["href"] for r in X.page_links(spark.createDataFrame([("https://h.com/a/b/c?q=1", html)], "url string, html string")).orderBy("pos").collect()]
    assert got == ["https://h.com/p?x=1&y=2", "https://h.com/q", "https://h.com/u", "https://h.com/a/z",
                   "https://h.com/a/b/t/", "https://h.com/top", "https://cdn.x/y"]


def test_content_block_holds_nested_elements(spark):
    filler = "word " * 30
    pages = [("a", f'<div class="x entry-content"><div>one</div><p>SECOND {filler}</p></div><p>after</p>'),
             ("b", f"<body><p>short</p><article><div>{filler}</div><div>tail</div></article>end</body>"),
             ("c", '<p>only &amp; this</p><script>var a="<p>no</p>"</script>'), ("d", None)]
    got = {r["url"]: r["content_text"] for r in X.content_block(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["a"].split("\n") == ["one", f"SECOND {filler}".strip()]
    assert got["b"].split("\n") == [filler.strip(), "tail"]
    assert got["c"] == "only & this" and got["d"] is None


def test_jsonld_quotes_repeated_keys_nesting_and_ratings(spark):
    html = ("<script type='application/ld+json'>{\"@type\":[\"Thing\",\"Product\"],\"name\":\"A\",\"name\":\"B\",\"brand\":\"X\",\"image\":[\"1\",2,\"3\"],"
            "\"isRelatedTo\":{\"@type\":\"product\",\"name\":\"C\",\"offers\":{\"price\":9.5,\"priceCurrency\":\"CAD\"},\"brand\":{\"name\":\"Y\"}}}</script>"
            '<script type="application/ld+json">{"@graph":[{"n":1},{"mainEntity":[{"aggregateRating":{"ratingValue":"4.5","ratingCount":"12"}}]}],}</script>'
            "<script type=application/ld+json>{broken</script>")
    blocks = J.jsonld_blocks(spark.createDataFrame([("u", html)], "url string, html string"))
    assert [r["block_pos"] for r in blocks.orderBy("block_pos").collect()] == [1, 2]
    rows = J.jsonld_products(blocks).orderBy("pos").collect()
    assert [(r["name"], r["brand"], r["images"], r["price"], r["currency"], r["score"]) for r in rows] == [
        ("B", "X", ["1", "3"], None, None, 3), ("C", "Y", [], "9.5", "CAD", 4)]
    assert J.best_schema(J.jsonld_products(blocks)).first()["name"] == "C"
    assert tuple(J.jsonld_aggregate_rating(blocks).first()) == ("u", 4.5, 12)


def test_manifest_keeps_all_images_and_long_names_apart(spark):
    url = "https://h.com/" + "p" * 300
    df = spark.createDataFrame([(url, [f"i{k}.png" for k in range(20)])], "url string, images array<string>")
    names = [r["file_name"] for r in J.image_manifest(df).collect()]
    assert len(names) == 20 == len(set(names)) and max(map(len, names)) <= 180


def test_store_types_and_new_per_category(spark):
    links = spark.createDataFrame([("https://s/c1", 1, "https://s/products/a?v=1"), ("https://s/c1", 2, "https://s/x-12.html"),
                                   ("https://s/c2", 1, "https://s/products/a"), ("https://s/c2", 2, "https://s/products/b"), ("https://s/c3", 1, "https://s/products/b")],
                                  "url string, pos int, href string")
    p = X.store_product_links(links, "shopify")
    assert sorted(map(tuple, p.collect())) == [("https://s/products/a", "https://s/c1"), ("https://s/products/b", "https://s/c2")]
    assert sorted(map(tuple, X.new_per_category(links, p).collect())) == [("https://s/c1", 1), ("https://s/c2", 1), ("https://s/c3", 0)]
    assert [r[0] for r in X.store_product_links(links, "roots").collect()] == ["https://s/x-12.html"]
    assert X.store_product_links(links, "generic").count() == 3


def test_closure_is_complete_by_default(spark):
    roots = spark.createDataFrame([("https://s", 1, "https://s/m0")], "base string, ord int, sitemap_url string")
    docs = [(f"https://s/m{i}", "nested", 0, f"https://s/m{i + 1}") for i in range(6)] + [(f"https://s/m{i}", "url", 1, f"https://s/p/{i}") for i in range(7)]
    docs = spark.createDataFrame(docs + [("https://s/m3", "nested", 2, "https://s/m0")], "url string, kind string, pos int, loc string")
    assert X.sitemap_closure(roots, docs).count() == 7
    assert X.sitemap_closure(roots, docs, max_docs=3).count() == 3


def test_upsert_keeps_stored_nulls_and_whole_rows(spark):
    schema = "url string, name string, note string, source_site string"
    old = spark.createDataFrame([("u1", "a", "n", None)], schema)
    new = spark.createDataFrame([("u1", "b", None, "new", 1), ("u2", "c", "x", "first", 1), ("u2", "d", None, "later", 2), ("u3", "p", None, "s", 5), ("u3", "q", None, "s", 5)],
                                schema + ", seq long")
    got = sorted(map(tuple, C.upsert_by_key(old, new, seq="seq", preserve=["source_site"]).collect()))
    assert got == [("u1", "b", None, None), ("u2", "d", None, "first"), ("u3", "q", None, "s")]


def test_change_log_restart_and_large_sequences(spark, tmp_path):
    old = spark.createDataFrame([("u1", "a", 0)], "url string, name string, ts long")
    base = str(tmp_path / "t")
    sink = ChangeLogUpsert(spark, base, old, seq_col="ts")
    micros = 1_700_000_000_000_000
    sink(spark.createDataFrame([("u1", "early", micros + 5)], old.schema), 0)
    sink(spark.createDataFrame([("u1", "late", micros)], old.schema), 1)  # a later epoch wins whatever its sequence
    again = ChangeLogUpsert(spark, base, old, seq_col="ts")  # a restart
    assert [r["name"] for r in again.table().collect()] == ["late"]
    again.compact()
    assert [r["name"] for r in ChangeLogUpsert(spark, base).table().collect()] == ["late"]


PRODUCTS = "id long, url string, name string, brand string, description string, price string, currency string, source_site string, num_reviews int, average_rating double, made_in_canada boolean, made_in_canada_reason string, embedding array<float>"


def _catalogue(spark):
    rows = [(1, "https://s/1", "Warm Hoodie", "Roots", "a hoodie", "$50", "CAD", "s", 3, 4.5, True, None, [1.0, 0.0]),
            (2, "https://s/2", "Plain Shirt", "Kotn", "a shirt", "$20", "CAD", "s", 3, 4.0, False, None, [0.0, 1.0]),
            (3, "https://s/3", "Running hoodies", "Kotn", "two hoodies", "$60", "CAD", "s", 3, 4.0, None, None, None),
            (4, "https://s/4", "Odd", "Kotn", "x", "$60", "CAD", "s", 3, 4.0, None, None, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, PRODUCTS)


def test_english_is_the_default_and_products_without_vector_are_found_by_text(spark):
    queries = spark.createDataFrame([(7, "hoodies", [1.0, 0.0])], "query_id long, text string, query_vector array<float>")
    p = _catalogue(spark)
    english = {r["url"]: r["text_rank"] for r in HY.hybrid_search(p, queries).collect()}
    assert english["https://s/1"] > 0 and english["https://s/3"] > 0 and "https://s/4" not in english
    simple = {r["url"]: r["text_rank"] for r in HY.hybrid_search(p, queries, mode="simple").collect()}
    assert simple["https://s/1"] == 0 and simple["https://s/3"] > 0
    assert [r["id"] for r in V.dimension_rejects(p, 2).collect()] == [4]


def test_vector_topk_tiles_agree_and_do_not_shuffle_products(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, f"u{i}", rng.normal(size=8).tolist(), float(i % 50), 4.0, "b", bool(i % 2)) for i in range(500)]
    p = spark.createDataFrame(rows, "id long, url string, embedding array<float>, price_num double, average_rating double, brand_lc string, made_in_canada boolean")
    qs = [(j, rng.normal(size=8).tolist(), None, 30.0 if j % 2 else None, None, None, j % 3 == 0) for j in range(40)]
    q = spark.createDataFrame(qs, "query_id long, query_vector array<float>, q_min_price double, q_max_price double, q_min_rating double, q_brand string, q_origin boolean").checkpoint()
    one, many = V.vector_topk(p, q, 9), V.vector_topk(p, q, 9, tile_bytes=256)
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", "vector_similarity").collect())
    assert key(one) == key(many)
    x = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    for j, v, _, cap, _, _, origin in qs:
        s = x @ np.array(v, dtype=np.float32) / np.linalg.norm(x, axis=1) / np.linalg.norm(np.array(v, dtype=np.float32))
        ok = [i for i, r in enumerate(rows) if (cap is None or r[3] <= cap) and (not origin or r[6])]
        want = sorted(ok, key=lambda i: -s[i])[:9]
        assert [r[2] for r in key(one) if r[0] == j] == want
    plan = one._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below.split("Scan")[0]


def test_shared_folder_is_required_off_local():
    from types import SimpleNamespace

    from shelfspark.session import ensure_checkpoint_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://h:7077"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(fake)


def test_one_scan_for_all_flags(spark):
    from shelfspark.operators import runs as R

    df = spark.createDataFrame([(True, None), (False, True), (None, True)], "a boolean, b boolean")
    got = sorted(map(tuple, R.origin_stats(df, ["a", "b"]).select("flag", "yes", "no", "unknown", F.col("yes_pct")).collect()))
    assert got == [("a", 1, 1, 1, 33.3), ("b", 2, 0, 1, 66.7)]
