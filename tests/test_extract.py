"""Extraction operators on golden inputs."""

from pyspark.sql import functions as F

from shelfspark.operators import extract as X
from shelfspark.operators import jsonld as J
from shelfspark.operators import runs as R


def test_parse_verdict(spark):
    df = spark.createDataFrame([("ANSWER: YES\nREASON: x",), ("ANSWER: UNKNOWN\nREASON: x",)], "r string")
    ours = [(r[0], r[1]) for r in df.select(*X.parse_verdict(F.col("r")).values()).collect()]
    compat = [(r[0], r[1]) for r in df.select(*X.parse_verdict(F.col("r"), compat=True).values()).collect()]
    assert ours == [(True, "x"), (None, "x")]
    assert compat == [(True, "x"), (False, "x")]


def test_origin_rules(spark):
    locs = ["Toronto, ON", "London, UK", "Peiping, China", "Shenzhen, China", "Elsewhere", "Locally made"]
    df = spark.createDataFrame([(x,) for x in locs], "loc string")
    o = X.origin_from_location(F.col("loc"))
    rows = df.select(o["made_in_canada"], o["made_in_canada_reason"]).collect()
    assert [r[0] for r in rows] == [True, True, True, False, None, True]
    assert rows[0][1].endswith("Ontario")


def test_storefront(spark):
    df = spark.createDataFrame([("s", 200, '{"id":1}'), ("s", 200, "[]"), ("s", 404, None), ("s", None, None)],
                               "w string, s int, b string")
    d = X.storefront_detect(F.col("w"), F.col("s"), F.col("b"))
    assert [r[0] for r in df.select(d["is_shopify_store"]).collect()] == [True, False, None, None]


def test_jsonld_salvage_and_best(spark):
    html = ('<script type="application/ld+json">{"@type":"Product","name":"x",}</script>'
            '<script type="application/ld+json">[{"@type":"Product","name":"y","offers":{"price":3}},'
            '{"@type":["Thing","product"],"name":"z","offers":[{"price":"4"}],"image":["i",3]}]</script>')
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    blocks = J.jsonld_blocks(pages)
    assert blocks.count() == 2
    best = J.best_schema(J.jsonld_products(blocks)).first()
    assert best["name"] == "z" and best["price"] == "4" and best["images"] == ["i"]


def test_log_stats_and_block(spark):
    df = spark.createDataFrame([("Found 12 product URLs\n🖼️ Extracted 3 images\n🖼️ Extracted 4 images\nHTTP 403\nForbidden",)],
                               "t string")
    s = R.log_stats(F.col("t"))
    row = df.select(*[c.alias(k) for k, c in s.items()], R.blocked_flag(F.col("t")).alias("b")).first()
    assert row["products_found"] == 12 and row["images_extracted"] == 7 and row["b"] is True


def test_event_lines_drop_malformed(spark):
    lines = spark.createDataFrame([(1, 0, None, ": ping"), (1, 1, None, "data: {bad"), (1, 2, None, 'data: {"type":"done"}')],
                                  "run_id int, seq int, ts timestamp, line string")
    assert [r["type"] for r in R.event_lines(lines).collect()] == ["done"]


def test_sitemap_closure_cap_and_order(spark):
    roots = spark.createDataFrame([("https://a.com", 1, "https://a.com/r1.xml"), ("https://a.com", 2, "https://a.com/r2.xml")],
                                  "base string, ord int, sitemap_url string")
    docs = spark.createDataFrame([
        ("https://a.com/r1.xml", "nested", 0, "https://a.com/n1.xml"),
        ("https://a.com/r1.xml", "nested", 1, "https://a.com/r2.xml"),   # already queued: not re-added
        ("https://a.com/r2.xml", "url", 0, "https://a.com/p/2"),
        ("https://a.com/r2.xml", "url", 1, "https://b.com/p/x"),          # other host: dropped
        ("https://a.com/n1.xml", "nested", 0, "https://a.com/n2.xml"),
        ("https://a.com/n1.xml", "url", 0, "https://a.com/p/n1"),
        ("https://a.com/n2.xml", "url", 0, "https://a.com/p/n2"),
    ], "url string, kind string, pos int, loc string")
    got3 = sorted(r["url"] for r in X.sitemap_closure(roots, docs, "/p/", max_docs=3).collect())
    got9 = sorted(r["url"] for r in X.sitemap_closure(roots, docs, "/p/", max_docs=9).collect())
    assert got3 == ["https://a.com/p/2", "https://a.com/p/n1"]          # r1, r2, n1 visited; n2 beyond cap
    assert got9 == ["https://a.com/p/2", "https://a.com/p/n1", "https://a.com/p/n2"]


def test_og_fallback_both_orders(spark):
    html = ('<meta content="D" property="og:description"><meta property="og:title" content=" T ">'
            '<meta property="og:image" content="i.jpg">')
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    prods = spark.createDataFrame([("u", None, "", None)], "url string, name string, description string, images array<string>")
    r = J.og_fallback(prods, pages).first()
    assert (r["name"], r["description"], r["images"]) == ("T", "D", ["i.jpg"])


def test_reviews_cascade(spark):
    rows = [('MetafieldReviews = {"rating":{"scale_min":"1.0","scale_max":"5.0","value":"5.0"},"rating_count":6};',),
            ('MetafieldYotpoRating = "4.5"; MetafieldYotpoCount = "123";',),
            ('MetafieldYotpoCount = "7"; MetafieldLooxRating = "4.0"; MetafieldLooxCount = "9";',)]
    df = spark.createDataFrame(rows, "h string")
    r = X.reviews(F.col("h"))
    got = [(x[0], x[1]) for x in df.select(r["num_reviews"], r["average_rating"]).collect()]
    assert got == [(6, 5.0), (123, 4.5), (9, 4.0)]


def test_running_prefix_matches_global(spark):
    df = spark.range(0, 1000).select(F.format_string("k%04d", "id").alias("k"), (F.col("id") % 3 == 0).alias("f"))
    out = R.running_stats(df, "f", order="k", every=100).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(100, 1001, 100))
    assert [r["yes"] for r in out] == [len([i for i in range(s) if i % 3 == 0]) for s in range(100, 1001, 100)]


def test_lag_across_ranges_matches_window(spark):
    from pyspark.sql import Window

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}-{t}") for c in range(3) for t in range(400 if c == 1 else 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(tuple(r) for r in R.lag_across_ranges(df, "conv_id", "turn", ["text"]).select(
        "conv_id", "turn", "prev_text").collect())
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = sorted(tuple(r) for r in df.select("conv_id", "turn", F.lag("text").over(w)).collect())
    assert got == want


def test_lag_across_ranges_with_empty_partitions(spark):
    from pyspark.sql import Window

    # far fewer rows than range partitions: some partitions are empty
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "conv_id long, turn long, text string")
    got = sorted(tuple(r) for r in R.lag_across_ranges(df, "conv_id", "turn", ["text"]).select(
        "conv_id", "turn", "prev_text").collect())
    assert got == [(1, 1, None), (1, 2, "a"), (1, 3, "b")]


def test_sitemap_parse_fallback(spark):
    docs = spark.createDataFrame([
        ("a", '<?xml version="1.0"?><sm:sitemapindex xmlns:sm="x"><sm:sitemap><sm:loc> https://h/s1.xml </sm:loc>'
              '</sm:sitemap></sm:sitemapindex>'),
        ("b", '<urlset><url><loc>https://h/p/1</loc></url></urlset>'),
        ("c", '<html><body>A & B<br><a href="https://h/cat/">c</a><a href=" https://h/p/2 ">p</a>'
              '<a href="/rel">r</a><loc>https://h/p/3</loc></body>'),
    ], "url string, xml string")
    got = sorted(tuple(r) for r in X.sitemap_parse(docs).collect())
    assert got == [("a", "nested", "https://h/s1.xml"), ("b", "url", "https://h/p/1"),
                   ("c", "nested", "https://h/cat/"), ("c", "url", "https://h/p/2"), ("c", "url", "https://h/p/3")]
