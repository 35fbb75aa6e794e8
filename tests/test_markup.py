"""Golden pages of the single-parse page reader (B05, B14, B18, B20, B24) and of the sitemap parser."""

from pyspark.sql import functions as F

from shelfspark.functions import markup
from shelfspark.operators import extract as X
from shelfspark.operators import jsonld as J


def one(spark, html):
    return spark.createDataFrame([("https://h.com/a/b", html)], "url string, html string")


def links(spark, html):
    return [r.href for r in X.page_links(one(spark, html)).orderBy("pos").collect()]


def test_links(spark):
    html = ("<a title='a>b' href='/one'>x</a><!-- <a href=/no1> --><script>var x='<a href=\"/no2\">';</script><noscript><a href=/no3>n</a></noscript>"
            '<a href="/caf&eacute;?x=1&amp;copy=2&lt;">y</a><svg><a xlink:href="/no4" href=/two /></svg><a HREF = " /three ">z</a><a>w</a><a href="">e</a>')
    assert links(spark, html) == ["https://h.com/one", "https://h.com/café?x=1&copy=2<", "https://h.com/two", "https://h.com/three", "https://h.com/a/"]
    assert links(spark, None) == links(spark, "") == links(spark, "<a href='/cut") == []


def test_visible_text(spark):
    html = ("<!DOCTYPE html><title>T</title><header>no</header><nav>no<nav>no</nav>no</nav><p>a < b &mdash; c &#8217;q&rsquo;&nbsp;d</p><style>p{}</style>"
            "<noscript>no</noscript><!-- a > b --><div data-x='1>2'>e</div><script>if (a<b) {}</script><footer>no</footer>end <b")
    text = one(spark, html).select(X.page_text(F.col("html"), min_len=0)).first()[0]
    assert text == "T a < b — c ’q’ d e end"
    assert one(spark, "<p>short").select(X.page_text(F.col("html"))).first()[0] is None
    assert one(spark, None).select(X.page_text(F.col("html"), min_len=0)).first()[0] is None


def test_title_and_description(spark):
    html = "<h1 data-a='>'>\n🍁 Maker: Caf&eacute; &rsquo;s <i>Best</i> &#8217;</h1><h1>Second: no</h1><p class='>'>Name: x</p><p>One &ldquo;q&rdquo; < two</p><p><!-- c -->Three<br>x"
    row = one(spark, html).select(X.title_name(F.col("html")).alias("t"), X.description(F.col("html")).alias("d")).first()
    assert row.t == "Café ’s Best ’" and row.d == "One “q” < two Threex"
    row = one(spark, "<article><p><b>a<p>b<div>no</div><p>c</article>no").select(X.description(F.col("html")).alias("d")).first()
    assert row.d == "a b c"  # a paragraph ends with the next block and with what holds it
    row = one(spark, "<h2>x</h2>").select(X.title_name(F.col("html")).alias("t"), X.description(F.col("html")).alias("d")).first()
    assert row.t is None and row.d is None


def test_og_in_all_forms(spark):
    html = ("<!-- <meta property='og:title' content='no'> --><meta property='og:title' content='It&rsquo;s > all'><meta content=plain property=og:description>"
            "<meta property=\"og:image\" content=\"\"><meta property='og:image' content='second.jpg'>")
    products = spark.createDataFrame([("https://h.com/a/b", None, "", None)], "url string, name string, description string, images array<string>")
    row = J.og_fallback(products, one(spark, html)).first()
    assert (row["name"], row["description"], row["images"]) == ("It’s > all", "plain", [])  # only the first image element counts


def test_one_parse_for_all(spark):
    df = one(spark, "<h1>T</h1><p>x</p>").select(X.title_name(F.col("html")), X.description(F.col("html")), X.page_text(F.col("html"), min_len=0))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("kernel(") == 1


def test_sitemaps(spark):
    head = '<?xml version="1.0" encoding="ISO-8859-1"?>'
    docs = {
        "cdata": f'{head}<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc><![CDATA[https://h/p?a=1&b=2]]></loc></url><url><loc>https://h/q?a=1&amp;b=é</loc></url></urlset>',
        "comment": "<urlset><!-- <url><loc>https://h/no</loc></url> --><url><loc>\n https://h/yes </loc><loc/></url></urlset>",
        "image": '<urlset xmlns:image="i"><url><loc>https://h/p</loc><image:image><image:loc>https://h/i.jpg</image:loc></image:image></url></urlset>',
        "index": '<s:sitemapindex xmlns:s="x"><s:sitemap><s:loc>https://h/s.xml</s:loc></s:sitemap><url><loc>https://h/no</loc></url></s:sitemapindex>',
        "other": "<rss><url><loc>https://h/no</loc></url></rss>",
        "broken": "<urlset><url><loc>https://h/a?x&y</loc></url><a href='https://h/c/'>c</a><!-- <a href='https://h/no'> --><a href=rel>r</a>",
        "empty": "", "null": None,
    }
    got = {}
    for r in X.sitemap_parse(spark.createDataFrame(list(docs.items()), "url string, xml string")).collect():
        got.setdefault(r.url, []).append((r.kind, r.loc))
    assert got == {"cdata": [("url", "https://h/p?a=1&b=2"), ("url", "https://h/q?a=1&b=é")], "comment": [("url", "https://h/yes")], "image": [("url", "https://h/p")],
                   "index": [("nested", "https://h/s.xml")], "broken": [("nested", "https://h/c/"), ("url", "https://h/a?x&y")]}


def test_deep_and_long_pages():
    page = markup.PageReader("<div>" * 3000 + "x" + "<p>y " * 3000).row()
    assert page["text"].count("y") == 3000 and len(page["paragraphs"]) == 3000


def test_a_batch_is_parsed_in_slices():
    """however many pages an Arrow batch holds, few of them are Python objects at a time."""
    import tracemalloc

    import pyarrow as pa

    docs = pa.array([f'<a href="/{i}">x</a>' + "y" * 50_000 for i in range(800)] + [None])
    kernel = markup._arrow("array<string>", lambda h: markup.PageReader(h).links).func
    tracemalloc.start()
    got = kernel(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [[f"/{i}"] for i in range(800)] + [None] and kernel(docs.slice(0, 0)).to_pylist() == []
    assert peak < 12 << 20


def test_links_alone_are_those_of_the_page(spark):
    df = spark.createDataFrame([(1, '<a href=" /a&amp;b ">x</a><script><a href="/no"></script><a href=c>'), (2, ""), (3, None)], "id int, html string")
    rows = df.select(markup.links(F.col("html")).alias("a"), markup.page(F.col("html"))["links"].alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[2].a is None
