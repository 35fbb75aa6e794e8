import re

from shelfspark.llm import html_main

SF001 = "/root/testdata/sf0.001"
FULL = """<!DOCTYPE html><html lang=en><head><title>T &am</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar cookie-ok"><div id="cookieBanner">We use cookies. <a href=/p>More</a></div><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- ad 1 > 0 --><div class="ad">Buy</div>
<div class="content with-sidebar"><article class="post"><header><h1>Head &amp; line&#8217;s</h1></header>
<p>One <b>bold</b>text a < b &mdash; c<br>next&nbsp;word<p>Two <a title='a>b' href="x">link</a>.<div class=sponsored>Pay</div>
<ul><li>first<li>second</ul><form>Name <input name=n></form><table><tr><td>c1<td>c2</table><pre>x
  y</pre><section id="comments"><article class=comment><p>Nice!</p></article></section></article>
<aside>More</aside></div><div class="user-comments">Hi</div><footer>&copy; me</footer><noscript>js</noscript>"""


def main(html):
    return html_main.read(html).text()


def test_one_page():
    assert main(FULL).split("\n") == ["Head & line’s", "One boldtext a < b — c next word", "Two link.", "first", "second", "c1", "c2", "x y"]


def test_pages_without_article():
    assert main("<body><div class=menu>m</div><p>Some text here that is long enough.</p><p>More") == "Some text here that is long enough.\nMore"
    assert main("<main role=main><h1>T</h1>x<div>y</div>z<footer>f</footer></main><p>out") == "T\nx\ny\nz"
    assert main("<div class='page-widget'><p>All text of a page lies in an element with a furniture word.</p></div>") == "All text of a page lies in an element with a furniture word."
    assert main("just text &lt;b&gt; &am &amp") == "just text <b> &am &"
    assert main("<p>cut <![CDATA[x]]> <b") == "cut x" and main("<p>1 < 2") == "1 < 2"
    assert main("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main(None) == main("") == main("<script>only") == ""


def site(n, body, host="https://h.example"):
    return [(i, f"{host}/{i}", body(i)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, host string, hash long, n_chars int")


def got(spark, rows, **kw):
    df = html_main.main_text(frame(spark, rows), **kw)
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    out = [tuple(r) for r in df.collect()]
    assert all(len(t) == n for _, _, t, n in out)
    return {i: t for i, _, t, _ in out}


def test_recurring_subtrees_go(spark):
    """A menu without any telling name goes because it recurs; text shared by copies and passages inside articles stay."""
    page = lambda i: f"<body><div><div><a href=/{i}>Home</a> <a>News</a></div><p>Own text number {i} of this page.</p><p>License line.</p></div>"
    rows = site(10, page) + [(100 + i, f"https://two.example/{i}", page(1)) for i in range(10)] + [(200, None, page(3)), (201, "no address", page(3))]
    texts = got(spark, rows, text_pages=50)
    assert all(texts[i] == f"Own text number {i} of this page.\nLicense line." for i in range(10))
    assert all(texts[100 + i] == "Home News\nOwn text number 1 of this page.\nLicense line." for i in range(10))  # copies of one page: no template
    assert texts[200] == texts[201] == "Home News\nOwn text number 3 of this page.\nLicense line."
    article = lambda i: f"<article><h1>Same title</h1><p>Own {i}</p><p>Passage that all share.</p><div>Share this</div></article>"
    assert got(spark, site(8, article)) == {i: f"Same title\nOwn {i}\nPassage that all share." for i in range(8)}


def test_odd_rows_and_tables(spark):
    rows = [(None, None, None), (1, "http://a.example", ""), (1, "http://a.example", ""), (2, "http://a.example/x", "<p>" + "word " * 300_000), (3, "HTTP://u:p@A.example:80/", "<p>\0 \x1c x퟿")]
    texts = got(spark, rows)
    assert texts[1] == "" and texts[None] == "" and len(texts[2]) == 1_499_999 and texts[3].endswith("x퟿")
    assert got(spark, []) == {}


def test_every_page_against_its_article(spark):
    """The given pages hold one article each: its blocks, cut out by hand, are the result."""
    import html as escapes

    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    texts = got(spark, [(r.page_id, r.url, r.html) for r in pages])
    for r in pages:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(escapes.unescape(re.sub(r"</?(?:b|br)>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert texts[r.page_id] == "\n".join(filter(None, blocks))
