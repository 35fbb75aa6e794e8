from collections import Counter

from helpers import SF01, SF001, odd_rows

from shelfspark.llm import langid


def test_declared_languages_are_found_again(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r.id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(got[r.doc_id].kept for r in rows)
    assert sum(got[r.doc_id].lang == r.lang for r in rows) >= 0.99 * len(rows)
    assert sum(got[r.doc_id].text_lang == r.lang for r in rows) >= 0.97 * len(rows)  # text alone


def test_wrong_declarations_lose_against_long_texts(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    wrong = {r.doc_id for r in rows if r.doc_id % 20 == 0 and r.n_chars > 400}
    swap = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    df = spark.createDataFrame([(r.doc_id, r.text, swap[r.lang] if r.doc_id in wrong else r.lang, r.source) for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in langid.identify(df).collect()}
    assert sum(got[r.doc_id].lang == r.lang for r in rows if r.doc_id in wrong) >= 0.9 * len(wrong)


def test_host_prior_decides_short_undeclared_texts(spark):
    rows = [(r.doc_id, r.text, r.lang, f"http://www.site{r.doc_id % 5}.{r.lang}/p") for r in spark.read.parquet(f"{SF01}/documents.parquet").collect() if r.lang in ("en", "de")]
    rows += [(10**6 + i, "und" if i % 2 else "x", None, f"https://u:p@new{i}.{'de' if i % 2 else 'en'}:80/q") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r.id: r for r in langid.identify(df, host_col=None, address_col="url").collect()}
    # hosts unseen but for these rows: the suffix speaks through the smoothing
    assert sum(got[10**6 + i].lang == ("de" if i % 2 else "en") for i in range(40)) >= 36


def test_pages_with_markup_and_address(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").selectExpr(
        "page_id", "url", "regexp_replace(html, '<[^>]*>', ' ') as body", "regexp_extract(html, '<html[^>]* lang=\"([^\"]*)', 1) as markup")
    got = Counter((r.declared, r.lang) for r in langid.identify(pages, "page_id", "body", "markup", None, "url").collect())
    assert sum(n for (d, p), n in got.items() if d == p) >= 0.97 * sum(got.values())


def test_odd_rows(spark):
    df = odd_rows(spark)
    got = langid.identify(df).collect()
    assert len(got) == 17
    by = {r.id: r for r in got}
    assert not any(by[i].kept or by[i].lang != "und" for i in (1, 2, 11, 12)) and by[9].kept and by[7].kept
    kept = langid.drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == 13
    assert langid.identify(df.where("false")).count() == 0 and langid.drop_unidentified(df.where("false")).count() == 0
    none = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source")
    assert {r.kept for r in langid.identify(none).collect()} == {False}


def test_posterior_by_hand(spark):
    """The fused posterior of a small table equals the product of its parts, computed here again."""
    import math

    import numpy as np

    rows = [(i, "the cat sat" if i % 2 else "der hund lief", ["en", "de"][i % 2 == 0] if i % 7 else "de", f"h{i % 3}.{'com' if i % 2 else 'de'}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs, logp = langid.text_model(df.selectExpr("text", "lang as declared"))
    ll, z = {}, {}
    for i, t, _, _ in rows:
        at, _n = langid.trigrams(t)
        ll[i] = logp[at].sum(axis=0, dtype=float) * min(1, langid.EFFECTIVE / len(at))
        z[i] = int(np.argmax(ll[i]))
    said = np.ones((4, 2)) / 4
    for i, _, d, _ in rows:
        said[langs.index(d), z[i]] += 1
    top = said.sum(axis=0) / said.sum()
    k = langid.SMOOTHING

    def prior(rows_, above):
        n = np.bincount([z[i] for i in rows_], minlength=2)
        return (n + k * above) / (n.sum() + k)

    for r in langid.identify(df).collect():
        host = rows[r.id][3]
        above = prior([i for i, _, _, h in rows if h.split(".")[1] == host.split(".")[1]], top)
        p = prior([i for i, _, _, h in rows if h == host], above)
        log = ll[r.id] + np.log(said / said.sum(axis=0))[langs.index(rows[r.id][2])] + np.log(p)
        want = np.exp(log - log.max())
        assert math.isclose(r.posterior, 1 / want.sum(), rel_tol=1e-9) and r.lang == langs[int(np.argmax(log))]


def test_rare_languages_are_found_at_any_size(spark):
    words = {"en": "the house and street with three people who were waiting", "fi": "kaupungin kadulla odottivat ihmiset joilla oli yhteinen asia", "cy": "roedd y bobl yn aros ar y stryd ger yr hen eglwys"}

    def text(lang, i):
        w = words[lang].split()
        return " ".join(w[(i * 7 + k * (1 + i % 3)) % len(w)] for k in range(12))

    rows = [(i, text("en", i), "en", "s") for i in range(8000)]
    rows += [(10_000 + i, text("fi", i), "fi" if i < 30 else "en", "s") for i in range(33)]  # 0.4 % of the documents, three declared wrongly
    rows += [(20_000 + i, text("cy", i), "cy", "s") for i in range(2)]  # too few for a model
    rows += [(30_000, text("en", 1), "zz", "s")]  # no such language: the text is English
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.kept for r in got.values())
    assert {r.lang for i, r in got.items() if i < 10_000} == {"en"}
    assert {r.lang for i, r in got.items() if 10_000 <= i < 20_000} == {"fi"}
    assert [(got[i].lang, got[i].text_lang) for i in (20_000, 20_001)] == [("cy", "cy")] * 2 and got[30_000].lang == "en"


def test_very_many_languages(spark):
    tags = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(k * 25 + i, f"{t}{t}q {t}x{t} {t}v{t}w {t}{t}{t}", t, f"h{i}") for k, t in enumerate(tags) for i in range(25)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and all(r.lang == tags[r.id // 25] and r.kept for r in got)


def test_stage_keeps_clean_texts_without_any_declaration(spark):
    for declared in ("cast(null as string)", "'English'"):
        df = odd_rows(spark).selectExpr("doc_id", "text", f"{declared} as lang", "source")
        assert sorted(r.doc_id or 0 for r in langid.drop_unidentified(df).collect()) == sorted([0, 3, 4, 5, 6, 7, 8, 9, 9, 10, 13, 14, 15])
