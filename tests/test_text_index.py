"""Typed tokens (H05) and the blocked index (H03, H04, D03) against plain analysis."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import fulltext as FT
from shelfspark.sources import io as IO

TOKENS = {
    "T-shirt": ["t-shirt", "t", "shirt"],
    "3.5mm jack": ["3.5", "mm", "jack"],
    "buy at Shop.com, now": ["buy", "at", "shop.com", "now"],
    "see https://www.shop.com/a/b.html?x=1 ok": ["see", "www.shop.com/a/b.html?x=1", "www.shop.com", "/a/b.html?x=1", "ok"],
    "mail Me@example.co.uk!": ["mail", "me@example.co.uk"],
    "-12 and +3.14e5 or 8.3.0": ["-12", "and", "+3.14e5", "or", "8.3.0"],
    "foo-bar-beta1": ["foo-bar-beta1", "foo", "bar", "beta1"],
    "size 5xl, 10 20": ["size", "5xl", "10", "20"],
    "a <b>bold</b> &amp; plain": ["a", "bold", "plain"],
    "Café-crème № ½": ["café-crème", "café", "crème", "½"],
    "": [], None: [],
}


def test_typed_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", FT.typed_tokens(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == TOKENS


def test_words_taken_at_once_give_the_same_tokens(spark):
    """plain words need not try the classes of longer tokens; texts of joined fragments keep every token."""
    r = random.Random(11)
    parts = ["shop", "T-shirt", "a.b", ".", "..", "-", "--", "_", "+", "@", ":", "://", "/", "<b>", "<", ">", "&amp;", "&", "3.14", "8.3.0", "-2", "5xl", "é", "Ünï", "½", "٣", "x1", "me@ex.com",
             "http://h.org/p?q=1", "w.", "end.Next", "e.g", "\n", " ", " ", " ", ",", "'", "x_y", "a+b", "c:d", "k.-", "k._"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = F.regexp_extract_all(F.lower("t"), F.lit(FT.TYPED_RE), F.lit(0))
    kept = F.filter(found, lambda t: ~(t.startswith("<") | t.startswith("&") | t.endswith("://")))
    plain = F.flatten(F.transform(kept, lambda t: F.when(t.contains("@"), F.array(t))
                                  .when(t.contains("/"), F.array(t, F.regexp_extract(t, "^[^/]*", 0), F.regexp_extract(t, "/.*$", 0)))
                                  .when(t.rlike(FT.COMPOUND_RE), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    both = df.select("t", FT.typed_tokens(F.col("t")).alias("k"), plain.alias("p"))
    assert both.where(F.col("k") != F.col("p")).collect() == [] and both.count() == 4000
    fast = FT.SCAN_RE.removesuffix("|" + FT.TYPED_RE)
    words = "plain words. End, of (it) 5xl T-shirt a@b.c shop.com naïve"
    got = spark.createDataFrame([(words,)], "t string").select(F.regexp_extract_all(F.lower("t"), F.lit(fast), F.lit(0))).first()[0]
    assert got[:6] == ["plain", "words", "end", "of", "it", "xl"] and "naïve" in got and "shop" not in got


def test_each_group_of_blocks_has_its_own_task(spark):
    """Groups dealt by hash met in a few tasks while others had none."""
    docs = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(3000)], "id long, text string")
    rows = FT.posting_rows(docs, F.col("text"), "simple", 64, packed=True).select("folder", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(rows) == len({r.task for r in rows}) == len({r.folder for r in rows}) == 64


def test_english_analysis_finds_compounds_numbers_and_hosts(spark):
    docs = spark.createDataFrame([(1, "The T-shirts of shop.com have a 3.5mm plug"), (2, "shirt")], "id long, text string")
    for q, want in {"shirts": [1, 2], "t-shirt": [1], "3.5mm": [1], "shop.com": [1], "shop": []}.items():
        qt = FT.query_terms(spark.createDataFrame([(1, q)], "query_id long, q string"), F.col("q"), "english")
        index = FT.build_index(docs, [], F.col("text"), "english")
        got = FT.search_index_topk(index, qt, None, F.lit(True), [], [])
        assert sorted(r.id for r in got.collect()) == want, q


def corpus(n, seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    return [(i, f"u{i:04d}", " ".join([r.choice(words) for _ in range(r.randint(1, 30))] + ["common"] * (i % 3 == 0) * r.randint(1, 4)), i % 7 != 0) for i in range(n)]


@pytest.mark.parametrize("block_docs, first", [(1024, 16), (10, 3), (1, 1)])
def test_index_gives_the_same_matches_and_ranks(spark, monkeypatch, block_docs, first):
    monkeypatch.setattr(FT, "FIRST_BLOCKS", first)
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "id long, url string, text string, ok boolean")
    qs = spark.createDataFrame([(1, "common w1"), (2, "w3 w4 w5"), (3, "common"), (4, "w7 nowhere"), (5, ""), (6, "w9 w9")], "query_id long, q string")
    qt = FT.query_terms(qs, F.col("q"))
    occ = FT.matched_occurrences(FT.analyze(docs, ["id"], F.col("text")), qt).join(docs.select("id", "url", "ok"), "id").where("ok")
    plain = FT.match_and_rank(occ, ["url"])
    index = FT.build_index(docs, ["url", "ok"], F.col("text"), block_docs=block_docs)
    order = [F.desc("text_rank"), F.asc("url")]
    got = FT.search_index_topk(index, qt, None, F.col("ok"), ["url"], order)
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "url", "text_rank").collect()))
    assert key(got) == key(plain) and got.count() > 50
    top = FT.search_index_topk(index, qt, 8, F.col("ok"), ["url"], order)
    from shelfspark.operators.vector import top_k_per_group

    assert key(top) == key(top_k_per_group(plain, ["query_id"], order, 8))
    d03 = FT.term_matches(index, qt, F.col("ok"), []).select("query_id", "id", "term_idx", F.explode("pos").alias("pos"))
    assert sorted(map(tuple, d03.collect())) == sorted(map(tuple, occ.select("query_id", "id", "term_idx", "pos").collect()))


def test_a_common_word_reads_only_the_blocks_of_the_rare_one(spark):
    rows = [(i, f"u{i}", "common " * (1 + i % 3) + ("rare" if i == 77 else ""), True) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, url string, text string, ok boolean")
    index = FT.build_index(docs, ["url", "ok"], F.col("text"), block_docs=20)
    qt = FT.query_terms(spark.createDataFrame([(1, "common rare")], "query_id long, q string"), F.col("q"))
    visits = FT.block_visits(index, qt).collect()
    assert len(visits) == 1 and index.postings.where("term = 'common'").count() > 20
    kept = FT.TextIndex(IO.keep(index.postings, "p", FT.write_by_folder), IO.keep(index.docs, "d", FT.write_by_folder))
    got = FT.search_index_topk(kept, qt, 5, F.col("ok"), ["url"], [F.desc("text_rank")]).collect()
    assert [r.id for r in got] == [77]


def test_empty_index(spark):
    docs = spark.createDataFrame([], "id long, url string, text string")
    qt = FT.query_terms(spark.createDataFrame([(1, "a b")], "query_id long, q string"), F.col("q"))
    index = FT.build_index(docs, ["url"], F.col("text"))
    assert FT.search_index_topk(index, qt, 3, F.lit(True), ["url"], [F.desc("text_rank")]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_postings(docs, mode, blocks, stems):
    """The posting rows by grouping every occurrence."""
    tokens = docs.select("id", F.posexplode(FT.mode_tokens(F.col("text"), mode)).alias("pos", "term"))
    occ = FT.placed(tokens.select("id", "term", (F.col("pos") + 1).alias("pos")), blocks)
    if mode == "english":
        occ = FT.stem_terms(occ.where(~F.col("term").isin(FT.ENGLISH_STOP_WORDS)), stems=stems)
    by_doc = occ.groupBy("folder", "block", "term", "id").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    return sorted(((r.folder, r.block, r.term, [(x.id, list(x.pos)) for x in r.p]) for r in by_doc.groupBy("folder", "block", "term").agg(
        F.sort_array(F.collect_list(F.struct("id", "pos"))).alias("p")).collect()), key=repr)


@pytest.mark.parametrize("mode,table", [("simple", None), ("english", None), ("english", [("rings", "ring"), ("bolts", "bolt"), ("bolts", "screw"), ("gold", None), (None, "none")])])
@pytest.mark.parametrize("blocks", [1, 3])
def test_postings_equal_grouped_occurrences(spark, mode, table, blocks):
    """A block's kernel gives the rows of the grouped occurrences; repeated and null ids, empty and null texts."""
    texts = ["Rings, gold rings and a bolt", "the of and", "", None, "bolts bolts ring ring-bolts", "x@y.example 3.14 -2 naïve ring", "running runs ran rings"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, "bolts first ring"), (None, "gold ring"), (None, "gold")], "id long, text string")
    stems = None if table is None else spark.createDataFrame(table, "term string, stem string")
    rows = FT.posting_rows(docs, F.col("text"), mode, blocks, stems).collect()
    got = sorted(((r.folder, r.block, r.term, list(zip(r.ids, map(list, r.positions)))) for r in rows), key=repr)
    assert got == plain_postings(docs, mode, blocks, stems) and got
    assert all(r.n_docs == len(r.ids) and r.max_tf == max(map(len, r.positions)) for r in rows)


def test_index_and_search_shuffle_no_occurrences(spark):
    """Texts are dealt by groups of blocks, never by term; a posting meets all queries of its block at once (F4), and the
    documents before the queries (F19)."""
    docs = spark.createDataFrame([(i, f"/{i}", f"common w{i % 5} common") for i in range(50)], "id long, url string, text string")
    dealt = [line for line in plan_of(FT.posting_rows(docs, F.col("text"), "english", 4)).splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and "part#" in dealt[0] and "term#" not in dealt[0]
    index = FT.build_index(docs, ["url"], F.col("text"), block_docs=20)
    index = FT.TextIndex(IO.keep(index.postings, "p", FT.write_postings), IO.keep(index.docs, "d", FT.write_by_folder))
    qt = IO.keep(FT.query_terms(spark.createDataFrame([(q, f"common w{q % 5}") for q in range(40)], "query_id long, q string"), F.col("q")), "qt")
    visits = IO.keep(FT.block_visits(index, qt), "v")
    found = FT.block_matches(index, qt, visits, F.lit(True), ["url"])
    assert "FlatMapCoGroupsInArrow" in plan_of(found)
    assert {(r.query_id, r.id) for r in found.collect()} == {(q, i) for q in range(40) for i in range(50) if q % 5 == i % 5}
    hits = FT.term_matches(index, qt, F.lit(True), ["url"])
    joins = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "folder#" not in joins[0] and "folder#" in joins[1]
    assert hits.count() == 40 * 50 + 40 * 10


def test_stemming_moves_no_occurrence(spark):
    """stems are made inside each row's tokens."""
    docs = spark.createDataFrame([(1, "The running of rings"), (2, None)], "id long, text string")
    terms = FT.analyze(docs, ["id"], F.col("text"), "english")
    assert "Exchange" not in plan_of(terms) and "Join" not in plan_of(terms)
    assert [tuple(r) for r in terms.orderBy("pos").collect()] == [(1, "run", 2), (1, "ring", 4)]


@pytest.mark.parametrize("mode", ["simple", "english"])
def test_token_counts_shuffle_texts_only(spark, mode):
    """one shuffle, of texts by id; repeated ids count together."""
    from shelfspark.plans import search as S

    rows = [(1, "Rings", None, "gold rings"), (2, "ring", "b", None), (1, "bolt", None, None)]
    p = spark.createDataFrame(rows, "id long, name string, brand string, description string")
    stems = IO.keep(spark.createDataFrame([("rings", "ring")], "term string, stem string"), "stems")
    t = S.token_counts(S._by_id(p), mode, stems if mode == "english" else None)
    dealt = [line for line in plan_of(t).splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "term#" not in dealt[0]
    assert sorted(map(tuple, t.collect())) == [(1, 4, 3, 3, "bolt"), (2, 2, 2, 2, "b")]


@pytest.mark.parametrize("mode,table,small", [("simple", None, 9), ("english", None, 9), ("english", [("rings", "ring"), ("bolts", "bolt"), ("bolts", "screw"), ("gold", None), (None, "none")], 9),
                                              ("english", [("rings", "ring"), ("bolts", "bolt"), ("bolts", "screw"), ("gold", None), (None, "none")], 0)])
def test_packed_postings_are_the_posting_rows(spark, monkeypatch, tmp_path, mode, table, small):
    """Stored postings are packed by block and shard of terms, so no row per (block, term) is sorted by the JVM; they
    unpack to the same rows, all or those of some terms, and a search over them finds the same.  ``small`` stems or fewer go
    to the tasks, a larger table to its blocks."""
    monkeypatch.setattr(FT, "SMALL_STEMS", small)
    texts = ["Rings, gold rings and a bolt", "the of and", "", None, "bolts bolts ring ring-bolts", "x@y.example 3.14 -2 naïve ring", "long " * 300 + "ring"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, "bolts first ring"), (None, "gold ring"), (None, "gold")], "id long, text string")
    stems = None if table is None else spark.createDataFrame(table, "term string, stem string")
    key = lambda rows: sorted(((r.folder, r.block, r.term, r.n_docs, r.max_tf, list(zip(r.ids, map(list, r.positions)))) for r in rows), key=repr)
    want = key(FT.posting_rows(docs, F.col("text"), mode, 3, stems).collect())
    assert [x[:3] + (x[5],) for x in want] == plain_postings(docs, mode, 3, stems)
    made = FT.posting_rows(docs, F.col("text"), mode, 3, stems, packed=True)
    assert made.count() <= 3 * FT.SHARDS

    def store(name, build, write):
        write(build(), f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    index = FT.stored_index(lambda: FT.build_index(docs, [], F.col("text"), mode, 4, stems, packed=True), store)
    packed = FT.TextIndex(None, index.docs, made)
    assert key(FT.unpacked(made, "bigint").collect()) == want
    qt = FT.query_terms(spark.createDataFrame([(1, "gold ring"), (2, "bolts"), (3, "nowhere")], "query_id long, q string"), F.col("q"), mode, stems=stems)
    terms = {r.term for r in qt.collect()}
    assert sorted((r.block, r.term) for r in FT.batch_postings(packed, qt).collect()) == sorted(x[1:3] for x in want if x[2] in terms)
    plain = FT.build_index(docs, [], F.col("text"), mode, 4, stems)
    hits = [sorted((r.query_id, r.id, r.text_rank) for r in FT.search_index_topk(x, qt, None, F.lit(True), [], []).collect()) for x in (index, plain)]
    assert hits[0] == hits[1] and hits[0]


def test_catalogue_texts_are_dealt_once(spark, tmp_path):
    """the narrow tables meet before the documents, whose one shuffle also lays out the stored catalogue."""
    from shelfspark.sources import adapters
    from shelfspark.sources.tables import Tables

    built = adapters.catalog(Tables(spark, "/root/testdata/sf0.001"))
    dealt = [line for line in plan_of(built).splitlines() if "Exchange hashpartitioning(doc_id#" in line and "64)" in line]
    assert len(dealt) == 1
    path = f"{tmp_path}/catalog"
    adapters.write_by_id_bucket(built, path)
    stored = spark.read.parquet(path)
    files = stored.select("id_bucket", F.input_file_name().alias("f")).distinct().groupBy("id_bucket").count()
    assert files.agg(F.max("count")).first()[0] == 1 and stored.count() == built.count()
    assert stored.where(F.col("id_bucket") != adapters.id_bucket("id")).count() == 0
