"""Registered search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import fulltext as FT
from ..operators import hybrid as HY
from ..operators import vector as V
from ..operators.scoring import ScoreTable
from ..operators.vector import q6
from ..sources import adapters
from ..sources import io as IO
from ..sources.tables import Tables
from . import oracle as O
from .registry import register
from .search_sql import INFLECTED, STEMS, search_sql


def _pq(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return adapters.stored(spark, sf_dir, "catalog"), adapters.search_queries(t)


def _index(spark, sf_dir, mode="simple", rebuild=False):
    """The stored inverted index of the stored catalogue, one per analyser (built once per source state)."""
    return FT.stored_index(lambda: HY.search_index(adapters.stored(spark, sf_dir, "catalog"), mode, packed=True), lambda name, build, write: adapters.materialize(
        spark, sf_dir, f"catalog_index_{mode}_{name}", build, write, rebuild=rebuild))


def _parsed(spark, sf_dir):
    """(prepared products, parsed query batch written once)."""
    p, q = _pq(spark, sf_dir)
    return HY.prepare_products(p), IO.keep(HY.prepare_queries(q), "parsed-queries")


@register("h07_hybrid_search", search_sql("""select query_id, row_number() over (partition by query_id order by hybrid_score desc, url) as rank,
 url, name, brand, vector_similarity as similarity, {tr} as text_rank, hybrid_score, made_in_canada, num_reviews
 from hybrid qualify rank <= 250""".format(tr=O.q6("text_rank"))))
def h07(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    r = HY.hybrid_search(p, q, mode="simple", index=_index(spark, sf_dir))
    return r.select("query_id", "rank", "url", "name", "brand", F.col("vector_similarity").alias("similarity"),
                    q6(F.col("text_rank")).alias("text_rank"), "hybrid_score", "made_in_canada", "num_reviews")


@register("h08_hybrid_search_basic", search_sql("""select query_id, row_number() over (partition by query_id order by score desc, url) as rank,
 url, name, made_in_canada, score from (select *, {s} as score from merged) qualify rank <= 25""".format(
    s=O.q6("0.5 * vector_similarity + 0.5 * text_rank + case when made_in_canada = true then 0.3 else 0.0 end")),
    k=fixed.INITIAL_SEARCH_LIMIT, basic=True))
def h08(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    r = HY.hybrid_search_basic(p, q, mode="simple", index=_index(spark, sf_dir))
    return r.select("query_id", "rank", "url", "name", "made_in_canada", "score")


@register("h01_vector_topk", search_sql("""select query_id, row_number() over (partition by query_id order by vs desc, url) as rank,
 id, url, vs as vector_similarity from vec"""))
def h01(spark, sf_dir):
    pp, pq = _parsed(spark, sf_dir)
    r = V.vector_topk(pp, pq, fixed.SQL_CANDIDATES)
    return r.select("query_id", "rank", "id", "url", "vector_similarity")


@register("h01_vector_topk_pairs", search_sql("""select query_id, row_number() over (partition by query_id order by vs desc, url) as rank,
 id, url, vs as vector_similarity from vec"""))
def h01p(spark, sf_dir):
    """H01 with a small tile: the batch is searched in several tiles and gives the same rows."""
    pp, pq = _parsed(spark, sf_dir)
    r = V.vector_topk(pp, pq, fixed.SQL_CANDIDATES, tile_bytes=8 << 10)
    return r.select("query_id", "rank", "id", "url", "vector_similarity")


@register("h03_text_match", search_sql("select query_id, id from matched"))
def h03(spark, sf_dir):
    pp, pq = _parsed(spark, sf_dir)
    return HY.text_match(pp, pq, HY.filter_pred(), index=_index(spark, sf_dir))


@register("h04_text_rank_cd", search_sql(f"select query_id, id, {O.q6('text_rank')} as text_rank from ranked"))
def h04(spark, sf_dir):
    pp, pq = _parsed(spark, sf_dir)
    r = HY.text_topk(pp, pq, None, HY.filter_pred(), index=_index(spark, sf_dir))
    return r.select("query_id", "id", q6(F.col("text_rank")).alias("text_rank"))


def _by_id(p):
    """``(id, doc)``: the searchable texts dealt by id, so that the counts per id shuffle no occurrence."""
    return p.select("id", HY.search_text(p).alias("doc")).repartition("id")


def token_counts(docs, mode="simple", stems=None):
    """Per id of ``docs`` (id, doc): tokens, distinct terms, last position, first term."""
    t = FT.analyze(docs, ["id"], F.col("doc"), mode, stems)
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("term").alias("n_terms"),
                               F.max("pos").alias("max_pos"), F.min("term").alias("first_term"))


@register("h05_analyzer", O.with_views(f"""select id, count(*) as n_tokens, count(distinct term) as n_terms, max(pos) as max_pos,
 min(term) as first_term from (select id, unnest(toks) as term, generate_subscripts(toks, 1) as pos
 from (select id, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(brand, ''), coalesce(description, ''))),
 '{FT.TOKEN_RE}') as toks from catalog)) group by id""", "catalog"))
def h05(spark, sf_dir):
    p, _ = _pq(spark, sf_dir)
    return token_counts(_by_id(p))


@register("d01_query_cross", search_sql("select query_id, count(*) as n_candidates from pairs group by query_id"))
def d01(spark, sf_dir):
    pp, pq = _parsed(spark, sf_dir)
    return V.candidate_counts(pp, pq)


@register("d03_match_predicate_join", search_sql(
    "select query_id, id, count(*) as occurrences, count(distinct term_idx) as terms_found from occ group by query_id, id"))
def d03(spark, sf_dir):
    pp, pq = _parsed(spark, sf_dir)
    occ = HY.text_occurrences(pp, pq, HY.filter_pred(), index=_index(spark, sf_dir))
    return occ.groupBy("query_id", "id").agg(F.sum(F.size("pos")).alias("occurrences"), F.count("*").alias("terms_found"))


@register("g03_union_all", search_sql("select query_id, branch, count(*) as n from cand group by query_id, branch"))
def g03(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    return HY.candidates(p, q, mode="simple", index=_index(spark, sf_dir)).groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("n"))


@register("e12_merge_candidates", search_sql(f"""select query_id, url_base, url, name, brand, {O.q6('vector_similarity')} as vector_similarity,
 {O.q6('text_rank')} as text_rank, made_in_canada, num_reviews from merged"""))
def e12(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    m = HY.merge_candidates(HY.candidates(p, q, mode="simple", index=_index(spark, sf_dir)))
    return m.select("query_id", "url_base", "url", "name", "brand", q6(F.col("vector_similarity")).alias("vector_similarity"),
                    q6(F.col("text_rank")).alias("text_rank"), "made_in_canada", "num_reviews")


@register("f01_minmax_norm", search_sql(f"""select query_id, url_base, {O.q6('vector_similarity_norm')} as vector_similarity_norm,
 {O.q6('text_rank_norm')} as text_rank_norm from scored"""))
def f01(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    m = HY.merge_candidates(HY.candidates(p, q, mode="simple", index=_index(spark, sf_dir)))
    s = HY.minmax_norm(HY.minmax_norm(m, "vector_similarity", "vector_similarity_norm", 1.0), "text_rank", "text_rank_norm", 0.0)
    return s.select("query_id", "url_base", q6(F.col("vector_similarity_norm")).alias("vector_similarity_norm"),
                    q6(F.col("text_rank_norm")).alias("text_rank_norm"))


@register("g01_topk_per_query", search_sql("""select query_id, url, hybrid_score from hybrid
 qualify row_number() over (partition by query_id order by hybrid_score desc, url) <= 10"""))
def g01(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    return HY.hybrid_search(p, q, final_k=10, mode="simple", index=_index(spark, sf_dir)).select("query_id", "url", "hybrid_score")


# --- after H07: de-dupe, rerank, cards, funnel -------------------------------
from ..operators import ranking as RK  # noqa: E402
from .search_sql import ranking_sql  # noqa: E402


def _ranked(spark, sf_dir):
    p, q = _pq(spark, sf_dir)
    return HY.hybrid_search(p, q, mode="simple", index=_index(spark, sf_dir))


def _reranked(spark, sf_dir):
    d = RK.greedy_dedupe(_ranked(spark, sf_dir))
    lim = d.where(F.col("dedupe_rank") <= fixed.INITIAL_SEARCH_LIMIT)
    return d, RK.rerank(lim, score_col=F.col("vector_similarity"))


@register("h09_greedy_dedupe", ranking_sql("select query_id, rank, dedupe_rank, url from deduped"))
def h09(spark, sf_dir):
    return RK.greedy_dedupe(_ranked(spark, sf_dir)).select("query_id", "rank", "dedupe_rank", "url")


@register("f04_cap_per_group", ranking_sql(f"""select query_id, rank, url from (select *,
 case when {O.product_type_sql('name')} <> '' then concat(lower(coalesce(brand, '')), '|', {O.product_type_sql('name')}) end as bt
 from ranked250) qualify bt is null or row_number() over (partition by query_id, bt order by rank) <= 3"""))
def f04(spark, sf_dir):
    return RK.cap_per_group(_ranked(spark, sf_dir), 3).select("query_id", "rank", "url")


_SM = O.smooth_rating_sql("average_rating", "num_reviews")
_DOC = f"""concat('Product Name: ', coalesce(name, ''), ' \n\nBrand Name: ', coalesce(brand, ''),
 case when coalesce(price, '') <> '' then concat('\n\nPrice: ', price, ' ', coalesce(currency, '')) else '' end,
 case when made_in_canada = true then concat('\n\nMADE IN CANADA: YES - VERIFIED CANADIAN MANUFACTURED',
        case when coalesce(made_in_canada_reason, '') <> '' then concat('\n\n(Reason: ', made_in_canada_reason, ')') else '' end)
      when made_in_canada = false then concat('\n\nMade in Canada: NO - NOT CANADIAN MADE',
        case when coalesce(made_in_canada_reason, '') <> '' then concat('\n\n(Reason: ', made_in_canada_reason, ')') else '' end)
      else '\n\nMade in Canada: UNKNOWN - UNVERIFIED' end,
 case when coalesce(num_reviews, 0) = 0 then '\n\nQuality Score: N/A (No reviews)'
      else concat('\n\nQuality Score: ', format('{{:.1f}}', {_SM}), '/5 (', cast(num_reviews as varchar), ' reviews)') end,
 case when coalesce(description, '') <> '' then concat('\n\nDescription: ', left(description, 500)) else '' end)""".replace(
    "\\n", chr(10))


@register("h13_rerank_document", ranking_sql(f"select query_id, url, {_DOC} as doc_text from limited"))
def h13(spark, sf_dir):
    d, _ = _reranked(spark, sf_dir)
    lim = d.where(F.col("dedupe_rank") <= fixed.INITIAL_SEARCH_LIMIT)
    return lim.select("query_id", "url", RK.rerank_document(lim).alias("doc_text"))


@register("h14_rerank", ranking_sql("select query_id, rerank_rank, url, rerank_score from reranked"))
def h14(spark, sf_dir):
    _, rr = _reranked(spark, sf_dir)
    return rr.select("query_id", "rerank_rank", "url", "rerank_score")


_H14_SCORES_SQL = ranking_sql("""select query_id, rerank_rank, url, rerank_score from (
 select query_id, url, s as rerank_score, row_number() over (partition by query_id order by s desc nulls last, rank) as rerank_rank
 from (select *, case when length(name) % 3 <> 0 then cast(length(name) as double) end as s from limited)) where rerank_rank <= 50""")


@register("h14_rerank_scores", _H14_SCORES_SQL)
def h14s(spark, sf_dir):
    """H14 from a table of scores, as an external scorer leaves it; some rows have none."""
    lim = IO.keep(RK.greedy_dedupe(_ranked(spark, sf_dir)).where(F.col("dedupe_rank") <= fixed.INITIAL_SEARCH_LIMIT), "limited")
    scores = lim.where(F.length("name") % 3 != 0).select("query_id", "url", F.length("name").cast("double").alias("score"))
    return RK.rerank(lim, scores=scores).select("query_id", "rerank_rank", "url", "rerank_score")


def _name_length(queries: list[str], documents: list[str]) -> list[float | None]:
    """A stand-in for a relevance model: the length of the product name in the document, none for every third length."""
    names = [d.removeprefix("Product Name: ").split(" \n\nBrand Name: ", 1)[0] for d in documents]
    return [float(len(n)) if len(n) % 3 else None for n in names]


@register("h14_rerank_scorer", _H14_SCORES_SQL)
def h14x(spark, sf_dir):
    """H14 through the scorer hook over the texts of H13; its score table answers the second search without the scorer."""
    lim = IO.keep(RK.greedy_dedupe(_ranked(spark, sf_dir)).where(F.col("dedupe_rank") <= fixed.INITIAL_SEARCH_LIMIT), "limited")
    texts = adapters.search_queries(Tables(spark, sf_dir)).select("query_id", F.col("text").alias("query"))
    pairs = lim.withColumn("document", RK.rerank_document(lim)).join(texts, "query_id").select("query_id", "url", "query", "document")
    base = IO.scratch(spark, "h14-scores")
    ScoreTable(base, _name_length).scores(pairs)
    scores = ScoreTable(base, lambda q, d: 1 / 0).scores(pairs)  # all pairs are known: the scorer must not run
    return RK.rerank(lim, scores=scores).select("query_id", "rerank_rank", "url", "rerank_score")


@register("g02_funnel", ranking_sql("""select query_id, stage, n from (
 select query_id, 'sql' as stage, count(*) as n from ranked250 group by 1
 union all select query_id, 'deduped', count(*) from deduped group by 1
 union all select query_id, 'limited', count(*) from limited group by 1
 union all select query_id, 'reranked', count(*) from reranked group by 1)"""))
def g02(spark, sf_dir):
    # all stages from one ranked table: the search runs once
    ranked = IO.keep(_ranked(spark, sf_dir), "ranked")
    d = RK.greedy_dedupe(ranked)
    lim = d.where(F.col("dedupe_rank") <= fixed.INITIAL_SEARCH_LIMIT)
    return RK.funnel(ranked, d, RK.rerank(lim, score_col=F.col("vector_similarity")))


# --- H02, H15, J02, J03 ---------------------------------------------------------------------
from ..functions import urls as U  # noqa: E402
from ..operators import vector as V  # noqa: E402


def _vector_index(spark, sf_dir, pp):
    """The stored vector index of the stored catalogue (built once per source state)."""
    cols = [*V.PRODUCT_COLS]
    return V.build_vector_index(pp.select(*cols), store=lambda name, build, write=None: adapters.materialize(
        spark, sf_dir, name, build, write or (lambda d, p: d.write.parquet(p))))


@register("h01_vector_topk_indexed", search_sql("""select query_id, row_number() over (partition by query_id order by vs desc, url) as rank,
 id, url, vs as vector_similarity from vec"""))
def h01i(spark, sf_dir):
    """H01 over the index: lists that cannot hold one of a query's k best are not read; the rows are the same."""
    pp, pq = _parsed(spark, sf_dir)
    r = V.vector_topk_indexed(_vector_index(spark, sf_dir, pp), pq, fixed.SQL_CANDIDATES)
    return r.select("query_id", "rank", "id", "url", "vector_similarity")


@register("h02_vector_topk_ivf")
def h02(spark, sf_dir):
    """Approximate top-10 that asks for a recall of 0.95, and its recall@10 against exact search (rows-only check)."""
    pp, pq = _parsed(spark, sf_dir)
    approx = V.vector_topk_indexed(_vector_index(spark, sf_dir, pp), pq, 10, use_parsed=False, origin_only=False, recall=0.95)
    exact = V.vector_topk(pp, pq, 10, use_parsed=False, origin_only=False)
    return V.recall_at_k(approx, exact)


@register("h15_result_cards", ranking_sql("""select query_id, rerank_rank as ordinal, url,
 json_extract_string(images_json, '$[0]') as image,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(name, 'Unknown Product'), '(?i)CARD1', '', 'g'), '(?i)CARD2', '', 'g'),
   '(?i)CARD3', '', 'g'), '^[ \\-–]+|[ \\-–]+$', '', 'g') as title,
 BRAND as brand_display,
 case when coalesce(price, '') <> '' then concat('$', price, ' ', coalesce(currency, 'CAD')) else 'Price N/A' end as price_text,
 case when coalesce(average_rating, 0) <> 0 and coalesce(num_reviews, 0) <> 0
   then concat('⭐ ', format('{:.1f}', cast(average_rating as double)), ' (', cast(num_reviews as varchar), ' reviews)') else '' end as rating_text,
 case when made_in_canada = true then concat('Yes', case when coalesce(made_in_canada_reason, '') <> '' then concat(' — ',
     case when length(made_in_canada_reason) > 100 then concat(left(made_in_canada_reason, 100), '...') else made_in_canada_reason end) else '' end)
   when made_in_canada = false then concat('No', case when coalesce(made_in_canada_reason, '') <> '' then concat(' — ', made_in_canada_reason) else '' end)
   else 'Unknown' end as origin_text,
 case when length(d) > 200 then concat(left(d, 200), '...') else d end as snippet
 from (select *, trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) as d from reranked)"""
                                          .replace("CARD1", fixed.CARD_SIZE_TAIL.replace("'", "''"))
                                          .replace("CARD2", fixed.CARD_BIG_SIZE_TAIL.replace("'", "''"))
                                          .replace("CARD3", fixed.CARD_GENDER_TAIL.replace("'", "''"))
                                          .replace("BRAND", O.brand_display_sql("brand", "source_site"))))
def h15(spark, sf_dir):
    _, rr = _reranked(spark, sf_dir)
    return RK.result_cards(rr).drop("link")


def _enc(x):
    return f"replace(url_encode({x}), '%20', '+')"


@register("j03_tracked_url", ranking_sql(f"""select query_id, rerank_rank as ordinal, url,
 concat('http://localhost:8000/click?', concat_ws('&', concat('url=', {_enc("coalesce(url, '')")}),
   case when coalesce(source_site, '') <> '' then concat('source=', {_enc('source_site')}) end,
   'source_type=product',
   case when coalesce(left(name, 100), '') <> '' then concat('product_name=', {_enc('left(name, 100)')}) end)) as link
 from reranked"""))
def j03(spark, sf_dir):
    """Click-tracking links of the result cards (form encoding; the oracle uses url_encode with + for spaces)."""
    _, rr = _reranked(spark, sf_dir)
    return RK.result_cards(rr).select("query_id", "ordinal", "url", "link")


_UTM_SQL = f"""with u as (select id, url, concat('https://shop.example.com', url, '?ref=') as u,
   [{{'k': 'utm_source', 'v': 'shelfspark'}}, {{'k': 'utm_medium', 'v': 'referral'}}, {{'k': 'utm_campaign', 'v': source}},
    {{'k': 'utm_term', 'v': left(lower(replace(product_name, ' ', '_')), 50)}}, {{'k': 'referrer', 'v': 'shelfspark'}}] as utm
   from clicks),
 p as (select *, list_filter(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'),
     lambda s: contains(s, '=')), lambda s: {{'k': url_decode(split_part(s, '=', 1)), 'v': url_decode(substr(s, instr(s, '=') + 1))}}),
     lambda x: coalesce(x.v, '') <> '') as kv0 from u),
 d as (select *, list_filter(kv0, lambda x, i: not list_contains(list_transform(kv0[1:i - 1], lambda y: y.k), x.k)) as kv from p),
 a as (select *, list_concat(kv, list_filter(utm, lambda e: e.v is not null
     and not list_contains(list_transform(kv, lambda y: y.k), e.k))) as allkv from d)
 select id, url, concat(regexp_extract(u, '^([^?#]*)', 1),
   case when len(allkv) > 0 then concat('?', array_to_string(list_transform(allkv,
     lambda x: concat({_enc('x.k')}, '=', {_enc('x.v')})), '&')) else '' end,
   case when regexp_extract(u, '#(.*)$', 1) <> '' then concat('#', regexp_extract(u, '#(.*)$', 1)) else '' end) as final_url
 from a"""


@register("j02_add_utm", "WITH " + O.VIEWS_SQL_CLICKS + _UTM_SQL.replace("with u as", ", u as", 1))
def j02(spark, sf_dir):
    """UTM-tagged landing URLs for every logged click: blank params dropped, present keys kept, order kept."""
    c = adapters.clicks(Tables(spark, sf_dir))
    utm = {"utm_source": "shelfspark", "utm_medium": "referral", "utm_campaign": F.col("source"),
           "utm_term": U.utm_term(F.col("product_name")), "referrer": "shelfspark"}
    return c.select("id", "url", U.add_utm(F.concat(F.lit("https://shop.example.com"), F.col("url"), F.lit("?ref=")), utm)
                    .alias("final_url"))


# --- english analyser (stop words + stemming); DuckDB here has no stemmer -> rows-only checks ---
@register("h05_analyzer_english")
def h05e(spark, sf_dir):
    """Per product: tokens kept after stop words, distinct stems, last position (gaps kept)."""
    p, _ = _pq(spark, sf_dir)
    t = FT.analyze(p, ["id"], HY.search_text(p), mode="english")
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("term").alias("n_terms"),
                               F.max("pos").alias("max_pos"))


@register("h04_text_rank_cd_english")
def h04e(spark, sf_dir):
    """Cover-density rank with the english analyser on both sides (stems match inflections)."""
    pp, pq = _parsed(spark, sf_dir)
    r = HY.text_topk(pp, pq, None, HY.filter_pred(), "english", _index(spark, sf_dir, "english"))
    return r.select("query_id", "id", q6(F.col("text_rank")).alias("text_rank"))


@register("h08_hybrid_search_basic_origin_only", search_sql("""select query_id,
 row_number() over (partition by query_id order by score desc, url) as rank, url, name, made_in_canada, score
 from (select *, {s} as score from merged) qualify rank <= 25""".format(
    s=O.q6("0.5 * vector_similarity + 0.5 * text_rank + case when made_in_canada = true then 0.3 else 0.0 end")),
    k=fixed.INITIAL_SEARCH_LIMIT, basic=True, origin_only=True))
def h08o(spark, sf_dir):
    """H08 with the request's origin-only flag: both branches keep origin-flagged products only."""
    p, q = _pq(spark, sf_dir)
    r = HY.hybrid_search_basic(p, q, origin_only=True, mode="simple", index=_index(spark, sf_dir))
    return r.select("query_id", "rank", "url", "name", "made_in_canada", "score")


# the reference's own configuration: the English analyser on both sides (no stemmer in DuckDB -> rows-only checks)
@register("h07_hybrid_search_english")
def h07e(spark, sf_dir):
    """H07 over the stored English index."""
    p, q = _pq(spark, sf_dir)
    r = HY.hybrid_search(p, q, index=_index(spark, sf_dir, "english"))
    return r.select("query_id", "rank", "url", "name", "brand", F.col("vector_similarity").alias("similarity"),
                    q6(F.col("text_rank")).alias("text_rank"), "hybrid_score", "made_in_canada", "num_reviews")


@register("h08_hybrid_search_basic_english")
def h08e(spark, sf_dir):
    """H08 over the stored English index."""
    p, q = _pq(spark, sf_dir)
    r = HY.hybrid_search_basic(p, q, index=_index(spark, sf_dir, "english"))
    return r.select("query_id", "rank", "url", "name", "made_in_canada", "score")


# --- english analyser with stems from a table on both sides: value checks of tokens, stop words, positions and ranks ---
def _stems(spark):
    # written once: Spark then joins by its true size, so a small table travels and the occurrences stay
    return IO.keep(spark.createDataFrame(list(STEMS.items()), "term string, stem string"), "stems")


def _inflected(spark, sf_dir):
    """(products, queries whose nouns are inflected, stems, the stored index analysed with them)."""
    p, q = _pq(spark, sf_dir)
    stems = _stems(spark)
    index = FT.stored_index(lambda: HY.search_index(p, "english", stems=stems, packed=True), lambda name, build, write: adapters.materialize(
        spark, sf_dir, f"catalog_index_stems_{name}", build, write))
    return p, q.withColumn("text", F.regexp_replace("text", INFLECTED, "$1s")), stems, index


@register("h05_analyzer_stems", search_sql("""select id, count(*) as n_tokens, count(distinct term) as n_terms, max(pos) as max_pos,
 min(term) as first_term from dt group by id""", english=True))
def h05s(spark, sf_dir):
    """H05 in English: typed tokens, stop words that leave gaps, stems."""
    p, _ = _pq(spark, sf_dir)
    return token_counts(_by_id(p), "english", _stems(spark))


@register("h04_text_rank_cd_stems", search_sql(f"select query_id, id, {O.q6('text_rank')} as text_rank from ranked", english=True))
def h04t(spark, sf_dir):
    p, q, stems, index = _inflected(spark, sf_dir)
    pq = IO.keep(HY.prepare_queries(q), "parsed-queries")
    r = HY.text_topk(HY.prepare_products(p), pq, None, HY.filter_pred(), "english", index, stems)
    return r.select("query_id", "id", q6(F.col("text_rank")).alias("text_rank"))


@register("h07_hybrid_search_stems", search_sql("""select query_id, row_number() over (partition by query_id order by hybrid_score desc, url) as rank,
 url, name, brand, vector_similarity as similarity, {tr} as text_rank, hybrid_score, made_in_canada, num_reviews
 from hybrid qualify rank <= 250""".format(tr=O.q6("text_rank")), english=True))
def h07t(spark, sf_dir):
    p, q, stems, index = _inflected(spark, sf_dir)
    r = HY.hybrid_search(p, q, index=index, stems=stems)
    return r.select("query_id", "rank", "url", "name", "brand", F.col("vector_similarity").alias("similarity"),
                    q6(F.col("text_rank")).alias("text_rank"), "hybrid_score", "made_in_canada", "num_reviews")


@register("h08_hybrid_search_basic_stems", search_sql("""select query_id, row_number() over (partition by query_id order by score desc, url) as rank,
 url, name, made_in_canada, score from (select *, {s} as score from merged) qualify rank <= 25""".format(
    s=O.q6("0.5 * vector_similarity + 0.5 * text_rank + case when made_in_canada = true then 0.3 else 0.0 end")),
    k=fixed.INITIAL_SEARCH_LIMIT, basic=True, english=True))
def h08t(spark, sf_dir):
    p, q, stems, index = _inflected(spark, sf_dir)
    r = HY.hybrid_search_basic(p, q, index=index, stems=stems)
    return r.select("query_id", "rank", "url", "name", "made_in_canada", "score")
