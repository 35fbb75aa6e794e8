"""DuckDB oracle SQL for the search stages (vector, text, merge, normalise, score)."""

from __future__ import annotations

from ..functions import fixed
from ..operators.fulltext import COMPOUND_RE, COVER_WEIGHT, ENGLISH_STOP_WORDS, TOKEN_RE, TYPED_RE
from . import oracle as O

PRED = """coalesce((not q_origin or made_in_canada = true)
 and (q_min_price is null or price_num >= q_min_price)
 and (q_max_price is null or price_num <= q_max_price)
 and (q_min_rating is null or average_rating >= q_min_rating)
 and (q_brand is null or contains(brand_lc, q_brand)), false)"""


#: Words of the catalogue and their published English stems, for the queries whose stems come from a table on both sides.
STEMS = {"rings": "ring", "bolts": "bolt", "gears": "gear", "plates": "plate", "widgets": "widget", "rods": "rod", "anvils": "anvil", "large": "larg", "stars": "star"}
INFLECTED = "(ring|bolt|gear|plate|widget|rod|anvil)"


def typed_tokens_sql(x: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({x}), '{TYPED_RE}'), lambda t: not (starts_with(t, '<') or starts_with(t, '&') or ends_with(t, '://')))"
    return f"""flatten(list_transform({found}, lambda t: case when contains(t, '@') then [t]
 when contains(t, '/') then [t, regexp_extract(t, '^[^/]*'), regexp_extract(t, '/.*$')]
 when regexp_matches(t, '{COMPOUND_RE}') then list_concat([t], string_split(t, '-')) else [t] end))"""


def english_views() -> dict[str, str]:
    """The analysed sides of ``views`` in English: typed tokens, stop words, stems from the table; nouns of the queries inflected."""
    stop = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
    rows = ", ".join(f"('{a}', '{b}')" for a, b in STEMS.items())
    return {
        "stems": f"select * from (values {rows}) t(term, stem)",
        "inflected": f"select query_id, regexp_replace(text, '{INFLECTED}', '\\1s', 'g') as text, query_vector from search_queries",
        "parsed": O.parsed_queries_sql("inflected"),
        "dt": f"""select x.* exclude (term), coalesce(stem, x.term) as term from (select id, url, price_num, average_rating, brand_lc, made_in_canada, unnest(toks) as term,
 generate_subscripts(toks, 1) as pos from (select *, {typed_tokens_sql('doc')} as toks from p)) x left join stems on stems.term = x.term where x.term not in ({stop})""",
        "qt": f"""select query_id, term, cast(dense_rank() over (partition by query_id order by term) - 1 as int) as term_idx,
 count(*) over (partition by query_id) as n_terms from (select distinct query_id, coalesce(stem, x.term) as term
 from (select query_id, unnest({typed_tokens_sql('intent')}) as term from pq) x left join stems on stems.term = x.term where x.term not in ({stop}))""",
    }


def views(k: int = fixed.SQL_CANDIDATES, basic: bool = False, origin_only: bool = False) -> dict[str, str]:
    pred = f"coalesce(not {str(origin_only).lower()} or made_in_canada = true, false)" if basic else PRED
    v = {}
    v["parsed"] = O.parsed_queries_sql("search_queries")
    v["pq"] = """select query_id, query_vector, intent, min_price as q_min_price, max_price as q_max_price,
 min_rating as q_min_rating, lower(brand) as q_brand, wants_origin as q_origin from parsed"""
    v["p"] = f"""select id, url, name, brand, description, price, currency, source_site, num_reviews, average_rating,
 made_in_canada, made_in_canada_reason, embedding, cast(null as varchar[]) as images, {O.price_number_sql('price')} as price_num, lower(brand) as brand_lc,
 concat_ws(' ', coalesce(name, ''), coalesce(brand, ''), coalesce(description, '')) as doc from catalog"""
    v["pairs"] = f"""select p.id, p.url, p.embedding, pq.query_id, pq.query_vector from p cross join pq
 where p.embedding is not null and {pred}"""
    v["vec"] = f"""select query_id, id, url, vs from (select query_id, id, url,
 {O.q6('list_dot_product(cast(embedding as double[]), cast(query_vector as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(cast(query_vector as double[]), cast(query_vector as double[]))))')} as vs
 from pairs) qualify row_number() over (partition by query_id order by vs desc, url) <= {k}"""
    v["dt"] = f"""select id, url, price_num, average_rating, brand_lc, made_in_canada, unnest(toks) as term,
 generate_subscripts(toks, 1) as pos from (select *, regexp_extract_all(lower(doc), '{TOKEN_RE}') as toks from p)"""
    v["qt"] = f"""select query_id, term, cast(dense_rank() over (partition by query_id order by term) - 1 as int) as term_idx,
 count(*) over (partition by query_id) as n_terms
 from (select distinct query_id, unnest(regexp_extract_all(lower(intent), '{TOKEN_RE}')) as term from pq)"""
    v["occ"] = f"""select qt.query_id, dt.id, dt.url, qt.term_idx, qt.n_terms, dt.pos
 from dt join qt on dt.term = qt.term join pq on pq.query_id = qt.query_id where {pred}"""
    v["matched"] = """select query_id, id from occ group by query_id, id, n_terms having count(distinct term_idx) = n_terms"""
    v["o"] = """select occ.*, row_number() over (partition by occ.query_id, occ.id order by pos) as idx
 from occ semi join matched on matched.query_id = occ.query_id and matched.id = occ.id"""
    v["ot"] = """select o.query_id, o.id, o.url, o.pos, o.idx, o.n_terms,
 max(case when o.term_idx = t.term_idx then o.pos end) over (partition by o.query_id, o.id, t.term_idx order by o.pos
   rows between unbounded preceding and current row) as last_t
 from o join (select distinct query_id, term_idx from qt) t on t.query_id = o.query_id"""
    v["ends"] = """select query_id, id, url, pos, idx, min(last_t) as start from ot
 group by query_id, id, url, pos, idx having count(last_t) = max(n_terms)"""
    v["covers"] = """select c.query_id, c.id, c.url, c.start, c.e_pos, c.e_idx, o.idx as b_idx
 from (select query_id, id, url, start, min(pos) as e_pos, min(idx) as e_idx from ends group by query_id, id, url, start) c
 join o on o.query_id = c.query_id and o.id = c.id and o.pos = c.start"""
    v["ranked"] = f"""select query_id, id, url, cast(cast(sum({COVER_WEIGHT!r} / (1 + case when (e_pos - start) - (e_idx - b_idx) < 0
 then floor((e_idx - b_idx) / 2) else (e_pos - start) - (e_idx - b_idx) end)) as real) as double) as text_rank
 from covers group by query_id, id, url"""
    v["txt"] = f"""select * from ranked qualify row_number() over (partition by query_id order by text_rank desc, url) <= {k}"""
    v["cand"] = """select p.id, p.name, p.brand, p.description, p.price, p.currency, p.url, p.source_site, p.num_reviews,
 p.average_rating, p.made_in_canada, p.made_in_canada_reason, p.images, c.query_id, c.vector_similarity, c.text_rank, c.branch
 from p join (select query_id, id, vs as vector_similarity, 0.0 as text_rank, 'vector' as branch from vec
   union all select query_id, id, cast(null as double), text_rank, 'text' from txt) c on c.id = p.id"""
    key = "url" if basic else "url_base"
    url_agg = "" if basic else "max(url) as url,"
    base_expr = "" if basic else f", {O.url_base_sql('url')} as url_base"
    v["merged"] = f"""select query_id, {key}, {url_agg} max(name) as name, max(brand) as brand, max(description) as description,
 max(price) as price, max(currency) as currency, max(source_site) as source_site, max(made_in_canada_reason) as made_in_canada_reason,
 max(coalesce(vector_similarity, 0.0)) as vector_similarity, max(coalesce(text_rank, 0.0)) as text_rank,
 max(num_reviews) as num_reviews, max(average_rating) as average_rating, bool_or(made_in_canada) as made_in_canada,
 max(cast(to_json(images) as varchar)) as images_json
 from (select *{base_expr} from cand) group by query_id, {key}"""
    if not basic:
        v["scored"] = f"""select *,
 case when max(vector_similarity) over w > min(vector_similarity) over w
   then (vector_similarity - min(vector_similarity) over w) / (max(vector_similarity) over w - min(vector_similarity) over w)
   else 1.0 end as vector_similarity_norm,
 case when max(text_rank) over w > min(text_rank) over w
   then (text_rank - min(text_rank) over w) / (max(text_rank) over w - min(text_rank) over w)
   else 0.0 end as text_rank_norm
 from merged window w as (partition by query_id)"""
        v["hybrid"] = f"""select *, {O.q6('''0.6 * (0.5 * vector_similarity_norm + 0.5 * text_rank_norm)
 + case when made_in_canada = true then 0.2 else 0.0 end
 + case when num_reviews is null or num_reviews < 10 then 0.0 else (coalesce(cast(average_rating as double), 4.0) - 4.0) * 0.2 end''')} as hybrid_score
 from scored"""
    return v


def search_sql(body: str, k: int = fixed.SQL_CANDIDATES, basic: bool = False, origin_only: bool = False, english: bool = False) -> str:
    v = views(k, basic, origin_only)
    if english:
        e = english_views()
        v = {"stems": e["stems"], "inflected": e["inflected"], **v, **e}
    return O.with_views(body, "catalog", "search_queries", extra=v)


def ranking_views() -> dict[str, str]:
    """Views after H07: ranked top 250, greedy de-dupe, limit 100, rerank by similarity, top 50."""
    v = {}
    v["ranked250"] = """select *, row_number() over (partition by query_id order by hybrid_score desc, url) as rank
 from hybrid qualify rank <= 250"""
    v["r"] = f"""select query_id, rank, concat({O.normalize_name_sql('name')}, '|', lower(coalesce(brand, ''))) as name_key,
 {O.url_base_sql("coalesce(url, '')")} as url_base from ranked250"""
    v["dd"] = """select query_id, 0 as step, cast([] as varchar[]) as names, cast([] as varchar[]) as urls, cast([] as bigint[]) as kept
 from (select distinct query_id from r)
 union all
 select dd.query_id, r.rank,
  case when list_contains(dd.names, r.name_key) or list_contains(dd.urls, r.url_base) then dd.names else list_append(dd.names, r.name_key) end,
  case when list_contains(dd.names, r.name_key) or list_contains(dd.urls, r.url_base) then dd.urls else list_append(dd.urls, r.url_base) end,
  case when list_contains(dd.names, r.name_key) or list_contains(dd.urls, r.url_base) then dd.kept else list_append(dd.kept, r.rank) end
 from dd join r on r.query_id = dd.query_id and r.rank = dd.step + 1"""
    v["kept"] = """select query_id, unnest(kept) as rank, generate_subscripts(kept, 1) as dedupe_rank
 from dd qualify step = max(step) over (partition by query_id)"""
    v["deduped"] = "select ranked250.*, kept.dedupe_rank from ranked250 join kept using (query_id, rank)"
    v["limited"] = "select * from deduped where dedupe_rank <= 100"
    v["reranked"] = """select *, vector_similarity as rerank_score,
 row_number() over (partition by query_id order by vector_similarity desc nulls last, rank) as rerank_rank
 from limited qualify rerank_rank <= 50"""
    return v


def ranking_sql(body: str) -> str:
    v = views()
    v.update(ranking_views())
    return O.with_views(body, "catalog", "search_queries", extra=v).replace("WITH ", "WITH RECURSIVE ", 1)
