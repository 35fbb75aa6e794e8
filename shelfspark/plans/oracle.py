"""DuckDB SQL for the domain views (same rules as ``shelfspark.sources.adapters``).

The oracle queries are ``WITH <views> <body>`` over the pre-registered test
tables.  Doubles are compared after quantising to 6 decimals with the same
``floor(x*1e6 + 0.5)/1e6`` form on both sides.
"""

from __future__ import annotations

from ..functions import fixed

BRANDS_SQL = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in fixed.KNOWN_BRANDS) + "]"

K = "cast(json_extract_string(props, '$.k') as integer)"

VIEWS = {
    "reviews": """select l_partkey, cast(count(*) as int) as n,
 floor(200 + sum(l_quantity) * 25 / 4 / count(*)) / 100 as a
 from lineitem group by l_partkey""",
    "catalog": """select d.doc_id as id,
 concat('https://', d.source, '.example.com/products/', replace(p.p_name,' ','-'), '-', cast(d.doc_id % 7 as varchar),
   case when d.doc_id % 4 = 0 then '-xl' when d.doc_id % 4 = 1 then '-s' else '' end, '?ref=', cast(d.doc_id as varchar)) as url,
 concat(p.p_name, case when d.doc_id % 4 = 0 then ' - XL' when d.doc_id % 4 = 1 then ' (small)' else '' end) as name,
 p.p_brand as brand, d.text as description,
 concat('$', cast(cast(p.p_retailprice as decimal(12,2)) as varchar)) as price, 'CAD' as currency,
 concat(d.source, '.example.com') as source_site, e.embedding as embedding,
 l.quality = 1 as made_in_canada,
 case when l.quality is null then null else concat('quality=', cast(l.quality as varchar)) end as made_in_canada_reason,
 r.n as num_reviews, r.a as average_rating
 from documents d left join embeddings e on d.doc_id = e.vec_id join part p on p.p_partkey = d.doc_id
 left join labels l on l.doc_id = d.doc_id
 left join reviews r on r.l_partkey = d.doc_id""",
    "clicks": f"""select event_id as id, concat('/item/', cast(k % 40 as varchar)) as url, concat('src', cast(k % 5 as varchar)) as source,
 concat('product ', cast(k % 40 as varchar)) as product_name, cast(user_id as varchar) as user_id,
 case when user_id % 3 = 0 then 'development' else 'production' end as environment, ts as clicked_at
 from (select *, {K} as k from events) where event_type = 'click'""",
    "pageviews": f"""select event_id as id, case when k % 3 = 0 then '/' when k % 3 = 1 then '/search' else '/login' end as page,
 cast(user_id as varchar) as user_id, concat(cast(user_id as varchar), '-', cast(k % 4 as varchar)) as session_id,
 case when user_id % 3 = 0 then 'development' else 'production' end as environment, props as metadata, ts as viewed_at
 from (select *, {K} as k from events) where event_type = 'view'""",
    "feedback": f"""select event_id as id, concat('m', cast(event_id as varchar)) as message_id, cast(user_id as varchar) as user_id,
 case when event_type = 'purchase' then 'up' else 'down' end as rating,
 case when k % 2 = 0 then concat('comment ', cast(k as varchar)) end as comment,
 case when user_id % 3 = 0 then 'development' else 'production' end as environment, ts as created_at,
 concat(cast(user_id as varchar), '-', cast(k % 4 as varchar)) as session_id
 from (select *, {K} as k from events) where event_type in ('purchase','error')""",
    "product_pages": """select concat('https://shop.example.com/products/', cast(p_partkey as varchar)) as url,
 concat('<html><head><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"', p_name, '","sku":"', cast(p_partkey as varchar),
 '","brand":{"name":"', p_brand, '"},"image":["a.jpg","a.jpg","b.png"],"offers":[{"price":"', cast(cast(p_retailprice as decimal(12,2)) as varchar),
 '","priceCurrency":"CAD"}],}]}</script></head><body><h1>', p_type, ': ', p_name, '</h1></body></html>') as html
 from part""",
    "listing_pages": """select concat('https://dir.example.com/', cast(s_suppkey as varchar)) as url,
 concat('Name: ', s_name, chr(10), 'Products: ', 'goods', chr(10), 'Manufactured In: ', n_name, ', ',
   case when s_suppkey % 3 = 0 then 'Ontario' when s_suppkey % 3 = 1 then 'China' else 'Elsewhere' end, chr(10),
   'Website: shop', cast(s_suppkey as varchar), '.example.com', chr(10), 'Canadian-Owned: ',
   case when s_suppkey % 2 = 0 then 'Yes' else 'no' end) as body
 from supplier join nation on s_nationkey = n_nationkey""",
    "logs": """select o_orderkey as job, concat('Found ', cast(o_custkey as varchar), ' product URLs', chr(10),
   case when o_orderstatus = 'F' then 'HTTP 403 Forbidden' else concat('Saved ', cast(o_custkey % 50 as varchar), ' products to PostgreSQL') end) as text,
 case when o_orderstatus = 'F' then 1 else 0 end as exit_code from orders""",
    "search_queries": """select b.item_id as query_id,
 concat(p.p_name, case b.item_id % 8
   when 0 then concat(' under $', cast(cast(floor(p.p_retailprice) as int) + 50 as varchar))
   when 1 then ' 4+ stars'
   when 2 then ' made in canada'
   when 3 then concat(' ', BRANDS[cast(b.item_id % 20 + 1 as int)])
   when 4 then concat(' $', cast(cast(floor(p.p_retailprice) as int) - 100 as varchar), '-$', cast(cast(floor(p.p_retailprice) as int) + 100 as varchar))
   when 5 then concat(' over ', cast(cast(floor(p.p_retailprice) as int) - 100 as varchar))
   when 6 then ' FABRIQUÉ AU CANADA'
   else '' end) as text,
 e.embedding as query_vector
 from benchmark b join part p on p.p_partkey = b.item_id join embeddings e on e.vec_id = b.item_id""".replace("BRANDS", BRANDS_SQL),
}

VIEWS_SQL_CLICKS = "clicks AS (" + VIEWS["clicks"] + ")"

# views that other views need
DEPENDS = {"catalog": ["reviews"]}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (plus their dependencies), then ``body``."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def q6(expr: str) -> str:
    """Quantise a double to 6 decimals (same form as ``functions.numeric.q6``)."""
    return f"(floor(cast({expr} as double) * 1000000.0 + 0.5) / 1000000.0)"


AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def lookback_sql(col: str, days: int = 7) -> str:
    return f"{col} > {AS_OF_SQL} - INTERVAL {int(days)} DAY"


def _re(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


def parsed_queries_sql(src: str = "search_queries") -> str:
    """DuckDB version of ``functions.queryparse.parse_queries`` over view ``src``."""
    from ..functions import queryparse as qp

    def num(p, g=1):
        return f"case when regexp_matches(text, {_re(p)}) then cast(regexp_extract(text, {_re(p)}, {g}) as double) end"

    intent = "text"
    for p in (qp.MAX_RM, qp.MIN_RM, qp.RANGE_RM, qp.RATING_RM, fixed.ORIGIN_PHRASES):
        intent = f"regexp_replace({intent}, {_re(p)}, '', 'g')"
    intent = f"trim(regexp_replace({intent}, '\\s+', ' ', 'g'))"
    brand = "coalesce(" + ", ".join(
        f"case when contains(lower(text), '{b.lower().replace(chr(39), chr(39) * 2)}') then '{b.replace(chr(39), chr(39) * 2)}' end"
        for b in fixed.KNOWN_BRANDS) + ")"
    origin = " or ".join(f"contains(lower(text), '{k}')" for k in [*fixed.ORIGIN_KEYWORDS, fixed.ORIGIN_KEYWORDS[0].replace(" ", "-")])
    has_range = f"regexp_matches(text, {_re(qp.RANGE_RE)})"
    return f"""select * exclude (_intent),
 case when {has_range} then cast(regexp_extract(text, {_re(qp.RANGE_RE)}, 1) as double) else {num(qp.MIN_RE)} end as min_price,
 case when {has_range} then cast(regexp_extract(text, {_re(qp.RANGE_RE)}, 2) as double) else {num(qp.MAX_RE)} end as max_price,
 {num(qp.RATING_RE)} as min_rating,
 {brand} as brand,
 ({origin}) as wants_origin,
 case when length(_intent) < 3 then text else _intent end as intent
 from (select *, {intent} as _intent from {src})"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalize_name_sql(c: str) -> str:
    """DuckDB twin of ``functions.text.normalize_name``."""
    x = f"lower(coalesce({c}, ''))"
    x = f"regexp_replace({x}, {_re(chr(92) + 's*[-–]' + chr(92) + 's*' + fixed.SIZE_WORDS + chr(92) + 's*$')}, '', 'g')"
    x = f"regexp_replace({x}, {_re(chr(92) + 's*' + chr(92) + '(' + chr(92) + 's*' + fixed.SIZE_WORDS + chr(92) + 's*' + chr(92) + ')' + chr(92) + 's*$')}, '', 'g')"
    x = f"regexp_replace({x}, {_re(chr(92) + 'b(' + '|'.join(fixed.COLOR_WORDS) + ')' + chr(92) + 'b')}, '', 'g')"
    x = f"regexp_replace({x}, {_re(fixed.GENDER_PREFIX)}, '', 'g')"
    x = f"regexp_replace({x}, {_re(chr(92) + 'b(' + '|'.join(fixed.MODIFIER_WORDS) + ')' + chr(92) + 'b')}, '', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def product_type_sql(c: str) -> str:
    whens = " ".join(f"when contains(lower(coalesce({c}, '')), {sql_str(t)}) then {sql_str(t)}" for t in fixed.PRODUCT_TYPES)
    return f"(case {whens} else '' end)"


def url_base_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[?#].*$', ''), {_re(fixed.URL_SIZE_TOKENS)}, '', 'g')"


def smooth_rating_sql(r: str, n: str) -> str:
    return (f"(case when {r} is null then 4.0 when {n} is null or {n} < 10 then 4.0 when {r} <= 4.0 then cast({r} as double) "
            f"else greatest((40.0 + {n} * cast({r} as double)) / (10 + {n}), 4.0) end)")


def price_number_sql(c: str) -> str:
    return f"try_cast(nullif(regexp_replace({c}, '[^0-9.]', '', 'g'), '') as double)"


def python_title_sql(c: str) -> str:
    s = f"coalesce({c}, '')"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: case when i = 1 or "
            f"lower(substr({s}, i - 1, 1)) = upper(substr({s}, i - 1, 1)) then case when substr({s}, i, 1) = 'ß' then 'Ss' else upper(substr({s}, i, 1)) end "
            f"else lower(substr({s}, i, 1)) end), '')")


def brand_display_sql(brand: str, site: str) -> str:
    mapped = "case " + " ".join(f"when {site} = {sql_str(k)} then {sql_str(v)}" for k, v in fixed.SITE_TO_BRAND.items()) + " end"
    derived = python_title_sql(f"replace(replace(replace({site}, 'www.', ''), '.com', ''), '.ca', '')")
    return (f"(case when coalesce({brand}, '') <> '' then {brand} when coalesce({site}, '') <> '' "
            f"then coalesce({mapped}, {derived}) else 'Unknown Brand' end)")
