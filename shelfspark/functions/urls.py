"""URL column expressions: host / domain keys, URL base, UTM tagging, tracked links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col


def url_host(c) -> Column:
    """Network location (host[:port]) of an absolute http(s) URL, '' otherwise."""
    return F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def ensure_scheme(c) -> Column:
    """Trim whitespace; prefix 'https://' unless the text starts with 'http'."""
    s = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(s.startswith("http"), s).otherwise(F.concat(F.lit("https://"), s))


def domain_key(c) -> Column:
    """Lower-cased host with every 'www.' removed (the key used to compare sites)."""
    return F.replace(F.lower(url_host(c)), F.lit("www."), F.lit(""))


def url_base(c) -> Column:
    """URL without query / fragment and without size tokens (-xs, -s, ... -xxxl)."""
    no_q = F.regexp_replace(col(c), r"[?#].*$", "")
    return F.regexp_replace(no_q, "(?i)" + fixed.URL_SIZE_TOKENS, "")


def form_encode(c) -> Column:
    """Form encoding as ``urllib.parse.quote_plus``: space -> '+', keep A-Za-z0-9 _ . - ~."""
    e = F.url_encode(col(c))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_pairs(url: Column) -> Column:
    """Decoded (k, v) pairs of the query string: blank values and pairs without '=' dropped,
    first value kept for a repeated key, order of first appearance kept."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.filter(F.split(q, "&"), lambda p: p.contains("="))
    kv = F.transform(
        raw,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.try_url_decode(F.substr(p, F.instr(p, "=") + 1)).alias("v"),
        ),
    )
    kv = F.filter(kv, lambda x: F.coalesce(x["v"], F.lit("")) != "")
    return F.filter(kv, lambda x, i: ~F.exists(F.slice(kv, 1, i), lambda y: y["k"] == x["k"]))


def add_utm(url, utm: dict[str, Column | str | None]) -> Column:
    """Add each ``utm`` key whose value is non-empty unless the query already has it."""
    u = col(url)
    pairs = _query_pairs(u)
    for k, v in utm.items():
        if v is None:
            continue
        vv = v if isinstance(v, Column) else F.lit(v)
        add = F.array(F.struct(F.lit(k).alias("k"), vv.alias("v")))
        has = F.exists(pairs, lambda x: x["k"] == F.lit(k))
        pairs = F.when(has | vv.isNull(), pairs).otherwise(F.concat(pairs, add))
    query = F.array_join(F.transform(pairs, lambda x: F.concat(form_encode(x["k"]), F.lit("="), form_encode(x["v"]))), "&")
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    frag = F.regexp_extract(u, r"#(.*)$", 1)
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                    F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))


def utm_term(product_name) -> Column:
    """Click-time term: name with spaces as '_', lower-cased, first 50 chars."""
    return F.left(F.lower(F.replace(col(product_name), F.lit(" "), F.lit("_"))), F.lit(50))


def tracked_url(url, base_url: str = "http://localhost:8000", enabled: bool = True, truncate_name: bool = True,
                **params) -> Column:
    """Click-tracking link ``{base}/click?url=..&k=v`` with the non-empty params, in order."""
    if not enabled:
        return col(url)
    items = [("url", col(url))]
    for k, v in params.items():
        c = v if isinstance(v, Column) else (F.lit(v) if v is not None else F.lit(None).cast("string"))
        if k == "product_name" and truncate_name:
            c = F.left(c, F.lit(100))
        items.append((k, c))
    parts = [
        F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(k + "="), form_encode(c))) if k != "url"
        else F.concat(F.lit("url="), form_encode(F.coalesce(c, F.lit(""))))
        for k, c in items
    ]
    return F.concat(F.lit(base_url.rstrip("/") + "/click?"), F.concat_ws("&", *parts))
