"""Free-text shopping queries -> structured filters and residual intent.

All steps are Column expressions, so a batch of any size parses inside one
projection (no Python per row).  Detection runs on the original text;
removal runs on the running intent, as in the source behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import col, squeeze

# detection patterns capture the numbers; removal patterns are the same without groups
NUM = fixed.PRICE_NUMBER
NUM_NC = NUM[1:-1]
MAX_RE = fixed.MAX_PRICE_WORDS + r"\s*\$?" + NUM
MAX_RM = fixed.MAX_PRICE_WORDS + r"\s*\$?" + NUM_NC
MIN_RE = fixed.MIN_PRICE_WORDS + r"\s*\$?" + NUM
MIN_RM = fixed.MIN_PRICE_WORDS + r"\s*\$?" + NUM_NC
RANGE_RE = r"\$?" + NUM + fixed.PRICE_RANGE_JOINER + r"\$?" + NUM
RANGE_RM = r"\$?" + NUM_NC + fixed.PRICE_RANGE_JOINER + r"\$?" + NUM_NC
RATING_RE = fixed.RATING_PHRASE
RATING_RM = fixed.RATING_PHRASE.replace(r"(\d+(?:\.\d)?)", r"\d+(?:\.\d)?", 1)

CI = "(?iu)"  # Java needs the u flag for case-insensitive non-ASCII (É)


def _num(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(CI + pattern), F.regexp_extract(text, CI + pattern, group).cast("double"))


def wants_origin(text) -> Column:
    """Any origin keyword contained in the lower-cased text."""
    low = F.lower(col(text))
    first, *others = fixed.ORIGIN_KEYWORDS
    out = low.contains(first) | low.contains(first.replace(" ", "-"))
    for k in others:
        out = out | low.contains(k)
    return out


def brand(text) -> Column:
    """First known brand (list order) contained in the text, case-insensitively."""
    low = F.lower(col(text))
    return F.coalesce(*[F.when(low.contains(b.lower()), F.lit(b)) for b in fixed.KNOWN_BRANDS])


def parse_columns(text) -> dict[str, Column]:
    q = col(text)
    under = _num(q, MAX_RE)
    over = _num(q, MIN_RE)
    has_range = q.rlike(CI + RANGE_RE)
    r_lo = F.regexp_extract(q, CI + RANGE_RE, 1).cast("double")
    r_hi = F.regexp_extract(q, CI + RANGE_RE, 2).cast("double")
    intent = F.regexp_replace(q, CI + MAX_RM, "")
    intent = F.regexp_replace(intent, CI + MIN_RM, "")
    intent = F.regexp_replace(intent, CI + RANGE_RM, "")
    intent = F.regexp_replace(intent, CI + RATING_RM, "")
    intent = F.regexp_replace(intent, CI + fixed.ORIGIN_PHRASES, "")
    intent = squeeze(intent)
    return {
        "min_price": F.when(has_range, r_lo).otherwise(over),
        "max_price": F.when(has_range, r_hi).otherwise(under),
        "min_rating": _num(q, RATING_RE),
        "brand": brand(q),
        "wants_origin": wants_origin(q),
        "intent": F.when(F.length(intent) < 3, q).otherwise(intent),
    }


def parse_queries(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Add min_price, max_price, min_rating, brand, wants_origin, intent."""
    cols = parse_columns(F.col(text_col))
    return queries.select("*", *[c.alias(k) for k, c in cols.items()])
